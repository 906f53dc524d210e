"""Registered queries: each reads whole test tables and, where SQL can express it, has an oracle."""

from permspark.catalog.base import QUERIES, ORACLES

__all__ = ["QUERIES", "ORACLES", "load_all"]


def load_all() -> None:
    """Import every module that registers queries."""
    from permspark.catalog import (  # noqa: F401
        absorption,
        basics,
        features,
        groups,
        joins,
        models,
        quality,
        risk,
        sampling,
        statistics,
    )
