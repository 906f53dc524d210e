"""Readers, writers, stage checkpoints and column-name rules."""
