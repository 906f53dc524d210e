"""Session settings that suit these jobs; pass them to the builder, nothing here changes a session."""

from __future__ import annotations

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Several joins on one key share a partitioning. Only with this are their hot partitions split as well, at the
    # price of one more shuffle where one is found.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above 8000 bytes. Wide QC projections fuse into larger ones;
    # with this limit Spark falls back to its split projections, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder):
    for k, v in RECOMMENDED.items():
        builder = builder.config(k, v)
    return builder
