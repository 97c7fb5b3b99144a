"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI mode stays on: every operation that the algebra answers with NA or Inf is lowered so that it can't raise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; what the caller or the cluster sets wins."""
    builder = SparkSession.builder.appName("vecframe")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
