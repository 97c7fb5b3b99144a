"""Folds over unbounded frames: maps, filters and mergeable folds (sum, length, min, max, mean, cm2) run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import Fold


def windowed(stream: DataFrame, time: str, window: str, late: str, keys: list[str] | None = None, slide: str | None = None, **folds: Fold) -> DataFrame:
    """Folds of each key and time window; rows more than late behind the latest time no longer count."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w, *(keys or [])).agg(*[f.alias(n) for n, f in folds.items()])


def into_table(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that takes all that is there and ends; its checkpoint lets a later one go on from there."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
