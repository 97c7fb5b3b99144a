"""Connected components of an edge table, without ever gathering a component in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage, workers_of

#: Edges that a task holds before it makes a forest of them.
HELD_EDGES = 2_000_000


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges from the least node of each component to its others: fewer than nodes, with the same components."""
    if not len(edges):
        return edges
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    name = np.arange(len(nodes))
    while True:
        least = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, name[a], least)
        np.minimum.at(new, name[b], least)
        new = new[new]
        if (new == name).all():
            break
        name = new
    more = np.flatnonzero(name != np.arange(len(nodes)))
    return np.column_stack([nodes[name[more]], nodes[more]])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with a > b: each node of a task's edges but the least of its component once as a."""
    held, size, limit = [], 0, HELD_EDGES
    rows = lambda x: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 1])), pa.array(np.ascontiguousarray(x[:, 0]))], names=["a", "b"])
    for batch in batches:
        held.append(np.column_stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        size += len(held[-1])
        if size > limit:
            held = [forest(np.concatenate(held))]
            size = len(held[0])
            if size > limit // 2:  # so many nodes: what is held goes, and the next edges make a forest of their own
                yield rows(held[0])
                held, size = [], 0
    if held:
        yield rows(forest(np.concatenate(held)))


def _contracted(edges: DataFrame, label: str) -> DataFrame:
    """Fewer edges with the same components.

    Each task makes a forest of the edges it has read, so that no node is the larger one of more than one edge a task;
    then the edges are dealt by that node, and what meets is made a forest again.  A hub that many edges of many tasks
    name thus ends with one edge for each of its nodes.
    """
    spread = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forests, "a long, b long")
    return stage(spread.repartition(workers_of(edges.sparkSession), "a").mapInArrow(_forests, "a long, b long").distinct(), label)


def _settled(e: DataFrame) -> bool:
    """Each node that has a smaller neighbour has just one, which has none."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("tops")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("tops")))
    return ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("tops").alias("tops")).where("ups + tops > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), where root is the smallest node that can be reached.

    Edges are contracted (see there) until only stars are left.  Where they aren't yet, each edge moves to the least
    neighbour of its smaller node first, which about halves the ways to the roots; those neighbours are dealt out anew, so
    that a hub's edges meet them in a plain join, whose hot key Spark can split.  Each round's edges go to the shared
    folder.  Nulls and loops are left out; repeated edges count once.  Ids are longs.
    """
    e, number = _contracted(edges, "cc-0"), 0
    while not _settled(e):
        number += 1
        least = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")).repartition(F.xxhash64("b"))
        moved = e.join(least.hint("merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        before, e = e, _contracted(moved, f"cc-{number}")
        unstage(before)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
