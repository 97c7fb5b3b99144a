"""Exact dedup: a stateful stream keeps one entry per distinct content, on disk and without expiry.

A landing table in the shared folder has (content locator, doc_id, digest) of each row; the locator is the row's file
and place in it, so that contents stay where they are.  A Structured Streaming aggregation over the landing table holds,
per digest, the stable identifier (smallest doc_id), its content locator and the number of rows; its state sits in
RocksDB, has no watermark and so never expires.  Each hit (a row whose digest another row owns) is then checked byte by
byte against the owner's content; rows that differ in spite of an equal digest are grouped by their bytes.  Only
DataFrame, SQL and streaming operations are used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, drop_path, stage, stage_path

# The joins ask for a sort-merge: how many rows are copies grows with the table, and the plan stays the same at all sizes.
#: Hits that one copy of an owner's content is compared with: hot groups are dealt out in portions of this size.
HITS_A_COPY = 256
#: Data that one micro-batch takes from the landing table.
BATCH_BYTES = 64 << 30
#: State store settings of the stream: RocksDB on the executors' disks, memory bounded for all stores of an executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty.  Plain byte replacements first, the pattern only where runs remain."""
    x = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        x = F.replace(x, F.lit(c), F.lit(" "))
    return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, f"{SPACE_CLASS}+", " ")).otherwise(x)


class Deduplicated:
    """What the stream found: marks (a row per row of docs) and the located rows they speak of."""

    def __init__(self, rows: DataFrame, marks: DataFrame):
        self.rows, self.marks = rows, marks

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of docs."""
        gone = self.marks.where("not kept").select("locator")
        return self.rows.join(gone, "locator", "left_anti").select("row.*")


def located(docs: DataFrame) -> DataFrame:
    """locator and row (all columns of docs): of plain reads of files as they are, of anything else after a copy in the shared folder."""

    def plain(node) -> bool:
        if (name := node.getClass().getSimpleName()) == "LogicalRelation":
            return "HadoopFsRelation" in node.relation().getClass().getSimpleName() and "Parquet" in node.relation().fileFormat().toString()
        return name in ("Project", "Filter", "SubqueryAlias") and plain(node.children().head())

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("locator")
    if plain(docs._jdf.queryExecution().analyzed()) and "_metadata" not in [c.lower() for c in docs.columns]:
        try:
            return docs.select(locator, row)
        except AnalysisException:
            pass
    return stage(docs.select(row), "dedup-rows").select(locator, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Deduplicated:
    """marks has one row per row of docs: its locator, doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so all null and empty texts are one group.  A null id sorts last: such a row stays only
    if no row of its group has an id.  Rows with equal id and text are copies like others: exactly one of them is kept.
    An empty table gives an empty result.  Other columns of docs, whatever their names, play no part and stay as they are.
    """
    spark = docs.sparkSession
    landing_path, state_path, out_path = (stage_path(spark, f"dedup-{k}") for k in ("landing", "state", "owners"))
    doc_id, content = F.col("row")[id_col].alias("doc_id"), normalised(F.col("row")[text_col])
    rows = located(docs)
    entries = rows.select("locator", doc_id, F.sha2(content.cast("binary"), 256).alias("digest"))
    entries.write.option("compression", "zstd").parquet(landing_path)
    landing = spark.read.schema(entries.schema).parquet(landing_path)

    # Dealt out anew, the owners meet the landing table in a join of its own stage, which can split a hot digest.
    owners = _owners(spark, landing, landing_path, state_path, out_path)
    shared = stage(landing.join(owners.where("group_size > 1").repartition(F.xxhash64("digest")).hint("merge"), "digest"), "dedup-shared")
    apart = stage(_differing(rows, shared, content), "dedup-apart")
    if not apart.isEmpty():  # digests agree and bytes do not: the bytes decide
        second = apart.groupBy("digest", "content").agg(F.min(_order("doc_id", "locator")).alias("own2"), F.count(F.lit(1)).alias("size2"))
        gone = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        again = apart.join(second, ["digest", "content"]).select("locator", "own2", "size2")
        shared = shared.join(again, "locator", "left").join(gone, "digest", "left")
        size = F.coalesce("size2", F.col("group_size") - F.coalesce("gone", F.lit(0)))
        shared = shared.select("locator", "doc_id", "digest", F.coalesce("own2", "own").alias("own"), size.alias("group_size"))
    marks = landing.join(shared.select("locator", "own", "group_size").hint("merge"), "locator", "left")
    alone = F.col("own").isNull()
    marks = marks.select(
        "locator",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("own.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("own.locator") == F.col("locator"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return Deduplicated(rows, marks)


def _order(doc_id: str, locator: str) -> Column:
    """Smallest first: rows with an id before rows without, then by id, then by place."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(locator).alias("locator"))


def _owners(spark, landing: DataFrame, landing_path: str, state_path: str, out_path: str) -> DataFrame:
    """Runs the stream over the landing table to its end; the last state of each digest."""
    stream = spark.readStream.schema(landing.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(landing_path)
    state = stream.groupBy("digest").agg(F.min(_order("doc_id", "locator")).alias("own"), F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out_path}/batch={number}")

    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    drop_path(spark, state_path)
    spark.createDataFrame([], state.schema).write.parquet(f"{out_path}/batch=-1")  # so that an empty table has a schema too
    seen = spark.read.schema(state.schema).parquet(*[f"{out_path}/batch=*"])
    return seen.groupBy("digest").agg(F.min("own").alias("own"), F.max("group_size").alias("group_size"))


def _differing(rows: DataFrame, shared: DataFrame, content: Column) -> DataFrame:
    """Hits whose bytes are not those of their owner, although the digests agree."""
    portions = F.ceil(F.col("group_size") / HITS_A_COPY)
    full = stage(shared.hint("merge").join(rows.select("locator", content.alias("content")), "locator"), "dedup-contents")
    is_own = F.col("locator") == F.col("own.locator")
    hits = full.where(~is_own).select("locator", "doc_id", "digest", "content", F.pmod(F.xxhash64("locator"), portions).alias("part"))
    owned = full.where(is_own).select("digest", F.col("content").alias("owned"), F.explode(F.sequence(F.lit(0).cast("long"), portions - F.lit(1).cast("long"))).alias("part"))
    return hits.join(owned.hint("merge"), ["digest", "part"]).where(F.col("content") != F.col("owned")).select("locator", "doc_id", "digest", "content")
