"""Shared plumbing: the shared folder, staging tables, shipping the package and small expressions."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call white space, and a word.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package where they don't find it themselves."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in known or getattr(sc, "_vecframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="vecframe-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "vecframe_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "vecframe")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(target)
    sc._vecframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a temporary one only where it is unset and all is one process."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = getattr(sc, "_vecframe_shared", None)
    if own is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        own = tempfile.mkdtemp(prefix="vecframe-shared-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
        sc._vecframe_shared = own
    return f"file://{own}"


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there, lost executors cost nothing, and what was shuffled for it goes."""
    path, conf = stage_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANS, None)
    conf.set(CLEANS, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # a frame keeps the mode it was made in
    finally:
        conf.unset(CLEANS) if before is None else conf.set(CLEANS, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(store, temporary: str, place: str) -> None:
    """A task's complete file gets its name.  An earlier attempt may have made the same file: then that one stays."""

    def digest(path: str) -> str:
        h = hashlib.sha256()
        with store.open_input_stream(path, compression=None) as f:
            while data := f.read(1 << 20):
                h.update(data)
        return h.hexdigest()

    from pyarrow.fs import FileType

    if store.get_file_info(place).type != FileType.NotFound:
        if digest(place) != digest(temporary):
            raise FileExistsError(place)
        store.delete_file(temporary)
        return
    store.move(temporary, place)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._staged_at)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of doc_id as text, modulo mod, is rest.  A null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def carried(docs: DataFrame, carry: bool) -> list[Column]:
    """All columns of docs as one struct, out of the way of an operator's own names; or nothing."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []


def workers_of(spark: SparkSession) -> int:
    """The session's shuffle width, for operators that deal out by a key themselves."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

