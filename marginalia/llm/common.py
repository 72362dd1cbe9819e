"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables written by ``saved``, for ``forget``.
_SAVED: list[str] = []


#: Whether what a job shuffled goes when it ends, not when the driver next happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor loses nothing of it. What it was shuffled
    through goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` returned, once what was made of them is a table too."""
    for df in tables:
        spark = df.sparkSession
        at, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} & {p for p in _SAVED}:
            _SAVED.remove(folder)
            at(folder).getFileSystem(conf).delete(at(folder), True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that ``saved`` wrote. For a caller who has consumed all results that rest on them."""
    at, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    while _SAVED:
        path = at(_SAVED.pop())
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Returns memory that this worker has freed to the system. Workers are used again, stage after stage, beside the JVM's heap, and
    would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most so many rows, and bytes of the text column (or one row), so that what a worker makes of
    texts at once is bounded however Spark cuts its batches. Nothing is copied. What a batch took is given back before the next."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < len(ends):
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, end - at)
            at, done = end, int(ends[end - 1])
        del batch, ends
        give_back()


def row_key(df: DataFrame) -> Column:
    """64 bits of all of a row, which with its doc_id tell it from others that repeat the id or have none. Maps take no part."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as no column of the frame has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id's text leaves 2 when divided by 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))
