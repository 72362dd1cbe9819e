"""Folders of mixed files as rows, and tables written as files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that tell its kind.
HEAD = 1024


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


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, written now: what is read twice is computed once, and a lost executor loses nothing of it.
    What it was shuffled through goes at once. ``by``: the column by whose hash they lie in as many buckets as a shuffle has partitions, so
    that windows, groups and joins by that column shuffle nothing. Such a table has a name in the catalogue only while it is opened."""
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path, name = f"{shared_dir(spark)}/marginalia-{key}", f"marginalia_{key}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if by:
            df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _SAVED.append(path)
    if not by:
        return spark.read.schema(df.schema).parquet(path)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def forget_one(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark reaches it by."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that ``saved`` wrote. For a caller who has consumed all results that rest on them."""
    while _SAVED:
        forget_one(spark, _SAVED.pop())


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, head) of every file below path: what the operators corpus_kind and corpus_sniff read as fx_files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.decode(F.substring("content", 1, HEAD), "ISO-8859-1").alias("head"))


# Bytes 80 to 9F of the Windows code page; those without a character become the replacement character.
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
# End of fixed values.


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) to (path, encoding, text): UTF-8 with a mark, UTF-8, UTF-16 with a mark, else the Windows code page.

    Bytes without a mark are never read as UTF-16, which nearly any even number of bytes could be.
    """
    first = F.hex(F.substring("content", 1, 3))
    marked = first == "EFBBBF"
    wide = first.startswith("FFFE") | first.startswith("FEFF")
    encoding = F.when(marked, "utf-8-sig").when(F.is_valid_utf8("content"), "utf-8").when(wide, "utf-16").otherwise("cp1252")
    text = F.when(marked, F.decode(F.expr("substring(content, 4)"), "UTF-8")).when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    latin = F.decode("content", "ISO-8859-1")
    text = text.when(wide, F.decode("content", "UTF-16")).otherwise(F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), WINDOWS))
    return files.select("path", encoding.alias("encoding"), text.alias("text"))


def write_whole(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the output at path as a whole. It is written beside it and takes its name only when complete; what was there
    goes last, and comes back if the exchange fails."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh, before = (f"{path}-{uuid.uuid4().hex}" for _ in range(2))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(conf)
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(fresh)
        was = files.exists(at(path))
        if was and not files.rename(at(path), at(before)):
            raise OSError(f"cannot set {path} aside")
        if not files.rename(at(fresh), at(path)):
            if was:
                files.rename(at(before), at(path))
            raise OSError(f"cannot put {path} in place")
    finally:
        files.delete(at(fresh), True)
    files.delete(at(before), True)


def decode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four encodings, which of them each was read as, and a digest of the text that came out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark, text, kind = F.unhex(F.lit("EFBBBF")), F.col("text"), F.col("doc_id") % 4
    latin = F.encode(F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")
    content = F.when(kind == 0, F.concat(mark, text.cast("binary"))).when(kind == 1, text.cast("binary")).when(kind == 2, F.encode(text, "UTF-16")).otherwise(F.concat(latin, F.unhex(F.lit("938094"))))
    read = decoded(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return read.select(F.col("path").cast("long").alias("doc_id"), "encoding", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: What must come out: the text that went in, and three characters of the code page after those of the last kind.
DECODE_SQL = r"""
select doc_id, case when kind = 0 then 'utf-8-sig' when kind = 3 then 'cp1252' when kind = 1 or t = '' then 'utf-8' else 'utf-16' end encoding,
       cast(length(read) as bigint) n_chars, md5(read) text_md5
from (select *, case when kind = 3 then regexp_replace(t, '[^\x{00}-\x{FF}]', '?', 'g') || '“€”' else t end read
      from (select doc_id, doc_id % 4 kind, coalesce(text, '') t from documents) a) b
"""


def corpus_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by source, replaced as a whole, and what is then there."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    write_whole(docs, path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("n_chars"))
