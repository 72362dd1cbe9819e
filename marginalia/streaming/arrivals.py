"""Versions and pages as they arrive: the newest version of each source, and checks of pages not seen before.

Both keep their memory in Spark's state store, by key, so the work of a batch follows the batch: the newest version of a source is
an aggregate whose changed keys alone come out, and a page that was checked is known by its id and the digest of its html.
Outputs are kept by batch and replaced as a whole, so a batch that runs again ends as it would have the first time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans import registry
from marginalia.sources.files import forget_one, saved, shared_dir


def arriving(spark: SparkSession, sf_dir: str, table: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{table}.parquet*")


def latest(snapshots: DataFrame) -> DataFrame:
    """(source_id, saved_at, snapshot_id, title), a stream or a table, to the newest of each source. Arrival order does not matter."""
    newest = F.max_by(F.struct("saved_at", "snapshot_id", "title"), F.struct("saved_at", "snapshot_id"))
    return snapshots.groupBy("source_id").agg(newest.alias("s")).select("source_id", "s.*")


def keep_latest(snapshots: DataFrame, out: str) -> None:
    """A stream of (source_id, snapshot_id, saved_at, title): each batch leaves the newest versions of the sources it changed at ``out``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    query = latest(snapshots).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def kept_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each source, of what ``keep_latest`` left."""
    return latest(spark.read.parquet(f"{out}/changes")).drop("saved_at")


def compacted(spark: SparkSession, out: str, upto: int) -> None:
    """Puts the changes of batches up to a number into one, so that what is left follows the sources, not the batches."""
    changes = spark.read.parquet(f"{out}/changes")
    rows = saved(latest(changes.filter(F.col("batch") <= upto)))
    rows.write.mode("overwrite").parquet(f"{out}/changes/batch={upto}")
    for (number,) in changes.select("batch").distinct().filter(F.col("batch") < upto).collect():
        forget_one(spark, f"{out}/changes/batch={number}")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = arriving(spark, sf_dir, "events")
    snapshots = events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("saved_at"), F.col("event_type").alias("title"))
    out = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    keep_latest(snapshots, out)
    return kept_latest(spark, out)


def check_arrivals(pages: DataFrame, out: str, seen_at: str | None = None, forget_after: str | None = None) -> None:
    """A stream of pages: those not seen before, by id and a digest of their html, are checked batch by batch and their findings kept at
    ``out``. With ``seen_at`` (a time column) and ``forget_after`` (such as ``30 days``) a page is forgotten that long after it came,
    and is checked again if it comes again; without them it is known for good."""
    signed = pages.withColumn("sign", F.sha2(F.coalesce("html", F.lit("")), 256))
    if seen_at and forget_after:
        new = signed.withWatermark(seen_at, forget_after).dropDuplicatesWithinWatermark(["page_id", "sign"])
    else:
        new = signed.dropDuplicates(["page_id", "sign"])

    def check(batch: DataFrame, number: int) -> None:
        rows = saved(batch.drop("sign"))
        registry.apply(batch.sparkSession, "page_findings", pages=rows).write.mode("overwrite").parquet(f"{out}/issues/batch={number}")

    new.writeStream.foreachBatch(check).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/checks-{uuid.uuid4().hex}"
    check_arrivals(arriving(spark, sf_dir, "pages"), out)
    return spark.read.parquet(f"{out}/issues").select("doc_id", "key", "severity", "kind", "ordinal")
