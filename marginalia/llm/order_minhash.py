"""Document fingerprints by Order MinHash, on DataFrame functions alone.

A text's k-mers are runs of K words (shorter at its end). Each k-mer carries its occurrence number, so that a repeated
one counts as often as it stands. For every one of SIGNATURES hash functions the two k-mers (with their occurrences) of
least hash are selected, put in the order in which they stand in the text, and the ordered pair is hashed. Texts share a
signature where they select the same k-mers in the same order, which makes the likeness (the share of equal signatures)
fall with edit distance, not with set overlap alone. The functions are turns of one: function i measures a k-mer's hash
from the i-th of SIGNATURES even points of the ring of hashes on, so its two least are the next two k-mers on the ring
from there, and one sort of a text's k-mers by hash selects for all functions.

``next to`` a document stands the one of the next doc_id. Documents are dealt by ranges of doc_id into buckets, sorted
within each, and the last of a bucket takes the first of the next bucket; no sort holds all rows in one task. Buckets
grow in number with the session's partitions; rows of one very common id, or without one, are dealt on by a hash of
their text, which is also their order. The texts are shuffled once; occurrence numbers and least hashes come from sorts
within the same partitions.

Defined cases: a null text is empty; a text without words has the fingerprint of no k-mers, and two such are alike (1.0);
a single k-mer is paired with itself; a single document is followed by itself; null doc_ids come first; repeated
doc_ids follow one another by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K, SIGNATURES = 3, 64
#: Hashes lie on a ring of 2^64 points, cut into SIGNATURES cells by their first bits.
CELL_BITS = 6
#: Ranges of ids that come from quantiles; each is cut further, evenly, where there are more partitions.
RANGES = 1024
#: A text becomes as many rows as it has words, so its partitions are finer than the session's by this factor.
PARTITIONS = 3
FIRST = -(1 << 63)


#: Bounds that a range is looked up among at a time.
STEP = 32


def _constants(values: list, kind: str) -> Column:
    """An array that stays one small expression in plans, however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range(key: Column, bounds: list[int]) -> Column:
    """The number of sorted bounds not above the key: of each STEP of them first, then within the step."""
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    step = below(_constants(bounds[STEP - 1 :: STEP], "bigint"))
    return step * STEP + below(F.slice(_constants(bounds, "bigint"), step * STEP + 1, F.lit(STEP)))


def neighbours(docs: DataFrame, partitions: int) -> DataFrame:
    """(bucket, place, k, text, next): rows in order of doc_id and text hash, place from 1 on in each bucket, each with the text that follows."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    wanted = 4 * partitions
    n = min(RANGES, wanted)
    quantiles = F.percentile_approx("k", _constants([i / n for i in range(1, n)], "double"), 50 * n) if n > 1 else F.array().cast("array<long>")
    found, low, high = rows.agg(quantiles, F.min("k"), F.max("k")).first()
    found = found or []
    # an id that fills whole ranges gets one to itself, cut by the hash; other ranges are cut by the id
    hot = {k: c for k in set(found) if (c := found.count(k)) > 1}
    bounds = sorted(set(found) | {k + 1 for k in hot if k < (1 << 63) - 1})
    starts, ends = [low or 0, *bounds], [*bounds, (high or 0) + 1]
    cuts = [max(1, wanted // n) * hot.get(a, 1) for a in starts]
    rows = rows.withColumn("range", _range(F.col("k"), bounds))
    if max(cuts) == 1:
        rows = rows.withColumn("bucket", F.col("range").cast("long"))
    else:
        of = lambda values, kind: _constants(values, kind)[F.col("range")]
        share = F.when(of([a in hot for a in starts], "boolean"), F.col("h").cast("double") / 2.0**64 + 0.5).otherwise((F.col("k").cast("double") - of([float(a) for a in starts], "double")) / of([float(b - a) for a, b in zip(starts, ends)], "double"))
        part = F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1 - 2.0**-40))) * of(cuts, "int"))
        rows = rows.withColumn("bucket", F.col("range").cast("long") * (1 << 32) + part)
    order = ["k", "h", "text"]
    heads = rows.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("least"))
    along = Window.orderBy("bucket")  # one number a bucket
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("bucket", F.coalesce(F.lead("bucket").over(along), F.first("bucket").over(whole)).alias("beyond"))
    firsts = rows.join(F.broadcast(heads.select(F.col("bucket"), "least.k", "least.h")), ["bucket", "k", "h"]).groupBy("bucket").agg(F.min("text").alias("following"))
    heads = after.join(firsts.withColumnRenamed("bucket", "beyond"), "beyond").select("bucket", "following")
    within = Window.partitionBy("bucket").orderBy(*order)
    return (
        rows.repartition(partitions, "bucket")
        .withColumn("place", F.row_number().over(within))
        .withColumn("next", F.lead("text").over(within))
        .join(heads, "bucket")
        .select("bucket", "place", "k", "text", F.coalesce("next", "following").alias("next"))
    )


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def signatures(texts: DataFrame, *by: str) -> DataFrame:
    """(by.., text) to (by.., signature): array of SIGNATURES values of 32 bits. The rows must be dealt by the first column of ``by``."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    split = texts.select(*by, words.alias("w"))
    zipped = F.arrays_zip(*[F.col("w") if i == 0 else F.slice("w", F.lit(i + 1), F.size("w")) for i in range(K)])
    kmers = split.select(*by, F.posexplode_outer(zipped).alias("at", "kmer"))
    kmers = kmers.select(*by, "at", F.when(F.col("at").isNotNull(), F.xxhash64(*[F.col("kmer")[str(i) if i else "w"] for i in range(K)])).alias("h"))
    numbered = kmers.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by, "h").orderBy("at")))
    element = F.when(F.col("h").isNotNull(), F.xxhash64("h", "occurrence"))
    numbered = numbered.select(*by, F.col("at").cast("int").alias("at"), element.alias("e"), (F.shiftright(element, 64 - CELL_BITS) + SIGNATURES // 2).cast("int").alias("cell"))
    # on the ring of hashes, k-mer after k-mer: one that is the first of its cell is the least of every function whose point
    # lies after the k-mer before it, and the next on the ring is the second least
    ring = Window.partitionBy(*by).orderBy("e")
    steps = numbered.select(*by, "cell", F.lag("cell").over(ring).alias("before"), "e", "at", F.lead("e").over(ring).alias("e2"), F.lead("at").over(ring).alias("at2"))
    firsts = steps.filter("before is null or before < cell").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("before", F.lit(-1)).alias("before"), "e", "at", "e2", "at2"))).alias("a"))

    def pair(x: Column) -> Column:
        y, at = F.coalesce(x["e2"], F.col("a")[0]["e"]), F.coalesce(x["at2"], F.col("a")[0]["at"])
        return F.when(x["at"] <= at, F.xxhash64(x["e"], y)).otherwise(F.xxhash64(y, x["e"])).bitwiseAND(F.lit(0xFFFFFFFF))

    held = F.flatten(F.transform("a", lambda x: F.array_repeat(pair(x), x["cell"] - x["before"])))
    # points after the last k-mer come round to the first
    whole = F.concat(held, F.array_repeat(pair(F.col("a")[0]), F.lit(SIGNATURES) - F.size(held)))
    none = F.array_repeat(F.lit(0).cast("long"), SIGNATURES)
    return firsts.select(*by, F.when(F.col("a")[0]["e"].isNull(), none).otherwise(whole).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, same: n + same).cast("double") / SIGNATURES


def text_of(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    partitions = max(8, PARTITIONS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = neighbours(docs, partitions)
    both = rows.select("bucket", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), edited(F.col("text"), F.col("next")).alias("text")))).alias("x"))
    signed = signatures(both.select("bucket", "place", "x.side", "x.text"), "bucket", "place", "side")
    signed = signed.groupBy("bucket", "place").agg(*[F.first(F.when(F.col("side") == s, F.col("signature")), ignorenulls=True).alias(name) for s, name in ((0, "own"), (1, "changed"))])
    facts = rows.select("bucket", "place", "k", F.length("text").cast("long").alias("n_chars"), F.sha2(edited(F.col("text"), F.col("next")), 256).alias("edited_sha256"))
    known = saved(facts.join(signed, ["bucket", "place"]))
    along = Window.orderBy("bucket")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = known.filter("place = 1").select("bucket", F.coalesce(F.lead("own").over(along), F.first("own").over(whole)).alias("beyond"))
    within = Window.partitionBy("bucket").orderBy("place")
    out = known.withColumn("following", F.lead("own").over(within)).join(heads, "bucket").withColumn("following", F.coalesce("following", "beyond"))
    return out.select(
        F.when(F.col("k") != FIRST, F.col("k")).cast(kind).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_of(F.col("own")).alias("fingerprint"),
        text_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
