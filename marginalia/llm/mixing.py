"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions alone.

Each source gets a target in words (``targets``). A document of that source deserves target / source_size copies, a
whole part and a fraction. The fractions are rounded dependently: two documents at a time move mass (copies x words)
from one to the other in a random direction, with odds that keep every expectation, until one of them is integral; the
other goes on. Groups of about ``fan`` documents of a source do this side by side, their single residuals meet in
groups of the next level, and so up a tree of log_fan(n) levels to the last residual, which a coin decides. A source's
total thus misses its target by less than one document.

Defined cases: null text counts as no words; a null source is a source of its own, last in order; a null or repeated
doc_id and repeated rows are rows like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, row_key, saved, unit, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Documents that one group rounds; also the residuals that one group of a higher level takes.
FAN = 64
#: Up to so many sources are broadcast; beyond it Spark shuffles the join.
BROADCAST_SOURCES = 50_000


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above cap x its size.

    Sources in code point order, null last, take the weights in turn. Sorted by cap / weight, the sources that stop at
    their cap come first, so the level that the rest share follows from running sums. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    return (
        per_source.withColumn("rank", F.row_number().over(order))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("top", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("top") / F.col("w"))
        .withColumn("before", F.coalesce(F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / F.col("w_rest"))
        .withColumn("stops", F.col("level") * F.col("w") >= F.col("top"))
        .withColumn("shared", F.min(F.when(~F.col("stops"), F.struct("ratio", "rank", "level"))).over(every)["level"])
        .select("source", "source_size", F.when(F.col("stops"), F.col("top")).otherwise(F.col("w") * F.col("shared")).cast("double").alias("target"))
    )


#: One duel: a is the residual so far, b the next document. ``up`` moves mass from b to a, ``down`` from a to b.
_DUEL = """
transform(array(named_struct(
    'up', least((1 - a.p) * a.size, b.p * b.size), 'down', least(a.p * a.size, (1 - b.p) * b.size))),
  d -> transform(array(if(
      pmod(xxhash64({seed}, a.key, b.key), 4503599627370496) / 4503599627370496D * (d.up + d.down) < d.down,
      named_struct('a', a.p + d.up / a.size, 'b', b.p - d.up / b.size),
      named_struct('a', a.p - d.down / a.size, 'b', b.p + d.down / b.size))),
    m -> named_struct('a', {row_a}, 'b', {row_b}))[0])[0]
"""
_ROW = "named_struct('key', {x}.key, 'doc_id', {x}.doc_id, 'number', {x}.number, 'size', {x}.size, 'whole', {x}.whole, 'p', {p})"
#: Rounding errors must not keep a fraction alive.
_SNAP = "case when {p} < 1e-9 then 0D when {p} > 1 - 1e-9 then 1D else {p} end"


def _fold(seed: int) -> str:
    """SQL: an array of rows ``units`` to the same rows, of which at most one still has a fraction."""
    row = "struct<key:bigint,doc_id:{t},number:bigint,size:bigint,whole:int,p:double>"
    duel = _DUEL.format(seed=f"{seed}L", row_a=_ROW.format(x="a", p=_SNAP.format(p="m.a")), row_b=_ROW.format(x="b", p=_SNAP.format(p="m.b")))
    step = f"""
      if(acc.open is null, named_struct('open', b, 'done', acc.done),
         transform(transform(array(acc.open), a -> {duel}), r -> case
           when r.a.p in (0D, 1D) and r.b.p in (0D, 1D) then named_struct('open', cast(null as {row}), 'done', concat(acc.done, array(r.a, r.b)))
           when r.a.p in (0D, 1D) then named_struct('open', r.b, 'done', concat(acc.done, array(r.a)))
           else named_struct('open', r.a, 'done', concat(acc.done, array(r.b))) end)[0])"""
    return f"aggregate(units, named_struct('open', cast(null as {row}), 'done', cast(array() as array<{row}>)), (acc, b) -> {step}, acc -> if(acc.open is null, acc.done, concat(acc.done, array(acc.open))))"


def round_copies(units: DataFrame, most: int, fan: int = FAN, seed: int = 10) -> DataFrame:
    """(source, n, key, doc_id, number, size, whole, p), 0 < p < 1, to the same with p 0 or 1. n: rows of the source, most: the largest n."""
    kind = dict(units.dtypes)["doc_id"]
    done, level, groups = [], 0, most
    left = units
    while True:
        groups = math.ceil(groups / fan)
        n_groups = F.ceil(F.col("n") / F.lit(float(fan) ** (level + 1)))
        row = F.struct("key", "doc_id", "number", "size", "whole", "p")
        left = saved(
            left.groupBy("source", "n", F.pmod(F.xxhash64(F.lit(seed + level), "key"), n_groups).alias("g"))
            .agg(F.array_sort(F.collect_list(row)).alias("units"))
            .select("source", "n", F.explode(F.expr(_fold(seed + level).replace("{t}", kind))).alias("u"))
            .select("source", "n", "u.*")
        )
        if groups <= 1:
            done.append(left)
            break
        done.append(left.filter("p in (0D, 1D)"))
        left = left.filter("p not in (0D, 1D)")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    coin = F.when(unit(F.lit(seed - 1), F.col("key")) < F.col("p"), 1.0).otherwise(0.0)
    return out.withColumn("p", coin)


#: Rows that are alike are numbered so many at a time.
NUMBERED = 1 << 16


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, number): rows alike in the first three are numbered from 1 on, so that each has a key of its own.

    They are counted and set out again from their count, in pieces that Spark deals out, never gathered.
    """
    alike = saved(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    if alike.filter("n > 1").isEmpty():
        return alike.select("doc_id", "source", "size", F.col("n").alias("number"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / NUMBERED))))
    first = F.col("part") * NUMBERED + 1
    if not alike.filter(F.col("n") > NUMBERED).isEmpty():
        parts = parts.repartition("doc_id", "source", "size", "part")
    return parts.select("doc_id", "source", "size", F.explode(F.sequence(first, F.least(first + NUMBERED - 1, "n"))).alias("number"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, fan: int = FAN, seed: int = 10) -> DataFrame:
    """One row a document: doc_id, source, size, number, source_size, target (of its source, in words), copies, taken (copies x size).

    ``number`` tells rows of one doc_id, source and size apart.
    """
    slim = saved(numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))))
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = saved(targets(per, weights, cap).join(per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    n_sources, most = goal.agg(F.count("*"), F.max("n")).first()
    goal = goal.withColumnRenamed("source", "s")
    if n_sources <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    rows = (
        slim.join(goal, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("whole", whole.cast("int"))
        .withColumn("p", F.greatest(F.lit(0.0), rate - whole))
        .withColumn("p", F.when((F.col("p") < 1e-9) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size", "source", "number"))
    )
    units = rows.filter("p > 0").select("source", "n", "key", "doc_id", "number", "size", "whole", "p")
    rounded = round_copies(units, most or 0, fan, seed).drop("key", "n").join(goal.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole_only = rows.filter("p = 0").select("source", "doc_id", "number", "size", "whole", "p", "source_size", "target")
    copies = (F.col("whole") + F.col("p")).cast("int")
    return (
        whole_only.unionByName(rounded)
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "number", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The documents that the mix takes, all columns, with ``copies``, ``size``, ``taken`` and their source's ``target``.

    Columns of those names that documents have already stay as ``given_copies`` and so on. Rows of one doc_id, source and
    size, which are few, are numbered by a hash of all of their columns, and each takes the copies of its own number.
    """
    added = ["copies", "size", "taken", "target"]
    ids = ["doc_id", "source", "size"]
    for c in [c for c in added if c in docs.columns]:
        docs = docs.withColumnRenamed(c, free_given(docs, c))
    kept = docs.columns
    plan = saved(mix(docs, weights, cap).select(*ids, "number", "copies", "taken", "target"))
    words, key, n, *own = free_names(docs, "words", "key", "n", *[f"p_{c}" for c in plan.columns], *[f"s_{c}" for c in ids])
    of_plan, of_several = dict(zip(plan.columns, own)), dict(zip(ids, own[len(plan.columns) :]))
    plan = plan.withColumnsRenamed(of_plan)
    same = lambda other: F.col("doc_id").eqNullSafe(F.col(other["doc_id"])) & F.col("source").eqNullSafe(F.col(other["source"])) & (F.col(words) == F.col(other["size"]))
    rows = docs.withColumn(words, word_count(F.col("text")))
    several = saved(plan.filter(F.col(of_plan["number"]) == 2).select(*[F.col(of_plan[c]).alias(of_several[c]) for c in ids]))
    if several.isEmpty():
        rows = rows.withColumn(n, F.lit(1).cast("long"))
    else:
        order = Window.partitionBy("doc_id", "source", words).orderBy(key)
        again = rows.withColumn(key, row_key(docs)).join(several, same(of_several), "left_semi").withColumn(n, F.row_number().over(order).cast("long")).drop(key)
        rows = rows.join(several, same(of_several), "left_anti").withColumn(n, F.lit(1).cast("long")).unionByName(again)
    met = rows.join(plan.filter(F.col(of_plan["copies"]) > 0), same(of_plan) & (F.col(n) == F.col(of_plan["number"])))
    return met.select(*[f"`{c}`" for c in kept], *[F.col(of_plan[c]).alias(c) for c in added])


def free_given(docs: DataFrame, name: str) -> str:
    """The name that a column of the documents takes where its own is given to a result."""
    name = f"given_{name}"
    while name in docs.columns:
        name = f"given_{name}"
    return name


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
