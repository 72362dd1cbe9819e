"""Vectors as short codes (product quantization) in exact integer arithmetic, so that any cluster gives the same codes.

A vector is cut into PARTS equal parts and each part becomes the index of its nearest codebook entry. Components become
integers, floor(SCALE * x). Distances come from matrix products in float64 that are exact: integers are split into limbs
so small that no sum of their products reaches 2^53, the products of limbs are put together in int64, and the first least
distance wins.

A round is one pass: each task assigns its vectors, adds up the parts of each entry, and gives back one row for each
(part, entry, position), which Spark sums. Only codebooks, whose size is set by parameters, reach the driver.

Defined cases: rows whose vector is null, or holds null or non-finite components, go. The width is that of the kept row of
least vec_id; rows of another width stay, with null code and error, as do all rows where the width is 0 or no multiple of
the parts. Integers are held between bounds that keep the error of a whole vector below 2^63 (64 components: beyond 46,340
in a component's value). A null vec_id comes last; equal vec_ids go by their components. With fewer rows than entries there
are so many entries. An empty table gives no rows. Null labels are one label; a sum beyond a long is null. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels of which a broadcast holds no more; beyond, sums by label meet the rows in a salted join.
BROADCAST_LABELS = 100_000
#: Slices in which rows of one label meet its sum.
SALT = 64


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as float64 arrays of integers within 2^bits of 0, the i-th to be shifted by i * bits: x is their sum."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for int64 matrices, by BLAS on limbs whose sums of products stay under 2^53; exact where the result fits int64."""
    bits = (52 - max(1, a.shape[1]).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the first of equals, and its squared distance."""
    near = (entries * entries).sum(axis=1) - 2 * products(part, entries)
    at = near.argmin(axis=1)
    return at, near[np.arange(len(at)), at] + (part * part).sum(axis=1)


@dataclass
class Codebooks:
    """entries: int64 (parts, entries, width of a part)."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its columns, index, squared distance) of vectors, part by part."""
        for p, columns in enumerate(np.split(vectors, len(self.entries), axis=1)):
            yield p, columns, *nearest(columns, self.entries[p])


def whole(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows whose vector has nothing null or non-finite, with ``q``: its components as integers."""
    x = F.col(column).cast("array<double>")
    real = F.col(column).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.greatest(F.lit(-float(1 << 31)), F.least(F.lit(float((1 << 31) - 1)), v))
    return df.filter(real).withColumn("q", F.transform(x, lambda v: F.floor(held(v * scale)).cast("int")))


def bounded(vectors: np.ndarray, width: int) -> np.ndarray:
    """Integers held so near to 0 that four times the sum of their squares fits a long."""
    most = math.isqrt(((1 << 63) - 1) // 4 // max(1, width))
    return np.clip(vectors, -most, most)


def _matrices(batches: Iterator[pa.RecordBatch], column: str, width: int, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of a batch, which rows have the width, their vectors as one int64 matrix)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            lists = part.column(column)
            fits = pc.equal(pc.list_value_length(lists), width).to_numpy(zero_copy_only=False).astype(bool)
            flat = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part, fits, bounded(flat.reshape(int(fits.sum()), width), width)


def updated(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, and each entry that has some becomes their floored mean."""
    shape = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for _, _, vectors in _matrices(batches, "q", books.width):
            for p, columns, at, _ in books.assigned(vectors):
                np.add.at(total[p], at, columns)
                count[p] += np.bincount(at, minlength=shape[1])
        p, e, i = np.nonzero(np.broadcast_to(count[:, :, None] > 0, shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, i, total[p, e, i], count[p, e])], names=["p", "e", "i", "total", "n"])

    sums = kept.select("q").mapInArrow(run, "p long, e long, i long, total long, n long").groupBy("p", "e", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for p, e, i, total, n in sums.collect():  # as many rows as the codebooks have numbers
        entries[p, e, i] = int(total) // n
    return Codebooks(entries)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the rows of ``whole``; None where there is nothing to learn from."""
    first = [r["q"] for r in kept.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()]
    width = len(first[0]) if first else 0
    if not width or width % parts:
        return None
    first = [r["q"] for r in kept.filter(F.size("q") == width).select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]
    books = Codebooks(bounded(np.array(first, np.int64), width).reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = updated(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks | None, *keep: str) -> DataFrame:
    """The kept columns with ``code`` (an index of two hex digits a part) and ``error`` (squared distances summed over parts)."""
    fields = {f.name: f for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, fits, vectors in _matrices(batches, "q", books.width if books else 0):
            code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
            if books and len(vectors):
                codes, errors = np.empty((len(vectors), len(books.entries)), np.uint8), np.zeros(len(vectors), np.int64)
                for p, _, at, distance in books.assigned(vectors):
                    codes[:, p] = at
                    errors += distance
                digits = codes.tobytes().hex()
                n = 2 * len(books.entries)
                code[fits] = [digits[i : i + n] for i in range(0, len(digits), n)]
                error[fits] = errors.tolist()
            yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    schema = "".join(f"`{k}` {fields[k].dataType.simpleString()}, " for k in keep) + "code string, error long"
    return kept.select(*keep, "q").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The codes with ``vector``: the entries that they name, end to end, as numbers of the given scale."""
    named = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in part]) for part in books.entries.tolist()])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[named[p][index(p)] for p in range(len(books.entries))]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Rows with the errors of all rows of their label summed. A label may hold any share of the rows: its sum meets them in slices."""
    sums = saved(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))).withColumnRenamed("label", "s_label")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("s_label"))).drop("s_label")
    sums = sums.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int")
    return coded.withColumn("salt", salt).join(sums, F.col("label").eqNullSafe(F.col("s_label")) & (F.col("salt") == F.col("s_salt"))).drop("s_label", "salt", "s_salt")


def query(spark, sf_dir: str) -> DataFrame:
    kept = saved(whole(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "q"))
    books = train(kept)
    coded = saved(encode(kept, books, "vec_id", "label"))
    discard(kept)
    digest = F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def _sql() -> str:
    """Each round as two common table expressions: the nearest entry of every part, and the entries that follow from it."""
    distance = "list_sum(list_transform(list_zip(a.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (select vec_id, p, part, e, dist from (
            select a.vec_id, a.p, a.part, c.e, {distance} dist, row_number() over (partition by a.vec_id, a.p order by {distance}, c.e) n from parts a join c{k} c on c.p = a.p) t where n = 1)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} as materialized (select c.p, c.e, coalesce(m.part, c.part) part from c{k} c left join (
                select p, e, list((s - ((s % n) + n) % n) // n order by i) part from (
                  select p, e, i, cast(sum(part[i]) as bigint) s, count(*) n from (select p, e, part, unnest(range(1, len(part) + 1)) i from a{k}) u group by p, e, i) s group by p, e) m on m.p = c.p and m.e = c.e)""")
    return f"""with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) q from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      parts as materialized (select vec_id, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] part from v cross join (select unnest(range({PARTS})) p) r),
      c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 e, part from parts where vec_id in (select vec_id from v order by vec_id limit {ENTRIES})),
      {', '.join(steps)},
      coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) code, cast(sum(dist) as bigint) error from a{ROUNDS} group by vec_id)
      select v.vec_id, code, error, cast(sum(error) over (partition by v.label) as bigint) label_error,
        (select sha256(string_agg(array_to_string(part, ','), ',' order by p, e)) from c{ROUNDS}) codebooks_sha256 from v join coded c on c.vec_id = v.vec_id"""


SQL = _sql()
