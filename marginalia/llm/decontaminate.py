"""Benchmark decontamination: which documents hold a passage within edit distance of a benchmark item.

Distances count word edits; an item of n words leaks where a passage is within floor(EDITS x n) of it. Documents are read
once, whatever the size of the benchmark, and meet its items in a join:

1. Each distinct item text gets its word pairs and LSH keys. CGK random walks embed it: at every step the walk emits the
   word under its pointer and moves on or stays, as a hash of step, word and repetition says, so that sequences at a small
   edit distance agree in most steps. Bit-sampling LSH keys each walk by SAMPLES of its steps; REPETITIONS walks bring the
   recall for near passages to its target.
2. Three filters of a bounded size (MASK_SLOTS, FILTER_BITS), made by grouped jobs, tell which words, word pairs by item
   length and keys the items have. They may say yes to more, never no to one of them, so they lose nothing; a benchmark
   that fills them makes them weaker, not larger.
3. One pass over the documents takes, for each item length, the item-sized windows as candidates, drops those that a
   q-gram bound excludes (too few adjacent word pairs shared with the items of that length), walks the rest and keeps those
   with COLLISIONS keys that the filter knows, with the stretch of the text about them.
4. The keys of these windows are joined to the items' keys; windows and items that share COLLISIONS of them are verified
   exactly on their words, by dynamic programming of the item against the window's region.

Defined cases: null and empty texts hold nothing; items of fewer than ``min_words`` words are no evidence and are not
searched (with 1 all are: those of under five words allow no edit and are found exactly); repeated items each report;
repeated documents each report; a null doc_id is reported as null; an empty table on either side gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, row_key, saved

EDITS, MIN_WORDS = 0.2, 5
REPETITIONS, SAMPLES, COLLISIONS = 32, 2, 2
#: How far into a walk its sampled steps lie, in steps a word, by repetition in turn: short reaches forgive early edits.
REACHES = (0.25, 0.5, 0.8, 1.2)
#: Bounds of the filters: slots of 64 bits for word pairs, bits for words and for keys. Each is 16 MB at most.
MASK_SLOTS, FILTER_BITS = 1 << 21, 1 << 27
#: Items are broadcast up to so many texts and words of them; beyond it Spark shuffles and splits what is skewed.
BROADCAST_ITEMS, BROADCAST_WORDS = 20_000, 2_000_000
#: Cells of a table of walks or windows that a worker makes at once.
CELLS = 2_400_000
#: Raw words whose numbers a worker remembers.
KNOWN_WORDS = 500_000
#: Up to so many ids of leaking documents are broadcast to drop them; beyond it Spark joins.
BROADCAST_LEAKS = 500_000
_PAIR, _MIX = np.int64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?*#$%&|\"'()[]") or word


def numbered(word: bytes) -> int:
    """A word's number: 63 bits of its hash, never 0. Equal numbers only nominate; what leaks is settled on the words."""
    return xxhash.xxh3_64_intdigest(word) >> 1 or 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def walk_keys(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CGK walks of word numbers rows (n, widest), 0 beyond each size: the LSH keys, (REPETITIONS, n).

    A walk's bit at a step is the parity of the word's hash under a random mask of that step and repetition. Every other
    repetition walks from the end backwards, so that an edit spoils one direction only. Walks of the same size are
    sampled at the same steps.
    """
    rng = np.random.default_rng(5)
    reach = np.resize(np.repeat(REACHES, 2), REPETITIONS)[:, None]
    share = rng.random((SAMPLES, REPETITIONS, 1)) * reach
    salt = rng.integers(1, 1 << 62, (REPETITIONS, 1)).astype(np.uint64)
    steps = int(max(REACHES) * sizes.max()) + 1 if len(rows) else 0
    masks = mix((np.arange(steps, dtype=np.uint64)[:, None] * np.uint64(REPETITIONS) + np.arange(REPETITIONS, dtype=np.uint64) + np.uint64(1)) * _MIX)[:, :, None]
    lanes = max(1, min(1024, CELLS // (REPETITIONS * max(1, steps))))
    out = []
    for i in range(0, len(rows), lanes):
        part, n = rows[i : i + lanes], sizes[i : i + lanes]
        width, lane = rows.shape[1] + 1, np.arange(len(part))
        hashes = np.zeros((2, len(part), width), dtype=np.uint64)  # a walk stays where the sequence has ended
        hashes[0, :, :-1] = np.where(part > 0, mix((part.astype(np.uint64) + np.uint64(7)) * _MIX), np.uint64(1))
        hashes[0][np.arange(width) >= n[:, None]] = 0
        back = n[:, None] - 1 - np.arange(width)
        hashes[1] = np.where(back >= 0, np.take_along_axis(hashes[0], np.maximum(back, 0), axis=1), 0)
        flat = hashes.ravel()
        pointer = (np.arange(REPETITIONS) % 2)[:, None] * (len(part) * width) + lane * width
        walk = np.empty((steps, REPETITIONS, len(part)), dtype=np.uint64)
        for step in range(steps):
            np.take(flat, pointer, out=walk[step], mode="clip")
            pointer += np.bitwise_count(walk[step] & masks[step]) & 1
        at = (share * n).astype(np.int64)
        key = mix(n.astype(np.uint64) * _MIX) ^ salt
        for k in range(SAMPLES):
            key = mix((key + walk[at[k], np.arange(REPETITIONS)[:, None], lane]) * _MIX)
        out.append(key)
    return np.concatenate(out, axis=1) if out else np.empty((REPETITIONS, 0), dtype=np.uint64)


def _shared(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """How many of a window's word pairs are hits, for the window of n words from every start of a text of that size."""
    total = np.concatenate(([0], np.cumsum(hit)))
    begin = np.arange(max(1, size - n + 1))
    return total[np.minimum(begin + n - 1, len(total) - 1)] - total[begin]


def around(values: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value within ``reach`` places of each."""
    padded = np.pad(values, reach, constant_values=-1)
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).max(axis=1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring words' numbers."""
    return a * _PAIR + b * np.int64(0x85EBCA6B) ^ (b >> 3)


def table_of(rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Rows of word numbers as one table, 0 beyond each row's end."""
    out = np.zeros((len(rows), int(sizes.max())), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


class Bits:
    """A set of hashes as bits by their low bits, packed in words of 64: it holds each of them, and may seem to hold others."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.least = packed, np.int64(len(packed) * 64 - 1)

    def __contains__(self, h: int) -> bool:
        return bool(int(self.packed[(h & int(self.least)) >> 6]) >> (h & 63) & 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.least
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Screen:
    """What a worker knows of the items: their lengths and the three filters."""

    def __init__(self, lengths: list[int], mask: np.ndarray, words: Bits, keys: Bits, edits: float = EDITS):
        self.edits, self.lengths, self.mask, self.words, self.keys = edits, sorted(lengths), mask, words, keys
        # lengths up to 1.4 times one another are screened together: the longest's window, the least bound of any
        self.groups: list[tuple[np.uint64, int, int, list[int]]] = []
        left = self.lengths
        while left:
            group = [n for n in left if n <= 1.4 * left[0]]
            left = left[len(group) :]
            bits = np.bitwise_or.reduce([self.bit(n) for n in group])
            self.groups.append((bits, group[-1], min(self.needed(n) for n in group), group))

    @staticmethod
    def bit(n: int) -> np.uint64:
        """The bit of a length in the mask of a pair; lengths that are 64 apart share one."""
        return np.uint64(1 << n % 64)

    def allowed(self, n: int) -> int:
        return int(self.edits * n)

    def needed(self, n: int) -> int:
        """Pairs that a window of n words shares with an item at the allowed distance: each edit breaks two, its shift one more."""
        return max(0, n - 1 - 3 * self.allowed(n))

    def held(self, ids: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring words, the lengths whose items have it."""
        known = ids > 0
        return np.where(known[:-1] & known[1:], self.mask[pair(ids[:-1], ids[1:]) & np.int64(len(self.mask) - 1)], np.uint64(0))

    def suspects(self, texts: list[np.ndarray]) -> np.ndarray:
        """The texts in which some window, as long as the longest item of a group, shares enough pairs with the group. One pass
        over all texts end to end: a window that runs on into the next text can only share more."""
        sizes = np.array([len(t) for t in texts])
        whole = np.concatenate([*texts, np.zeros(self.lengths[-1] + 1, np.int64)])
        held, doc = self.held(whole), np.repeat(np.arange(len(texts)), sizes)
        found = np.zeros(len(texts), dtype=bool)
        for bits, widest, least, _ in self.groups:
            if least <= 0:
                return np.arange(len(texts))
            total = np.concatenate(([0], np.cumsum(held & bits != 0, dtype=np.int32)))
            shared = total[widest - 1 : widest - 1 + len(doc)] - total[: len(doc)]
            found[doc[shared >= least]] = True
        return np.flatnonzero(found)

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of item-sized windows that may be near some item of that length."""
        if len(ids) < self.lengths[0] - self.allowed(self.lengths[0]):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        held = self.held(ids)
        starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for bits, widest, least, group in self.groups:
            if least > 0 and _shared(held & bits != 0, widest, len(ids)).max() < least:
                continue
            for n in group:
                own = held & self.bit(n) != 0
                shared = _shared(own, n, len(ids))
                # a passage begins or ends with a pair of its item; or an edit stands at both its ends, and then no window
                # that begins within the allowed edits of it shares more
                edge = shared == around(shared, self.allowed(n))
                if len(own):
                    edge |= own[: len(shared)] | own[np.minimum(np.arange(len(shared)) + max(0, n - 2), len(own) - 1)] if len(own) >= len(shared) else True
                if n == 1 and not self.allowed(n):  # one word has no pairs, and must be some item's
                    edge = edge & (ids > 0)
                at = np.flatnonzero((shared >= self.needed(n)) & edge)
                starts.append(at)
                lengths.append(np.full(len(at), n))
        return np.concatenate(starts), np.concatenate(lengths)

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, start, length, keys) of the windows that have COLLISIONS keys which the filter knows, with these keys."""
        some = self.suspects(texts)
        found = [self.windows(texts[i]) for i in some.tolist()]
        doc = np.repeat(some, [len(s) for s, _ in found])
        if not len(doc):
            return
        start, size = np.concatenate([s for s, _ in found]), np.concatenate([n for _, n in found])
        at = 0
        while at < len(doc):
            rows = min(8192, max(1, CELLS // int(size[at : at + 8192].max())))
            d, s, n = (x[at : at + rows] for x in (doc, start, size))
            at += rows
            keys = walk_keys(table_of([texts[i][j : j + k] for i, j, k in zip(d.tolist(), s.tolist(), n.tolist())], n), n).view(np.int64)
            known = self.keys.has(keys)
            for k in np.flatnonzero(known.sum(axis=0) >= COLLISIONS).tolist():
                yield int(d[k]), int(s[k]), int(n[k]), keys[known[:, k], k].tolist()

    def stretches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, list[tuple[int, int, list[int]]]]]:
        """(text, first word, word after the last, windows in it): the windows of a text whose regions meet, as one stretch."""
        now: list = []
        for d, s, n, keys in sorted(self.hits(texts)):
            low, high = max(0, s - self.allowed(n)), min(len(texts[d]), s + n + self.allowed(n))
            if now and now[0] == d and low <= now[2]:
                now[1], now[2] = min(now[1], low), max(now[2], high)
                now[3].append((s, n, keys))
                continue
            if now:
                yield tuple(now)
            now = [d, low, high, [(s, n, keys)]]
        if now:
            yield tuple(now)


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least number of word edits between the item and any passage of the region, and where that passage ends."""
    step = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for i, word in enumerate(item.tolist(), 1):
        turn = np.empty_like(row)
        turn[0] = i
        turn[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(turn - step) + step
    return int(row.min()), int(row.argmin())


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, item_id, item_words, edits, similarity, end_word), a row for each document and item that leaks into it."""
    kind = dict(docs.dtypes)
    own = ["doc_id", *keep]
    named = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("t", F.md5("text"))
    texts = named.groupBy("t").agg(F.first("text").alias("text"))
    items = saved(texts.mapInArrow(_items(min_words), "t string, n int, item array<string>, words array<bigint>, pairs array<bigint>, keys array<bigint>"))
    count, size = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = count <= BROADCAST_ITEMS and size <= BROADCAST_WORDS
    small = F.broadcast if few else lambda df: df
    screen = _screen(items, size, count, edits)

    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in own], "__doc bigint, __at int, __words array<string>, __hits array<struct<start: int, n: int, keys: array<bigint>>>"])
    rows = docs.select(*own, F.col("text").cast("string").alias("__text"), F.monotonically_increasing_id().alias("__doc"))
    parts = saved(rows.mapInArrow(_finder(screen, [*own, "__doc"]), schema))

    windows = parts.select("__doc", "__at", F.explode("__hits").alias("hit")).select("__doc", "__at", "hit.start", "hit.n", F.explode("hit.keys").alias("key"))
    keys = items.select("t", "n", F.explode("keys").alias("key"))
    met = windows.join(small(keys), ["key", "n"]).groupBy("__doc", "__at", "t", "n", "start").count().filter(F.col("count") >= COLLISIONS)
    # neighbouring starts of an item in a stretch are one region
    order = Window.partitionBy("__doc", "__at", "t").orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("start").over(order) > F.col("n"), F.lit(True)).cast("int")
    regions = met.withColumn("fresh", fresh).withColumn("region", F.sum("fresh").over(order)).groupBy("__doc", "__at", "t", "region").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = regions.join(small(items.select("t", "n", "item")), "t").join(parts.drop("__hits"), ["__doc", "__at"])
    most = F.floor(F.lit(float(edits)) * F.col("n")).cast("int")
    begin = F.greatest(F.lit(0), F.col("first") - most)
    near = near.select(*own, "__doc", "t", "n", "item", begin.alias("begin"), F.slice("__words", begin - F.col("__at") + 1, F.col("last") + F.col("n") + most - begin).alias("region"))
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in own], "__doc bigint, t string, n int, edits int, end int"])
    best = near.mapInArrow(_verifier(edits, [*own, "__doc", "t", "n"]), schema)
    best = best.groupBy("__doc", "t").agg(*[F.first(c).alias(c) for c in [*own, "n"]], F.min(F.struct("edits", "end")).alias("best"))
    out = best.join(named.select("t", "item_id"), "t")
    return out.select(*own, "item_id", F.col("n").alias("item_words"), "best.edits", (1 - F.col("best.edits") / F.col("n")).alias("similarity"), F.col("best.end").alias("end_word"))


def _slots(hashes: int, most: int) -> int:
    """A power of two that gives each hash 32 slots, as far as the bound goes."""
    return min(most, 1 << max(12, math.ceil(math.log2(32 * max(1, hashes)))))


def _screen(items: DataFrame, size: int, count: int, edits: float) -> Screen:
    """The filters over all items: grouped by slot on the executors, so that the driver gets one row a slot at most."""
    slots = _slots(size, MASK_SLOTS)
    rows = items.select("n", F.explode("pairs").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("slot"))
    mask = _array(rows.agg(F.bit_or(F.expr("shiftleft(1L, n % 64)")).alias("bits")), slots)
    lengths = [r[0] for r in items.select("n").distinct().collect()]
    return Screen(lengths, mask, _bits(items, "words", size), _bits(items, "keys", count * REPETITIONS), edits)


def _bits(items: DataFrame, column: str, hashes: int) -> Bits:
    slots = _slots(hashes, FILTER_BITS)
    at = F.col("h").bitwiseAND(F.lit(slots - 1))
    rows = items.select(F.explode(column).alias("h")).groupBy(F.shiftright(at, 6).alias("slot"))
    return Bits(_array(rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")), slots // 64))


def _array(rows: DataFrame, slots: int) -> np.ndarray:
    got, out = rows.toArrow(), np.zeros(slots, dtype=np.int64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _items(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            split = [(t, [bare(w) for w in words_of(x)]) for t, x in zip(batch.column("t").to_pylist(), batch.column("text").to_pylist())]
            split = [(t, w) for t, w in split if len(w) >= max(1, min_words)]
            rows = [np.array([numbered(w) for w in ws], dtype=np.int64) for _, ws in split]
            # one text at a time, so that a long one does not widen the table of all
            keys = [walk_keys(row[None, :], np.array([len(row)])).view(np.int64)[:, 0] for row in rows]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in split], pa.string()),
                    pa.array([len(r) for r in rows], pa.int32()),
                    pa.array([[w.decode() for w in ws] for _, ws in split], pa.list_(pa.string())),
                    pa.array([np.unique(r) for r in rows], longs),
                    pa.array([np.unique(pair(r[:-1], r[1:])) for r in rows], longs),
                    pa.array(keys, longs),
                ],
                names=["t", "n", "item", "words", "pairs", "keys"],
            )

    return run


def _finder(screen: Screen, own: list[str]):
    hit = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(screen.words)
        for batch in pieces(batches, "__text"):
            if len(memo) > KNOWN_WORDS:
                memo = Memo(screen.words)
            split = [words_of(t) for t in batch.column("__text").to_pylist()]
            texts = [np.array(list(map(memo.__getitem__, ws)), dtype=np.int64) for ws in split]
            found = list(screen.stretches(texts)) if screen.lengths and texts else []
            at = pa.array([d for d, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(at) for c in own],
                    pa.array([low for _, low, _, _ in found], pa.int32()),
                    pa.array([[bare(w).decode() for w in split[d][low:high]] for d, low, high, _ in found], pa.list_(pa.string())),
                    pa.array([[{"start": s, "n": n, "keys": keys} for s, n, keys in hits] for *_, hits in found], hit),
                ],
                names=[*own, "__at", "__words", "__hits"],
            )

    return run


def _verifier(edits: float, own: list[str]):
    """Keeps the regions that hold a passage within the allowed edits of their item, compared word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[int, int, int]] = []
            columns = [batch.column(c) for c in ("item", "region", "begin")]
            for k in range(batch.num_rows):
                item, region, begin = (c[k].as_py() for c in columns)
                most, number = int(edits * len(item)), {}
                words, place = (np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64) for ws in (item, region))
                if len(words) - np.isin(words, place).sum() > most:
                    continue
                away, end = nearest(words, place)
                if away <= most:
                    kept.append((k, away, begin + end))
            at = pa.array([k for k, _, _ in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in own], pa.array([e for _, e, _ in kept], pa.int32()), pa.array([e for *_, e in kept], pa.int32())],
                names=[*own, "edits", "end"],
            )

    return run


class Memo(dict):
    """Raw word to its number, 0 if it is surely none of the items' words."""

    def __init__(self, known: Bits):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> int:
        h = numbered(bare(word))
        self[word] = out = h if h in self.known else 0
        return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that no item leaks into, all columns. A row is known by its doc_id and a hash of all of its columns, so
    rows without an id, or that repeat one, stay or go by their own texts."""
    keyed = docs.withColumn("__row", row_key(docs))
    found = saved(leaks(keyed, benchmark, edits, min_words, keep=("__row",)).select("doc_id", "__row").distinct())
    found = found.withColumnsRenamed({"doc_id": "__leak_id", "__row": "__leak_row"})
    same = F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.col("__row") == F.col("__leak_row"))
    return keyed.join(F.broadcast(found) if found.count() <= BROADCAST_LEAKS else found, same, "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark)
