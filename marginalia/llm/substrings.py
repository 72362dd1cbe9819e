"""Exact substring dedup over words by level-wise doubling.

A window is ``length`` consecutive words. Words covered by a window whose word sequence also starts in a document with
a smaller doc_id are removed. Windows are found by doubling: sequences of ``start`` words that repeat across documents
survive, then of twice as many words, and so on until nothing survives or the sequences are ``length`` long. At each
level every window that is still a candidate is represented by one of its sequences, the first with the least hash (its upper bits): copies
of a window pick the same one, so none is missed, and neighbouring windows mostly share theirs, so a few sequences stand
for all. A window goes on only where its sequence repeats. Sequences are told apart by 64 bits on the way, where two that
meet by chance only go on for nothing; at the last level, which decides what is removed, by 128 bits made from 128-bit hashes of the words.

At each level an aggregate finds the hashes that occur in two documents (minima and maxima, so a very common sequence is
one row a task), and a join marks their places, which Spark splits where one hash is hot. Only hashes and positions are
shuffled between levels; texts are joined once a level to hash the survivors, and once to cut the words out. Workers take
the texts of a batch together, so that a word they share is hashed once. The last level, the largest, is judged in parts by hash, one after another.

Defined cases: null, empty and short texts have no window and stay whole; a null doc_id counts as larger than any other;
rows without an id, or that repeat one, are not held against each other, but each text is judged by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, saved

LENGTH = 13
START = 4
#: Up to so many repeated ids are sent to every executor; beyond it Spark joins them.
BROADCAST_IDS = 500_000
#: Bits of a word's place in texts of up to so many words; longer ones are searched window by window, to the same places.
PLACE_BITS = 24
#: The last level, whose windows are the most, is judged in so many parts by hash, one after another: so much less is shuffled at a time.
PARTS = 2
NO_ID = (1 << 63) - 1
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def level_lengths(length: int, start: int = START) -> list[int]:
    """Doubling lengths up to the window's."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Words:
    """The words of a column of texts, one after another: ``first`` and ``last`` are the places of each text's first word and past its
    last, ``text`` is each word's text."""

    def __init__(self, texts: pa.Array):
        # Arrow divides at the space and the five ASCII controls alone, as the word rule asks, and leaves empty strings between two of them
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        full = pc.greater(pc.binary_length(lists.flatten()), 0)
        self.words = lists.flatten().filter(full)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))]
        self.first, self.last = ends[:-1], ends[1:]
        self.text = np.repeat(np.arange(len(texts)), self.last - self.first)
        self._coded = None

    def __len__(self) -> int:
        return len(self.words)

    def hashes(self, of) -> np.ndarray:
        """``of`` the words; each different one is hashed once."""
        if self._coded is None:
            self._coded = self.words.dictionary_encode()
        distinct = self._coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        return of(distinct)[self._coded.indices.to_numpy()]

    def starts(self, length: int) -> np.ndarray:
        """Where windows of ``length`` words start, all of them of one text."""
        at = np.arange(len(self))
        return at[at + length <= self.last[self.text]]

    def places(self, lists: pa.Array) -> np.ndarray:
        """Lists of places within each text (null: none) as places among all words."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        return lists.flatten().to_numpy() + np.repeat(self.first, counts)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)


def second_hashes(words: list[bytes]) -> np.ndarray:
    """64 more bits of every word, which hang together with ``word_hashes`` in nothing but the word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def window_hashes(hashes: np.ndarray, length: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out *= base
        out += hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def picked(hashes: np.ndarray, span: int) -> np.ndarray:
    """Of every ``span`` neighbours, the place of the first that is least in the bits above PLACE_BITS, for each window in turn."""
    n, high = len(hashes) - span + 1, hashes >> np.uint64(PLACE_BITS)
    if len(hashes) > 1 << PLACE_BITS:
        return np.arange(n) + np.lib.stride_tricks.sliding_window_view(high, span).argmin(axis=1)
    # a hash's upper bits with its place below them: the least of a window is that of two halves, which may overlap
    best, width = high << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        best, width = np.minimum(best[step:], best[:-step]), width + step
    return (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def distinct(places: np.ndarray) -> np.ndarray:
    """Each once, of places in ascending order, as those that ``picked`` gives are."""
    return places[np.diff(places, prepend=-1) > 0]


def _rows(batch: pa.RecordBatch, words: Words, hashes: np.ndarray, at: np.ndarray, length: int | None) -> pa.RecordBatch:
    """The sequences that start ``at`` these places; with a length, their second hashes too."""
    text = words.text[at]
    doc, row = (batch.column(i).to_numpy()[text] for i in (0, 1))
    second = pa.array(window_hashes(words.hashes(second_hashes), length, _OTHER)[at].view(np.int64)) if length else pa.nulls(len(at), pa.int64())
    places = (at - words.first[text]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(doc), pa.array(row), pa.array(places), second], names=["hash", "doc", "row", "at", "second"])


ROWS = "hash long, doc long, row long, at int, second long"


def first_rows(batch: pa.RecordBatch, seed: int, length: int) -> pa.RecordBatch:
    """``first_level`` of a batch, all of whose texts are worked on at once."""
    words = Words(batch.column(2))
    starts = words.starts(length)
    hashes = window_hashes(words.hashes(word_hashes), seed) if len(starts) else np.empty(0, dtype=np.uint64)
    at = distinct(picked(hashes, length - seed + 1)[starts]) if len(starts) else starts
    return _rows(batch, words, hashes, at, seed if seed == length and len(at) else None)


def next_rows(batch: pa.RecordBatch, short: int, long: int, length: int) -> pa.RecordBatch:
    """``next_level`` of a batch, all of whose texts are worked on at once."""
    words = Words(batch.column(2))
    starts, longer = words.starts(length), np.empty(0, dtype=np.uint64)
    if len(starts):
        hashes = words.hashes(word_hashes)
        alive = np.zeros(len(words), dtype=bool)
        alive[words.places(batch.column(3))] = True
        starts = starts[alive[picked(window_hashes(hashes, short), length - short + 1)[starts]]]
        longer = window_hashes(hashes, long)
    at = distinct(picked(longer, length - long + 1)[starts]) if long < length and len(starts) else starts
    return _rows(batch, words, longer, at, long if long == length and len(at) else None)


def first_level(texts: DataFrame, seed: int, length: int) -> DataFrame:
    """(doc, row, text) to (hash, doc, row, at, second): the sequences of ``seed`` words that stand for windows of ``length``; their second
    hashes where they are the windows themselves."""
    return texts.mapInArrow(lambda batches: (first_rows(b, seed, length) for b in pieces(batches, 2)), ROWS)


def next_level(texts: DataFrame, short: int, long: int, length: int) -> DataFrame:
    """(doc, row, text, places of surviving sequences of ``short`` words) to (hash, doc, row, at, second): the sequences of ``long`` words
    that stand for those windows of ``length`` whose short sequence survived; their second hashes where they are the windows themselves."""
    return texts.mapInArrow(lambda batches: (next_rows(b, short, long, length) for b in pieces(batches, 2)), ROWS)


def repeated_places(windows: DataFrame, later: bool) -> DataFrame:
    """(hash, doc, row, at, second) to a table (doc, row, places): those of hashes in two documents; with ``later``, at the last level, those
    of both hashes together, and not those in a sequence's first document."""
    keys = ["hash", "second"] if later else ["hash"]
    # kept as a table, so that both sides of the join are plain shuffles, whose hot partitions Spark can split
    twice = saved(windows.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select(*keys, "low"))
    met = windows.join(twice, keys)
    if later:
        met = met.filter("doc > low")
    places = saved(met.groupBy("doc", "row").agg(F.collect_set("at").alias("places")))
    discard(twice)
    return places


def with_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, row): doc orders documents; doc and row name a text. row is 0 but where several rows may have the doc."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    many = saved(rows.filter(F.col("doc") != NO_ID).groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("many")))
    n = many.count()
    rows = rows.join(F.broadcast(many) if n <= BROADCAST_IDS else many, "doc", "left") if n else rows.withColumn("many", F.lit(False))
    several = F.coalesce("many", F.lit(False)) | (F.col("doc") == NO_ID)
    return rows.select("doc_id", "text", "doc", F.when(several, F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("row"))


def places_of_repeats(rows: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """Of ``with_rows``, (doc, row, places): starts of windows that a smaller doc_id has too."""
    texts = rows.select("doc", "row", "text")
    lengths = level_lengths(length, start)
    windows = saved(first_level(texts, lengths[0], length))
    for short, long in zip(lengths, lengths[1:]):
        alive = repeated_places(windows, later=False)
        if alive.isEmpty():
            return alive
        # a level's tables go as soon as what is made of them is a table
        discard(windows)
        windows = saved(next_level(texts.join(alive, ["doc", "row"]), short, long, length))
        discard(alive)
    parts = [repeated_places(windows.filter(F.pmod("hash", F.lit(PARTS)) == k), later=True) for k in range(PARTS)]
    discard(windows)
    return reduce(DataFrame.unionByName, parts).groupBy("doc", "row").agg(F.flatten(F.collect_list("places")).alias("places"))


def cut(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(doc_id, text, places) to (doc_id, n_words, n_removed, kept)."""
    words = Words(batch.column(1))
    at, n = words.places(batch.column(2)), len(words) + 1
    stay = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + length, minlength=n))[:-1] == 0
    before = np.concatenate(([0], np.cumsum(stay)))
    offsets = np.append(before[words.first], before[-1]).astype(np.int32)
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.words.filter(pa.array(stay))), " ")
    n_words = words.last - words.first
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_words - np.diff(offsets)), kept], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space."""
    rows = with_rows(docs)
    places = places_of_repeats(rows, length, start)
    kind = dict(docs.dtypes)["doc_id"]
    joined = rows.join(places, ["doc", "row"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(lambda batches: (cut(b, length) for b in pieces(batches, 1)), f"doc_id {kind}, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
