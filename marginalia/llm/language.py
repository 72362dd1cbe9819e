"""Language identification: a bidirectional gated recurrent network over UTF-8 bytes.

Texts are cut into segments of SEGMENT bytes, the network labels every byte position from both sides, and a document's
probabilities are the mean over all of its positions. It is trained in numpy by backpropagation through time on
segments of a bounded sample of labelled documents, PER_LANGUAGE of each language, drawn by a hash of their id.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if no labelled row can be
learned from; a null doc_id is never held out; repeated rows get equal results; an empty table gives no rows; very long
texts are scored in full, segment by segment; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import discard, held_out, pieces, row_key, saved, unit

UND = "und"
#: Sampled documents of each language, on average, and segments taken of each. All languages that rows name are learned.
PER_LANGUAGE, PIECES = 600, 2
SEGMENT, TRAIN_BYTES, HIDDEN = 128, 64, 8
#: Segments that go through the network side by side.
SIDE_BY_SIDE = 2048
PAD = 256


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 8):
        r = np.random.default_rng(seed)
        self.classes, c = classes, len(classes)
        self.p = {}
        for d in "fb":
            self.p["t" + d] = r.normal(0, 0.5, (3 * HIDDEN, 256)).astype(np.float32)
            self.p["u" + d] = r.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)
            self.p["v" + d] = r.normal(0, HIDDEN**-0.5, (c, HIDDEN)).astype(np.float32)
        self.p["bias"] = np.zeros((c, 1), np.float32)

    def positions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Probabilities (T, classes, N) for byte ids (T, N)."""
        p, out, saved = self.p, self.p["bias"], []
        for d in "fb":
            table = np.concatenate((p["t" + d], gru.pad_column(HIDDEN)[:, None]), axis=1)
            states, caches = gru.run(table, p["u" + d], ids, d == "b", keep)
            out = out + np.matmul(p["v" + d], states)
            saved.append((states, caches))
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out, saved

    def fit(self, ids: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 192, seed: int = 8) -> None:
        r, adam = np.random.default_rng(seed), gru.Adam(self.p, 0.02)
        pools = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        for s in range(steps):
            at = np.concatenate([r.choice(pool, -(-batch // len(pools))) for pool in pools])
            x = ids[:, at]
            valid = (x != PAD)[:, None, :]
            probs, saved = self.positions(x, keep=True)
            probs[:, y[at], np.arange(len(at))] -= 1
            g = probs * (valid / max(1, valid.sum()))
            grads = {"bias": g.sum(axis=(0, 2))[:, None]}
            for d, (states, caches) in zip("fb", saved):
                grads["v" + d] = np.einsum("tcn,thn->ch", g, states, optimize=True)
                grads["u" + d], d_a = gru.backward(self.p["u" + d], x, caches, np.matmul(self.p["v" + d].T, g), d == "b")
                table = np.zeros((PAD + 1, 3 * HIDDEN), np.float32)
                np.add.at(table, x.ravel(), d_a.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
                grads["t" + d] = table[:PAD].T.copy()
            adam.step(grads, 1.0 - 0.9 * s / steps)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean position probabilities (documents, classes) of texts that lie end to end in ``data``."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = offsets[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = offsets[doc + 1] if len(doc) else start
        total = np.zeros((len(sizes), len(self.classes)))
        for i in range(0, len(doc), SIDE_BY_SIDE):
            at = start[i : i + SIDE_BY_SIDE] + np.arange(SEGMENT)[:, None]
            valid = at < end[i : i + SIDE_BY_SIDE]
            ids = np.where(valid, data[np.minimum(at, len(data) - 1)], PAD)
            probs, _ = self.positions(ids)
            probs *= valid[:, None, :]
            sums = probs.sum(axis=0)
            for c in range(len(self.classes)):
                total[:, c] += np.bincount(doc[i : i + SIDE_BY_SIDE], weights=sums[c], minlength=len(sizes))
        return total / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame) -> ByteNet | None:
    """Learns from text and non-null lang of rows that are not held out."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))])
    room = F.greatest(F.length("text") - TRAIN_BYTES, F.lit(0))
    pieces = [F.substr("text", (1 + F.floor(unit(F.lit(80 + i), F.col("key")) * (room + 1))).cast("int"), F.lit(TRAIN_BYTES)) for i in range(PIECES)]
    # drawn row by row, whatever the ids; rows that repeat as a whole count once, so the sample stays bounded
    keyed = rows.select("lang", "text", row_key(docs).alias("key"))
    sample = keyed.filter(unit(F.lit(8), F.col("key")) < share[F.col("lang")]).dropDuplicates(["key"]).select("lang", F.array(*pieces).alias("pieces"))
    got = sorted((r["lang"], piece) for r in sample.collect() for piece in r["pieces"])
    classes = sorted({x for x, _ in got})
    if not classes:
        return None
    net = ByteNet(classes)
    raw = [(piece.encode("utf-8", "replace")[:TRAIN_BYTES]) for _, piece in got]
    ids = np.full((TRAIN_BYTES, len(raw)), PAD, dtype=np.int64)
    for i, piece in enumerate(raw):
        ids[: len(piece), i] = np.frombuffer(piece, dtype=np.uint8)
    net.fit(ids, np.array([classes.index(x) for x, _ in got]))
    return net


def predict(docs: DataFrame, net: ByteNet | None, *keep: str) -> DataFrame:
    """doc_id, the kept columns, lang_pred and score of every document."""
    keep = ("doc_id", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            text = pc.fill_null(batch.column("__text"), "").cast(pa.binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            lettered = batch.column("__lettered").to_pylist()
            if net is None or not len(text):
                lang, score = [UND] * len(text), [0.0] * len(text)
            else:
                probs = net.documents(data, offsets)
                best = probs.argmax(axis=1)
                lang = [net.classes[b] if ok else UND for b, ok in zip(best.tolist(), lettered)]
                score = np.where(lettered, np.minimum(probs[np.arange(len(best)), best], 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lettered")
    schema = "".join(f"`{k}` {t}, " for k in keep for n, t in docs.dtypes if n == k)
    return docs.select(*keep, F.col("text").cast("string").alias("__text"), lettered).mapInArrow(run, f"{schema}lang_pred string, score double")


#: Share of held-out labelled documents that the threshold of the filter may lose, and the bins that a pass over their scores counts.
LOST, BINS = 0.002, 1024


def ranked(scores: DataFrame, rank: int) -> float:
    """The score of that rank, from 0 on, of all rows (score, n: how many have it): bins are counted and the one that holds it is cut again,
    until it holds one score. No pass sends more than BINS rows."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        step = (high - low) / BINS
        at = F.least(F.floor((F.col("score") - low) / step), F.lit(BINS - 1)).alias("bin")
        bins = scores.filter(F.col("score").between(low, high)).groupBy(at).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("n"))
        for b in sorted(bins.collect()):
            low, high = b["low"], b["high"]
            if rank < b["n"]:
                break
            rank -= b["n"]
    return low


def threshold(docs: DataFrame, net: ByteNet) -> float:
    """The score under which a document has no known language: all but LOST of the labelled documents that training did not
    see reach it, whatever the number of languages. All of them are scored. 0 without such documents."""
    rows = docs.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    scores = saved(predict(rows, net).groupBy("score").agg(F.count("*").alias("n")))
    n = scores.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0.0
    place = LOST * (n - 1)
    below = ranked(scores, int(place))
    least = below + (ranked(scores, min(int(place) + 1, n - 1)) - below) * (place - int(place))
    discard(scores)
    return least


def accepted(docs: DataFrame, net: ByteNet | None, least: float | None = None) -> DataFrame:
    """The documents, all columns, whose text has letters and, where a network was learned, some language of at least this
    probability (``threshold`` if none is given). Rows without a lang get the one that was found."""
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    if net is None:
        return lettered
    least = threshold(docs, net) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, batch_text):
            text = batch.column(batch_text).cast(pa.binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            probs = net.documents(np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8), offsets)
            lang = pc.fill_null(batch.column(batch_lang), pa.array([net.classes[b] for b in probs.argmax(axis=1)], pa.string())) if len(probs) else batch.column(batch_lang)
            yield batch.set_column(batch_lang, batch.schema.field(batch_lang), lang).filter(pa.array(probs.max(axis=1) >= least if len(probs) else [], pa.bool_()))

    batch_text, batch_lang = lettered.columns.index("text"), lettered.columns.index("lang")
    return lettered.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
