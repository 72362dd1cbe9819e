"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input joins a trained vector of its hash with the mean of trained vectors of its runs of characters, so that
unseen forms of a known stem are read too. The network runs over every overlapping window of WINDOW words (one starts
every STRIDE words), attention pools a window's states into one logit, and a document's score is the calibrated logit of
its most toxic window: a long text is as toxic as its worst passage.

Training, in numpy by backpropagation through time, is on whole texts of a bounded sample of labelled documents that are
not held out. Only documents carry labels, so the windows to learn from are chosen: first by summed log-odds of their
words and character runs in the sample (which also start the vectors), then, twice, by the network itself. Scores are then
calibrated (Platt) on a part of the sample that training did not see.

Defined cases: null and empty texts are one window of padding and get the network's score for it; without labels of both
kinds every score is the share of toxic labels (0 if there are none); a null doc_id is never held out; labels of one
document that disagree count each; repeated rows get equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import held_out, pieces, unit

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_SLOTS, CHAR_SLOTS = 1 << 16, 1 << 16
#: Lengths of the byte runs that a word is read by; every word with its two ends has one of the first.
GRAMS = (3, 5)
#: Labelled documents of each class that training takes, on average, and windows of a document without toxic label.
PER_CLASS, CLEAN_WINDOWS = 1500, 4
#: Updates of each of the three rounds of training, on 128 windows, about.
STEPS = 150
SIDE_BY_SIDE = 2048
#: Words whose projections a worker keeps; beyond it the store starts anew.
KNOWN_WORDS = 200_000
THRESHOLD = 0.3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?*#$%&|\"'()[]") or word


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots (n), slots of the words' runs of GRAMS bytes word by word, and where each word's runs start."""
    clean = [b"<" + bare(w) + b">" for w in words]
    slots = np.array([xxhash.xxh32_intdigest(w) for w in clean], dtype=np.int64) % WORD_SLOTS
    sizes = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
    data = np.frombuffer(b"".join(clean), dtype=np.uint8).astype(np.uint64)
    word, place = np.repeat(np.arange(len(clean)), sizes), np.arange(len(data))
    left = np.repeat(np.cumsum(sizes), sizes) - place  # bytes of the word from here on
    owners, grams = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) ^ data[at + k]
        value *= np.uint64(0x9E3779B97F4A7C15)
        owners.append(word[at])
        grams.append((value >> np.uint64(40)).astype(np.int64) % CHAR_SLOTS)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(clean))
    return slots, np.concatenate(grams)[order], np.cumsum(counts) - counts


class Vocabulary:
    """Numbers words as they come and holds their features; 0 is padding."""

    def __init__(self):
        self.number, self.words = {}, []

    def ids(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
                self.words.append(w)
        return np.array([number[w] for w in words], dtype=np.int32)


def window_ids(ids: np.ndarray) -> np.ndarray:
    """(WINDOW, windows): the word numbers of every overlapping window, the last one padded with 0; one window at least."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros(WINDOW + STRIDE * (n - 1), dtype=ids.dtype)
    padded[: len(ids)] = ids
    return padded[np.arange(WINDOW)[:, None] + STRIDE * np.arange(n)]


class TextNet:
    def __init__(self, seed: int = 7):
        r, f, d = np.random.default_rng(seed), np.float32, WORD_DIM + CHAR_DIM
        self.p = {"word": r.normal(0, 0.05, (WORD_SLOTS, WORD_DIM)).astype(f), "char": r.normal(0, 0.05, (CHAR_SLOTS, CHAR_DIM)).astype(f)}
        for side in "fb":
            self.p["w" + side] = r.normal(0, d**-0.5, (3 * HIDDEN, d)).astype(f)
            self.p["i" + side] = np.zeros((3 * HIDDEN, 1), f)
            self.p["u" + side] = r.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(f)
        self.p["attend"], self.p["out"] = r.normal(0, 0.3, 2 * HIDDEN).astype(f), r.normal(0, 0.3, 2 * HIDDEN).astype(f)
        self.p["bias"] = np.zeros(1, f)
        self.scale, self.shift, self.base = 1.0, 0.0, None

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """(n, dim) vectors of words, word part then character part."""
        slots, grams, starts = features(words)
        counts = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / counts[:, None]
        return np.concatenate((self.p["word"][slots], chars), axis=1).astype(np.float32), (slots, grams, counts)

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Each side's (3H, 1 + n) table: padding, then the words."""
        return {s: np.concatenate((gru.pad_column(HIDDEN)[:, None], self.p["w" + s] @ x.T + self.p["i" + s]), axis=1).astype(np.float32) for s in "fb"}

    def logits(self, tables: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        runs = [gru.run(tables[s], self.p["u" + s], ids, s == "b", keep) for s in "fb"]
        states = np.concatenate([r[0] for r in runs], axis=1)
        e = np.exp(np.clip(np.matmul(self.p["attend"], states), -30, 30)) * (ids > 0)
        e /= np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,thn->hn", e, states, optimize=True)
        return self.p["out"] @ pooled + self.p["bias"][0], (runs, states, e, pooled)

    def gradients(self, x: np.ndarray, made: tuple, tables: dict, ids: np.ndarray, g: np.ndarray, saved: tuple) -> dict[str, np.ndarray]:
        (slots, grams, counts), (runs, states, e, pooled) = made, saved
        out = {"out": pooled @ g, "bias": np.array([g.sum()], np.float32)}
        d_pooled = np.outer(self.p["out"], g)
        d_e = np.einsum("hn,thn->tn", d_pooled, states, optimize=True)
        d_score = e * (d_e - (e * d_e).sum(axis=0))
        out["attend"] = np.einsum("tn,thn->h", d_score, states, optimize=True)
        d_states = (e[:, None] * d_pooled + d_score[:, None] * self.p["attend"][:, None]).astype(np.float32)
        d_x = np.zeros_like(x)
        for k, (side, run) in enumerate(zip("fb", runs)):
            out["u" + side], d_a = gru.backward(self.p["u" + side], ids, run[1], d_states[:, k * HIDDEN : (k + 1) * HIDDEN], side == "b")
            table = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            np.add.at(table, ids.ravel(), d_a.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
            out["w" + side], out["i" + side] = table[1:].T @ x, table[1:].sum(0)[:, None]
            d_x += table[1:] @ self.p["w" + side]
        out["word"], out["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(out["word"], slots, d_x[:, :WORD_DIM])
        np.add.at(out["char"], grams, np.repeat(d_x[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return out

    def step(self, adam: gru.Adam, words: list[bytes], ids: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One update on windows ids (WINDOW, n) whose word numbers point into ``words`` from 1 on."""
        used, ids = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
        ids = ids[:-1].reshape(WINDOW, -1)
        x, made = self.inputs([words[i - 1] for i in used[1:].tolist()])
        tables = self.projections(x)
        logit, saved = self.logits(tables, ids, keep=True)
        g = (weight * (1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        adam.step(self.gradients(x, made, tables, ids, g, saved), rate)

    def fit(self, texts: Iterable[list[bytes]], y: np.ndarray, seed: int = 7) -> None:
        """Whole texts as word lists, read once and kept as numbers, and their labels."""
        r, vocabulary = np.random.default_rng(seed), Vocabulary()
        ids = [vocabulary.ids(t) for t in texts]
        words = vocabulary.words
        held = np.arange(len(y)) % 5 == 4
        if min((y[held] > 0).sum(), (y[held] == 0).sum(), (y[~held] > 0).sum(), (y[~held] == 0).sum()) < 1:
            held[:] = False
        learn = np.flatnonzero(~held)
        slots, grams, starts = features(words)
        odds = self.log_odds([ids[i] for i in learn], y[learn], slots, grams, starts)
        views = [window_ids(i) for i in ids]
        adam = gru.Adam(self.p, 0.01)
        top = [int(np.append(0.0, odds)[v].sum(axis=0).argmax()) for v in views]
        for phase in range(3):
            if phase:
                top = [int(s.argmax()) for s in self.window_logits(words, views)]
            cols, label = [], []
            for i in learn:
                some = {top[i]}
                if not y[i]:
                    some |= set(r.integers(0, views[i].shape[1], CLEAN_WINDOWS - 1).tolist())
                cols += [views[i][:, k] for k in sorted(some)]
                label += [y[i]] * len(some)
            x, label = np.stack(cols, axis=1), np.array(label, dtype=np.float32)
            weight = np.where(label > 0, 0.5 * len(label) / max(1, label.sum()), 0.5 * len(label) / max(1, len(label) - label.sum())).astype(np.float32)
            for epoch in range(max(1, min(20, -(-STEPS * 128 // len(label))))):
                order = r.permutation(len(label))
                for at in range(0, len(order), 128):
                    b = order[at : at + 128]
                    self.step(adam, words, x[:, b], label[b], weight[b], 1.0 if phase < 2 else 0.4)
        test = np.flatnonzero(held) if held.any() else learn
        self.calibrate(np.array([s.max() for s in self.window_logits(words, [views[i] for i in test])]), y[test])

    def log_odds(self, ids: list[np.ndarray], y: np.ndarray, slots: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Starts one dimension of the word and character vectors with their document log-odds; returns each word's sum of both."""
        counts = np.diff(np.append(starts, len(grams)))

        def odds(keys_of: list[np.ndarray], n_slots: int) -> np.ndarray:
            seen = np.zeros((2, n_slots))
            for keys, label in zip(keys_of, y):
                seen[int(label > 0), np.unique(keys)] += 1
            n = np.array([[max(1, (y == 0).sum())], [max(1, (y > 0).sum())]])
            rate = (seen + 0.5) / (n + 1)
            total = seen.sum(axis=0)
            # two standard errors nearer to nought, so that a word of few documents, as most of these are, tells little
            odds, error = np.log(rate[1] / rate[0]), 2 * np.sqrt((1 / (seen + 0.5)).sum(axis=0))
            return np.where(total > 1, np.clip(np.sign(odds) * np.maximum(np.abs(odds) - error, 0), -1, 4), 0).astype(np.float32)

        grams_of = lambda i: np.concatenate([grams[starts[k - 1] : starts[k - 1] + counts[k - 1]] for k in np.unique(i)]) if len(i) else np.empty(0, np.int64)
        by_word, by_gram = odds([slots[i - 1] for i in ids], WORD_SLOTS), odds([grams_of(i) for i in ids], CHAR_SLOTS)
        self.p["word"][:, 0], self.p["char"][:, 0] = by_word, by_gram
        return by_word[slots] + np.add.reduceat(by_gram[grams], starts) / counts

    def window_logits(self, words: list[bytes], views: list[np.ndarray]) -> list[np.ndarray]:
        tables = self.projections(self.inputs(words)[0])
        out: list[np.ndarray] = []
        for at in range(0, len(views), 64):
            some = views[at : at + 64]
            every = np.concatenate(some, axis=1)
            flat = np.concatenate([self.logits(tables, every[:, i : i + SIDE_BY_SIDE])[0] for i in range(0, every.shape[1], SIDE_BY_SIDE)])
            out += np.split(flat, np.cumsum([v.shape[1] for v in some])[:-1])
        return out

    def calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        spread = max(1e-3, float(np.abs(logit).max()))
        z, a, b = logit / spread, 1.0, 0.0
        for _ in range(3000):
            e = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 1.0 * float((e * z).mean()), b - 1.0 * float(e.mean())
        self.scale, self.shift = a / spread, b

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -60, 60)))


class Scorer:
    """Scores batches of texts in one worker and remembers the projections of words it has met."""

    def __init__(self, net: TextNet):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.number = {}
        self.tables = {s: np.concatenate((gru.pad_column(HIDDEN)[:, None], np.zeros((3 * HIDDEN, 1 << 14), np.float32)), axis=1) for s in "fb"}

    def learn(self, words: set[bytes]) -> None:
        new = sorted(w for w in words if w not in self.number)
        if not new:
            return
        at = len(self.number) + 1
        for i, w in enumerate(new, at):
            self.number[w] = i
        made = self.net.projections(self.net.inputs(new)[0])
        for s in "fb":
            room = self.tables[s].shape[1]
            if at + len(new) > room:
                self.tables[s] = np.concatenate((self.tables[s], np.zeros((3 * HIDDEN, max(room, len(new))), np.float32)), axis=1)
            self.tables[s][:, at : at + len(new)] = made[s][:, 1:]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.number) > KNOWN_WORDS:
            self.forget()
        self.learn(set().union(*split))
        number = self.number
        views = [window_ids(np.array([number[w] for w in ws], dtype=np.int64)) for ws in split]
        every = np.concatenate(views, axis=1)
        logit = np.concatenate([self.net.logits(self.tables, every[:, i : i + SIDE_BY_SIDE])[0] for i in range(0, every.shape[1], SIDE_BY_SIDE)])
        starts = np.cumsum([0] + [v.shape[1] for v in views])[:-1]
        return self.net.score(np.maximum.reduceat(logit, starts))


def train(docs: DataFrame, labels: DataFrame) -> TextNet | float:
    """A network, or the share of toxic labels where one class is missing."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return float(1 in n)
    rate = F.when(F.col("toxic") == 1, min(1.0, PER_CLASS / n[1])).otherwise(min(1.0, 2 * PER_CLASS / n[0]))
    marks = marks.filter(unit(F.lit(7), F.col("doc_id")) < rate)
    # the sample is bounded by PER_CLASS, so it is sent to the texts rather than the texts to it
    # and so is what comes back: of rows that repeat an id, one text is learnt
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(one).collect()
    got = sorted(((zlib.crc32(f"{r['doc_id']}".encode()), r["doc_id"], r["toxic"], r["text"] or "") for r in got), key=lambda x: x[:3])
    y = np.array([x[2] for x in got], dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.0
    net = TextNet()
    net.fit((words_of(x[3]) for x in got), y)
    # the sample holds the classes in other shares than the labels do; the shift sets the odds right
    return corrected(net, y.mean(), n[1] / (n[0] + n[1]))


def corrected(net: TextNet, sampled: float, actual: float) -> TextNet:
    net.shift += float(np.log(actual / (1 - actual)) - np.log(sampled / (1 - sampled)))
    return net


def score(docs: DataFrame, net: TextNet | float) -> DataFrame:
    """(doc_id, score) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            if isinstance(net, float):
                out = [net] * len(texts)
            else:
                scorer = scorer or Scorer(net)
                out = scorer(texts).tolist() if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs.select("doc_id", "text"), labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
