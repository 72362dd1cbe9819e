"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

Three patterns give the base spans, which always stay. Candidates are runs of 16 or more key-like characters, and the
base spans. A convolutional network in numpy (embedding, one convolution, max and mean pooling, one hidden layer) reads
each candidate with its context in overlapping windows and keeps the largest score. It is trained on labelled findings
in a bounded sample of documents. Positive are base findings, once in their context and once with the context blanked,
and keys of shapes that the patterns do not know (``SHAPES``), one set into each sampled text; negative are the texts'
own candidates that no pattern matches, and decoys set into them likewise. Scores are calibrated on a held-out part of
the sample (Platt scaling), and the threshold is the highest that keeps ``RECALL`` of the held-out positives.
Candidates above it that overlap no base span become spans of kind ``model``.

Defined cases: null and empty texts have no spans; a sample without findings, or without other candidates, trains no
network and adds no spans; null, repeated and tied rows are scanned like any other, one result a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, row_key

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Documents of the training sample, about; findings and candidates taken from it at most.
TRAIN_DOCS = 8000
TRAIN_ROWS = 20_000
#: Share of the held-out positive findings that the threshold must keep.
RECALL = 0.98
CONTEXT, WIDTH, STRIDE = 16, 64, 32
EMBED, FILTERS, KERNEL, HIDDEN = 8, 24, 5, 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping within a kind, short matches dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest(text) >= 24:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def longest(text: str) -> int:
    return max(map(len, text.split()), default=0)


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs that overlap no base span."""
    if longest(text) < 16:
        return []
    runs = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    return [(a, b) for a, b in runs if not any(a < e and s < b for s, _, e in base)]


def windows(text: str, start: int, end: int, blank: bool = False) -> list[bytes]:
    """The candidate with CONTEXT characters on both sides, in overlapping windows of WIDTH characters that cover all of it."""
    left, right = text[max(0, start - CONTEXT) : start].rjust(CONTEXT), text[end : end + CONTEXT].ljust(CONTEXT)
    if blank:
        left, right = " " * CONTEXT, " " * CONTEXT
    whole = (left + text[start:end] + right).encode("latin-1", "replace").ljust(WIDTH)
    return [whole[i : i + WIDTH].ljust(WIDTH) for i in range(0, max(1, len(whole) - WIDTH + STRIDE), STRIDE)]


class CharNet:
    """Embedding, convolution, max and mean pooling, hidden layer, logit. Adam on the logistic loss."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "e": r.normal(0, 0.3, (128, EMBED)).astype(f),
            "k": r.normal(0, (KERNEL * EMBED) ** -0.5, (KERNEL * EMBED, FILTERS)).astype(f),
            "c": np.zeros(FILTERS, f),
            "w": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(f),
            "d": np.zeros(HIDDEN, f),
            "v": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
            "b": np.zeros(1, f),
        }
        self.scale, self.shift, self.threshold, self.held_out = 1.0, 0.0, 0.5, {}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        e = p["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, KERNEL * EMBED)
        z = cols @ p["k"] + p["c"]
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)), axis=1)
        h = np.maximum(pooled @ p["w"] + p["d"], 0)
        return h @ p["v"] + p["b"][0], (x, cols, z, top, pooled, h)

    def backward(self, saved: tuple, g: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, cols, z, top, pooled, h) = self.p, saved
        out = {"v": h.T @ g, "b": np.array([g.sum()], np.float32)}
        gh = np.outer(g, p["v"]) * (h > 0)
        out["w"], out["d"] = pooled.T @ gh, gh.sum(0)
        gp = gh @ p["w"].T
        ga = np.repeat(gp[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
        np.put_along_axis(ga, top[:, None], np.take_along_axis(ga, top[:, None], 1) + gp[:, None, :FILTERS], 1)
        gz = ga * (z > 0)
        out["k"], out["c"] = np.einsum("ntk,ntf->kf", cols, gz, optimize=True), gz.sum((0, 1))
        gc = (gz @ p["k"].T).reshape(len(x), -1, KERNEL, EMBED)
        ge = np.zeros((*x.shape, EMBED), np.float32)
        for i in range(KERNEL):
            ge[:, i : i + gc.shape[1]] += gc[:, :, i]
        out["e"] = np.zeros_like(p["e"])
        np.add.at(out["e"], x.ravel(), ge.reshape(-1, EMBED))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 3e-3, seed: int = 0) -> None:
        r, m = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum()))).astype(np.float32)
        t, epochs = 0, max(epochs, -(-300 * batch // len(y)))
        for _ in range(min(epochs, 60)):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                logit, saved = self.forward(x[i])
                g = (weight[i] * (1 / (1 + np.exp(-logit)) - y[i]) / len(i)).astype(np.float32)
                t += 1
                for k, d in self.backward(saved, g).items():
                    a, b = m[k]
                    a += 0.1 * (d - a)
                    b += 0.01 * (d * d - b)
                    self.p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, logit: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by gradient steps, then the highest threshold that keeps ``recall`` of the positives."""
        spread = max(1e-3, float(np.abs(logit).max()))
        z, a, b = logit / spread, 1.0, 0.0
        for _ in range(500):
            e = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 2.0 * float((e * z).mean()), b - 2.0 * float(e.mean())
        self.scale, self.shift = a / spread, b
        score = np.sort(self.calibrated(logit[y > 0]))
        self.threshold = float(score[int((1 - recall) * len(score))]) if len(score) else 0.5

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -60, 60)))

    def scores(self, found: list[list[bytes]]) -> np.ndarray:
        """The largest window's score of each candidate."""
        if not found:
            return np.empty(0)
        x = codes([w for ws in found for w in ws])
        logit = np.concatenate([self.forward(x[i : i + 2048])[0] for i in range(0, len(x), 2048)])
        starts = np.cumsum([0] + [len(ws) for ws in found])[:-1]
        return self.calibrated(np.maximum.reduceat(logit, starts))


def codes(rows: list[bytes]) -> np.ndarray:
    return np.minimum(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, WIDTH), 127)


#: Alphabets of generated keys, and the forms they take: what stands before, the alphabet, how many characters, and how
#: often a dash is set between groups of so many.
_UPPER_HEX, _WORD, _BASE64 = "0123456789ABCDEF", "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))), "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "+/"
SHAPES = (
    ("", _UPPER_HEX, (32, 64), 0),
    ("", _WORD, (20, 48), 0),
    ("", _BASE64, (24, 88), 0),
    ("sk_live_", _WORD, (16, 32), 0),
    ("ghx_", _WORD, (30, 40), 0),
    ("xoxz-", _WORD, (24, 40), 8),
    ("", "0123456789abcdef", (32, 40), 8),
    ("pat-", _WORD, (16, 24), 4),
)
#: What looks like a key and is none: card numbers, long numbers, paths, joined words, dates, and names in code.
DECOYS = ("digits", "path", "joined", "stamp", "camel", "groups")
BEFORE = ("", "key: ", "use ", "Authorization: Bearer ", "export KEY=", "(", "id ")


def generated(r: np.random.Generator, shape: tuple) -> str:
    """A key of a shape that the fixed patterns do not know."""
    lead, alphabet, (low, high), every = shape
    chars = "".join(alphabet[i] for i in r.integers(len(alphabet), size=r.integers(low, high + 1)))
    return lead + ("-".join(chars[i : i + every] for i in range(0, len(chars), every)) if every else chars)


def decoy(r: np.random.Generator, words: list[str]) -> str:
    kind = DECOYS[r.integers(len(DECOYS))]
    some = [words[i] for i in r.integers(len(words), size=4)]
    digits = lambda n: "".join(map(str, r.integers(10, size=n)))
    if kind == "digits":
        return digits(r.integers(16, 24))
    if kind == "groups":
        return "-".join(digits(4) for _ in range(r.integers(4, 6)))
    if kind == "stamp":
        return f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(6)}-{digits(4)}"
    return {"path": "/" + "/".join(some) + f"/{digits(4)}", "joined": "-".join(some) + "_" + digits(2), "camel": "".join(w.capitalize() for w in some) + digits(1)}[kind]


def examples(text: str, r: np.random.Generator) -> list[tuple[bytes, int]]:
    """Labelled windows of a text: base findings with and without context, keys of other shapes and decoys set between its words,
    and its own candidates that no pattern knows."""
    base = base_spans(text)
    out = [(w, 1) for s, _, e in base for blank in (False, True) for w in windows(text, s, e, blank)]
    out += [(w, 0) for s, e in other_candidates(text, base) for w in windows(text, s, e)]
    words = [w for w in re.findall(r"[A-Za-z]+", text[:4000])] or ["word"]
    at = [m.start() for m in re.finditer(r"\s", text)] or [0]
    for label, made in ((1, generated(r, SHAPES[r.integers(len(SHAPES))])), (0, decoy(r, words))):
        place, lead = at[r.integers(len(at))], BEFORE[r.integers(len(BEFORE))]
        whole = f"{text[:place]} {lead}{made} {text[place:]}"
        start = place + 1 + len(lead)
        out += [(w, label) for w in windows(whole, start, start + len(made))]
    return out


def train(docs: DataFrame, recall: float = RECALL) -> CharNet | None:
    """A network from about TRAIN_DOCS documents, chosen by a hash of the row; every fifth of them calibrates it and is scored in ``net.held_out``."""
    n = docs.count()
    if not n:
        return None
    share = F.lit(int(min(1.0, TRAIN_DOCS / n) * (1 << 31)))
    # rows that repeat as a whole count once, so the sample stays bounded
    keyed = docs.select(row_key(docs).cast("string").alias("doc_id"), F.col("text").cast("string"))
    sample = keyed.filter(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 31)) < share).dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids, doc, rows, label = batch.column(0).to_pylist(), [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                found = examples(text or "", np.random.default_rng(hash_of(f"{ids[at]}:{(text or '')[:64]}")))
                doc += [at] * len(found)
                rows += [w for w, _ in found]
                label += [y for _, y in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(rows, pa.binary()), pa.array(label, pa.int32())], names=["doc_id", "x", "y"])

    labelled = sample.mapInArrow(run, "doc_id string, x binary, y int")
    got = labelled.orderBy(F.xxhash64(F.lit(3), "doc_id", "x"), "x").limit(TRAIN_ROWS).collect()
    x, y = codes([bytes(r.x) for r in got]) if got else None, np.array([r.y for r in got], dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return None
    # every fifth document calibrates; with too few of a class in either part, all rows serve both
    held = np.array([hash_of(r.doc_id) % 5 == 0 for r in got])
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        held = np.ones(len(y), dtype=bool)
    net = CharNet()
    net.fit(x[~held] if (~held).any() else x, y[~held] if (~held).any() else y)
    logit = net.forward(x[held])[0]
    net.calibrate(logit, y[held], recall)
    found = net.calibrated(logit) >= net.threshold
    net.held_out = {"n": int(held.sum()), "recall": float(found[y[held] > 0].mean()), "precision": float(y[held][found].mean()) if found.any() else 1.0}
    return net


def hash_of(value: str | None) -> int:
    import zlib

    return zlib.crc32((value or "").encode())


def scan(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """One row a document: doc_id and spans, array of (kind, start, end, score), code points, end exclusive, in order of start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in spans] for spans in found_in(texts, net)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


MASK = "[secret]"


def found_in(texts: list[str], net: CharNet | None) -> list[list[tuple[int, int, int, float | None]]]:
    """(start, kind number, end, score) of every span of every text, in order."""
    base = [base_spans(t) for t in texts]
    more = [other_candidates(t, b) if net else [] for t, b in zip(texts, base)]
    views = [windows(t, s, e) for t, b, c in zip(texts, base, more) for s, e in [(s, e) for s, _, e in b] + c] if net else []
    scores = iter(net.scores(views).tolist() if net else ())
    out = []
    for b, c in zip(base, more):
        spans = [(s, k, e, next(scores) if net else None) for s, k, e in b]
        spans += [(s, 3, e, p) for s, e in c if (p := next(scores)) >= net.threshold]
        out.append(sorted(spans, key=lambda x: x[:3]))
    return out


def masked(text: str, spans: list[tuple]) -> str:
    """The text with every span, overlapping ones together, replaced by MASK."""
    parts, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """The documents, all columns, with the secrets in their texts masked; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            spans = found_in([t or "" for t in texts], net)
            clean = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
