"""Token ids of a corpus in files of wavelet matrices, from which any token, count or occurrence can be read without unpacking.

A shard is one file. It holds the ids of consecutive documents as bit planes, most significant bit first: plane by plane, ids
whose bit is 0 are moved before the others in the same order, so that a token is found by following one bit a plane with rank and
select, and the ids of one token end up side by side. Beside the planes stand where the zeros of each end and the ids and ends
of the documents; every section is compressed by itself. Counts of set bits before each word (the rank directory) are made when
a shard is opened.

    file     = b"MTKS" version(u32) shard(u64) documents(u64) tokens(u64) planes(u32), sizes(u64) of the sections, sections, LF
    sections = ids of documents (i64) and which are null (u8), their ends (u64), zeros of each plane (u64), planes in turn

All numbers are little-endian; each section is a zstd frame. Documents are dealt to shards in ascending doc_id order by a range
partitioning, and a shard closes with the document that fills it. Files are written by Spark's text sink, a record a file, and
read by its binaryFile source, so any file system that Spark reaches serves.

Tokens come from the tokenizers library. Where a tokenizer drops white space and lets no token span it, a text's tokens are those
of its words, so each worker keeps the tokens of words it has met and encodes only new ones; other tokenizers get whole texts.

Defined cases: a null text is empty and still has the end id; rows without an id come first; rows that repeat an id follow each
other by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, saved, shared_dir, table

END_ID = 1
#: A shard closes with the document that brings it to so many ids.
SHARD_TOKENS = 1 << 21
#: Words whose tokens a worker keeps; with more it starts anew.
CACHED_WORDS = 1 << 20
#: Shards of which a broadcast holds no more.
BROADCAST_SHARDS = 200_000
HEAD = struct.Struct("<4sIQQQI")
MAGIC, VERSION = b"MTKS", 1


class WaveletMatrix:
    """Ids as bit planes, with access, rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        """planes: packed bits (uint8, little end first, padded to whole 64-bit words)."""
        self.size, self.planes, self.zeros, self.before = size, planes, zeros, None

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max(initial=0)).bit_length())
        row = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in reversed(range(levels)):
            bit = (row >> level) & 1 > 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]))
            low = row[~bit]
            zeros.append(len(low))
            row = np.concatenate([low, row[bit]])
        return cls(len(ids), planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        row = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            out = np.empty_like(row)
            out[~bit] = row[:zeros]
            out[bit] = row[zeros:] | row.dtype.type(1 << level)
            row = out
        return row.astype(np.uint32)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each position: rank."""
        if self.before is None:
            self.before = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.view(np.uint64)), dtype=np.int64)]) for p in self.planes]
        words = self.planes[level].view(np.uint64)
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        inside = words[np.minimum(word, max(0, len(words) - 1))] & ((np.uint64(1) << rest) - np.uint64(1)) if len(words) else np.uint64(0)
        return self.before[level][word] + np.bitwise_count(inside)

    def _select(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the k-th (from 0) set or clear bit of a plane stands, by bisection over its ranks."""
        low, high = np.zeros_like(k), np.full_like(k, self.size)
        while (low < high).any():
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            found = (ones if one else mid + 1 - ones) > k
            low, high = np.where(found, low, np.minimum(mid + 1, high)), np.where(found, mid, high)
        return low

    def access(self, at: Iterable[int]) -> np.ndarray:
        """The ids at positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(len(self.planes)):
            ones, after = self._ones(level, at), self._ones(level, at + 1)
            bit = after > ones
            out = out << np.uint32(1) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the token's ids from [begin, end) stand below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        span = np.array([begin, end], np.int64)
        for level in range(len(self.planes)):
            ones = self._ones(level, span)
            span = self.zeros[level] + ones if token >> (len(self.planes) - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        low, high = self._span(token, begin, self.size if end is None else end)
        return high - low

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the token's occurrences first to last, in order."""
        low, high = self._span(token, 0, self.size)
        at = np.arange(low, high, dtype=np.int64)[first:last]
        for level in reversed(range(len(self.planes))):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at


class Shard:
    """Documents of a shard: their ids, null where ``missing``, the ends of their tokens, and the tokens."""

    def __init__(self, number: int, docs: np.ndarray, missing: np.ndarray, ends: np.ndarray, tokens: WaveletMatrix):
        self.number, self.docs, self.missing, self.ends, self.tokens = number, docs, missing, ends, tokens

    def bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [self.docs.astype("<i8"), self.missing.astype("u1"), self.ends.astype("<u8"), np.array(self.tokens.zeros, "<u8"), *self.tokens.planes]
        sections = [pack(p.tobytes()) for p in parts]
        head = HEAD.pack(MAGIC, VERSION, self.number, len(self.docs), self.tokens.size, len(self.tokens.planes))
        return b"".join([head, np.array([len(s) for s in sections], "<u8").tobytes(), *sections])

    @classmethod
    def open(cls, data: bytes | memoryview) -> Shard:
        magic, version, number, n_docs, n_tokens, levels = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        sizes = np.frombuffer(data, "<u8", 4 + levels, HEAD.size)
        ends = HEAD.size + sizes.nbytes + np.cumsum(sizes).astype(np.int64)
        unpack, view = zstandard.ZstdDecompressor().decompress, memoryview(data)
        raw = [unpack(view[e - int(s) : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
        zeros = np.frombuffer(raw[3], "<u8").astype(np.int64).tolist()
        if len(zeros) != levels or len(raw[0]) != 8 * n_docs:
            raise ValueError("a token shard's sections do not fit its head")
        return cls(number, np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "u1") > 0, np.frombuffer(raw[2], "<u8").astype(np.int64), WaveletMatrix(n_tokens, [np.frombuffer(r, np.uint8) for r in raw[4:]], zeros))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that no normal form changes and that lower case maps one to one, with ASCII signs at either end (no apostrophe): a
#: tokenizer that splits at space and parts letters from signs makes one piece of the letters and one of the signs at each end.
SIGNS, LETTERS = r"[!-&(-/:-@\[-`{-~]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
PLAIN = f"^{SIGNS}*{LETTERS}+{SIGNS}*$"


class Encoder:
    """Token ids of texts, by words: the tokens of words met before are kept."""

    def __init__(self, file: str, kept: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.whole.no_padding()
        self.whole.no_truncation()
        flat = lambda texts: self.ids(texts)[0].tolist()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        spaced = any(not t or any(c.isspace() for c in t) for t in self.added)
        self.by_words = not spaced and all(flat([a + space + b]) == flat([a, b]) for a, b in ("ab", "1!", "Éa") for space in (" ", "\n \t", "\r\x0b\f"))
        suffix = getattr(self.whole.model, "end_of_word_suffix", None) if flat(["a!", "(a"]) == flat(["a", "!", "(", "a"]) else None
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.words, self.starts, self.lengths, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def ids(self, texts: list[str], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        ids, lengths = [np.zeros(0, np.uint32)], []
        for i in range(0, len(texts), at_once):
            got = [e.ids for e in self.whole.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
            lengths += map(len, got)
            ids.append(np.fromiter((x for e in got for x in e), np.uint32, sum(map(len, got))))
        return np.concatenate(ids), np.array(lengths, np.int64)

    def joined(self, words: pa.Array, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, with many in a text: each of their pieces ends with a token that ends a word."""
        listed = words.to_pylist()
        ids, _ = self.ids([" ".join(listed[i : i + at_once]) for i in range(0, len(listed), at_once)], 256)
        pieces = 1 + sum(pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in (f"^{SIGNS}", f"{SIGNS}$"))
        return ids, np.diff(np.flatnonzero(self.ends_word[ids])[np.cumsum(pieces) - 1], prepend=-1)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Keeps the tokens of new words; where each of them is kept."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), bool(self.ends_word.any()))
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token, ignore_case=True))
        order = np.empty(len(words), np.int64)
        for mask, encode in ((plain, self.joined), (pc.invert(plain), lambda x: self.ids(x.to_pylist()))):
            part = words.filter(mask)
            ids, lengths = encode(part)
            order[mask.to_numpy(zero_copy_only=False).astype(bool)] = len(self.words) + np.arange(len(part))
            self.words = pa.concat_arrays([self.words, part])
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.flat = np.concatenate([self.flat, ids])
        return order

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        if not self.by_words:
            return self.ids(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        known = pc.index_in(words.dictionary, value_set=self.words)
        if known.null_count:
            if len(self.words) + known.null_count > self.kept:
                self.forget()
                known = pc.index_in(words.dictionary, value_set=self.words)
            new = pc.is_null(known)
            order = self.learn(words.dictionary.filter(new))
            known = pc.fill_null(known, 0).to_numpy().copy()
            known[new.to_numpy(zero_copy_only=False)] = order
        at = np.asarray(known)[words.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        where = np.repeat(self.starts[at] - (ends - lengths), lengths)
        where += np.arange(len(where))
        upto = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        return self.flat[where], np.diff(upto, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder of a public tokenizer."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary(name))
    return _ENCODERS[name]


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the documents' ids, each document's closed by the end id, as shards below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encode = TaskContext.get().partitionId() << 32, encoder(tokenizer)
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, held, size
            docs, missing, lengths, ids = (np.concatenate(x) for x in zip(*held))
            data = Shard(number, docs, missing, np.cumsum(lengths), WaveletMatrix.of(ids)).bytes()
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in pieces(batches, "text", 1 << 13, 8 << 20):
            if not batch.num_rows:
                continue
            ids, counts = encode(batch.column("text"))
            lengths = counts + 1
            out = np.full(len(ids) + len(counts), end, np.uint32)
            last = np.cumsum(lengths) - 1
            inside = np.ones(len(out), bool)
            inside[last] = False
            out[inside] = ids
            doc = batch.column("doc_id")
            missing, doc = pc.is_null(doc).to_numpy(zero_copy_only=False), pc.fill_null(doc, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = done = 0
            while at < len(doc):  # so many documents as fill the shard
                stop = min(len(doc), at + 1 + int(np.searchsorted(last[at:] + 1 - done, shard_tokens - size)))
                upto = int(last[stop - 1]) + 1
                held.append((doc[at:stop], missing[at:stop], lengths[at:stop], out[done:upto]))
                size, at, done = size + upto - done, stop, upto
                if size >= shard_tokens:
                    yield closed()
        if held:
            yield closed()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    shards = rows.select("doc_id", "text").mapInArrow(run, "data binary")
    shards.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def opened(spark: SparkSession, path: str, rows: Callable[[Shard], pa.RecordBatch], schema: str) -> DataFrame:
    """What a function makes of each shard below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield rows(Shard.open(data.as_buffer()))

    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(run, schema)


def _frame(number: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), *columns.values()], names=["shard", *columns])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, offset, n_tokens, ids): every document's ids (little-endian unsigned 32-bit integers) and where they begin in its shard."""

    def rows(shard: Shard) -> pa.RecordBatch:
        ids = memoryview(shard.tokens.ids().astype("<u4").tobytes())
        begin = shard.ends - np.diff(shard.ends, prepend=0)
        data = [bytes(ids[4 * a : 4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist())]
        return _frame(shard.number, doc_id=pa.array(shard.docs, pa.int64(), mask=shard.missing), offset=pa.array(begin, pa.int64()), n_tokens=pa.array(shard.ends - begin, pa.int64()), ids=pa.array(data, pa.binary()))

    return opened(spark, path, rows, "shard long, doc_id long, offset long, n_tokens long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, offset, n_tokens, ids_crc32) of every document, with the ids read back from its shard."""

    def rows(shard: Shard) -> pa.RecordBatch:
        ids = memoryview(shard.tokens.ids().astype("<u4").tobytes())
        begin = shard.ends - np.diff(shard.ends, prepend=0)
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist())]
        return _frame(shard.number, doc_id=pa.array(shard.docs, pa.int64(), mask=shard.missing), offset=pa.array(begin, pa.int64()), n_tokens=pa.array(shard.ends - begin, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

    return opened(spark, path, rows, "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens stands in all shards, by rank alone."""

    def rows(shard: Shard) -> pa.RecordBatch:
        return _frame(shard.number, token=pa.array(tokens, pa.int64()), n=pa.array([shard.tokens.count(t) for t in tokens], pa.int64()))

    return opened(spark, path, rows, "shard long, token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, doc_id, position): every place of a token, with its document and where it stands in its shard, by select alone."""

    def rows(shard: Shard) -> pa.RecordBatch:
        at = shard.tokens.occurrences(token)
        doc = np.searchsorted(shard.ends, at, "right")
        return _frame(shard.number, doc_id=pa.array(shard.docs[doc], pa.int64(), mask=shard.missing[doc]), position=pa.array(at, pa.int64()))

    return opened(spark, path, rows, "shard long, doc_id long, position long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows with ``start``, the ids of all documents before. A shard's number has the range partition above its place in it, so
    shards are added up within partitions, and partitions, of which there are as many as the session shuffles to, among themselves."""
    rows = saved(rows)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.shiftright("shard", 32))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = saved(shards.withColumn("within", before(Window.partitionBy("part").orderBy("shard"))))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("ahead", before(Window.orderBy("part"))).select(F.col("part").alias("p_part"), "ahead")
    base = saved(shards.join(parts, F.col("part") == F.col("p_part")).select(F.col("shard").alias("s_shard"), (F.col("ahead") + F.col("within")).alias("base")))
    base = F.broadcast(base) if base.count() <= BROADCAST_SHARDS else base
    return rows.join(base, F.col("shard") == F.col("s_shard")).withColumn("start", F.col("base") + F.col("offset")).drop("s_shard", "base")


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return with_starts(digests(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
