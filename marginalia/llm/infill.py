"""Fill-in-middle: texts cut twice at drawn code points and put in another order, and back.

Cuts are found without decoding a text. Its UTF-8 bytes are read as 64-bit words; a byte ends a code point where the next one
does not continue it, which shifts and masks mark for eight bytes at once. The marks of each word are counted, the running
counts searched for the word that holds the wanted code point, and its byte found in that word by adding up the marks in all
bytes with one multiplication. A worker holds a slice of some megabytes, or one text, at a time.

Where to cut, and whether, comes from the document's id alone: two draws for the cuts, one for ``plain`` and one for the order.

Defined cases: a null text is empty; an empty text, or one that holds a mark already, stays as it is (plain); a null doc_id draws
as an empty id; rows that repeat an id are cut by the same draws, each in its own length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and so many of these begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1

EVERY = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
ONE, SEVEN, EIGHT = np.uint64(1), np.uint64(7), np.uint64(8)


class Units:
    """Where the code points of a buffer of UTF-8 end, as marks in 64-bit words."""

    def __init__(self, data: np.ndarray):
        words = np.zeros(len(data) // 8 + 2, np.uint64)
        words.view(np.uint8)[: len(data)] = data
        starts = ~(words & ~(words << ONE)) & HIGH  # the high bit of each byte that is no continuation (10......)
        self.marks = starts >> EIGHT
        self.marks[:-1] |= starts[1:] << np.uint64(56)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, bits = at >> 3, ((at & 7) * 8).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((ONE << bits) - ONE))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th code point of the buffer, counted from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        upto = ((self.marks[word] >> SEVEN) * EVERY) | HIGH  # in each byte the marks up to it
        short = (upto - (k - self.before[word]).astype(np.uint64) * EVERY) & HIGH  # high bit: there are enough
        return word * 8 + 9 - np.bitwise_count(short)


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts end to end in ``data`` and draws (texts, 2): code points (n), and both cuts as code points and as bytes of ``data``."""
    units = Units(data)
    first = units.rank(offsets)
    n = np.diff(first)
    points = np.sort(draws % (n[:, None] + 1), axis=1)
    begun = offsets[:-1, None]
    return n, points, np.where(points > 0, units.select(np.maximum(first[:-1, None] + points, 1)), begun)


def draw(doc_id: Column, which: int, seed: int = SEED) -> Column:
    """The which-th (from 1) eight hex digits of a digest of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def infilled(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row a document; form is plain, psm or spm, n the text's code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    draws = [draw(F.col("doc_id"), i, seed) for i in range(1, 5)]
    form = F.when((text == "") | marked | (draws[2] % 100 >= cut), "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), draws[0].alias("h1"), draws[1].alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            n, points, at = cuts(data, offsets, np.stack([batch.column(h).to_numpy() for h in ("h1", "h2")], axis=1))
            forms, held = batch.column("form").to_pylist(), memoryview(data)
            output, sizes = [], []
            for kind, a, (b, c), d, (i, j) in zip(forms, offsets[:-1].tolist(), at.tolist(), offsets[1:].tolist(), points.tolist()):
                prefix, middle, suffix = held[a:b], held[b:c], held[c:d]
                output.append(bytes(held[a:d]) if kind == "plain" else b"".join((p, prefix, s, suffix, m, middle) if kind == "psm" else (s, suffix, p, prefix, m, middle)))
                sizes.append((None, None) if kind == "plain" else (i, j - i))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), *(pa.array([x[k] for x in sizes], pa.int64()) for k in (0, 1)), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. Each mark is in it once, as no mark is in the text and none can arise where pieces meet."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    prefix = F.when(form == "psm", F.substring_index(F.substring(head, len(PREFIX) + 1, 1 << 30), SUFFIX, 1)).otherwise(F.substring_index(head, PREFIX, -1))
    suffix = F.when(form == "psm", F.substring_index(head, SUFFIX, -1)).otherwise(F.substring_index(F.substring(head, len(SUFFIX) + 1, 1 << 30), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, last, suffix))


def query(spark, sf_dir: str) -> DataFrame:
    made = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = f"""
with t as (select doc_id, coalesce(text, '') t, cast(length(coalesce(text, '')) as bigint) n, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) h from documents),
h as (select *, cast('0x' || h[1:8] as bigint) % (n + 1) a, cast('0x' || h[9:16] as bigint) % (n + 1) b, cast('0x' || h[17:24] as bigint) % 100 h3, cast('0x' || h[25:32] as bigint) % 100 h4 from t),
f as (select *, least(a, b) c1, greatest(a, b) c2, case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 >= {CUT} then 'plain' when h4 < {SUFFIX_FIRST} then 'spm' else 'psm' end form from h),
p as (select *, substring(t, 1, c1) prefix, substring(t, c1 + 1, c2 - c1) middle, substring(t, c2 + 1) suffix from f)
select doc_id, n, form, case when form <> 'plain' then c1 end prefix_chars, case when form <> 'plain' then c2 - c1 end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) output_sha256,
       sha256(t) restored_sha256
from p
"""
