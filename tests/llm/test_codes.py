"""Vector codes, fill-in-middle and token shards against plain forms of the same rules."""

import hashlib
import random
import uuid
import zlib

import duckdb
import numpy as np
import pytest

from marginalia.llm import infill, token_shards, vector_codes
from marginalia.llm.common import shared_dir

from ..helpers import duck_rows, spark_rows


def exact(rows, entries=16, rounds=6):
    """Codes of (id, integers) by Python's integers."""
    rows = sorted(rows)
    w = len(rows[0][1]) // 8
    parts = [[v[p * w : p * w + w] for p in range(8)] for _, v in rows]
    books = [[x[p] for x in parts[:entries]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda p, a: min(range(len(books[p])), key=lambda e: (far(a, books[p][e]), e))
    for _ in range(rounds):
        for p in range(8):
            where = [find(p, x[p]) for x in parts]
            for e in set(where):
                mine = [x[p] for x, at in zip(parts, where) if at == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = {}
    for (i, _), x in zip(rows, parts):
        at = [find(p, x[p]) for p in range(8)]
        out[i] = ("".join(f"{e:02x}" for e in at), sum(far(x[p], books[p][at[p]]) for p in range(8)))
    return out, hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


def test_products_are_exact():
    r = np.random.default_rng(1)
    for most in (5, 1 << 24, 1 << 27):
        a, b = (r.integers(-most, most, (n, 8)) for n in (50, 16))
        assert (vector_codes.products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(i, j)) for j in b] for i in a])).all()
    assert len(vector_codes.limbs(np.array([[1 << 27]]), 24)) == 2
    assert sum(int(x[0]) << (10 * i) for i, x in enumerate(vector_codes.limbs(np.array([-123456789]), 10))) == -123456789


VECTORS = "vec_id long, label int, embedding array<float>, q string, code string"


def coded(spark, tmp_path, rows):
    where = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{where}/embeddings.parquet")
    return where, vector_codes.query(spark, where)


def test_vector_codes(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, None]), [r.gauss(0, 1) * (9000 if i % 50 == 7 else 1) for _ in range(16)], "x", "y") for i in range(-20, 300)]
    rows += [(400 + i, 1, rows[i][2], "x", "y") for i in range(5)]
    bad = [(500, 1, None, "x", "y"), (501, 1, [1.0] * 15 + [None], "x", "y"), (502, None, [float("nan")] * 16, "x", "y"), (-99, 0, [float("inf")] + [0.0] * 15, "x", "y")]
    where, df = coded(spark, tmp_path, rows + bad)
    got = {x["vec_id"]: x for x in df.collect()}
    ints = [(i, [int(np.floor(np.float64(np.float32(c)) * 4096)) for c in v]) for i, _, v, *_ in rows]
    want, digest = exact(ints)
    assert {i: (x["code"], x["error"]) for i, x in got.items()} == want
    labels = {i: label for i, label, *_ in rows}
    assert all(x["label_error"] == sum(want[j][1] for j in want if labels[j] == labels[i]) and x["codebooks_sha256"] == digest for i, x in got.items())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{where}/embeddings.parquet/*.parquet'")
    assert spark_rows(df) == duck_rows(con, vector_codes.SQL)
    small = vector_codes.BROADCAST_LABELS
    vector_codes.BROADCAST_LABELS = 0
    try:
        assert spark_rows(coded(spark, tmp_path, rows)[1]) == spark_rows(df)
    finally:
        vector_codes.BROADCAST_LABELS = small


def test_vector_codes_of_odd_rows(spark, tmp_path):
    assert coded(spark, tmp_path, [])[1].collect() == []
    assert coded(spark, tmp_path, [(1, 1, None, "", "")])[1].collect() == []
    got = {x["vec_id"]: x for x in coded(spark, tmp_path, [(1, 1, [0.0] * 8, "", ""), (2, 1, [1.0] * 8, "", ""), (3, 1, [1.0] * 16, "", ""), (4, None, [], "", ""), (None, 1, [3e38] * 8, "", "")])[1].collect()}
    assert [got[i]["code"] for i in (1, 2, 3, 4, None)] == ["00" * 8, "01" * 8, None, None, "02" * 8]
    assert got[3]["error"] is None and got[1]["label_error"] == 0 and got[4]["label_error"] is None
    odd = coded(spark, tmp_path, [(1, 1, [0.0] * 7, "", ""), (1, 1, [0.0] * 7, "", "")])[1].collect()
    assert [(x["code"], x["codebooks_sha256"]) for x in odd] == [(None, None)] * 2


def test_vectors_decode(spark):
    rows = [(i, 1, [float(i)] * 8, "", "") for i in range(4)]
    kept = vector_codes.whole(spark.createDataFrame(rows, VECTORS))
    books = vector_codes.train(kept)
    out = vector_codes.decode(vector_codes.encode(kept, books, "vec_id"), books).collect()
    assert {x["vec_id"]: x["vector"] for x in out} == {i: [float(i)] * 8 for i in range(4)}


TEXTS = ["", None, "a", "é", "日本語のテキスト", "𝒳𝒴𝒵 mixed é", "has <M> in it", "<P>", "x" * 1000, "é" * 999, "a<", "<S", "P><", "tab\tand\nline\x00end", "🙂" * 333] + [f"text {i} " + "wörd " * (i % 40) for i in range(200)]


def test_units_by_words():
    for texts in (["é"], ["abc", "", "日本", "🙂x"], TEXTS[2:]):
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(x) for x in raw])
        units = infill.Units(np.frombuffer(b"".join(raw), np.uint8))
        ends = [i + 1 for i, b in enumerate(b"".join(raw)) if i + 1 == offsets[-1] or b"".join(raw)[i + 1] & 0xC0 != 0x80]
        assert units.select(np.arange(1, len(ends) + 1)).tolist() == ends
        assert np.diff(units.rank(offsets)).tolist() == [len(t) for t in texts]


def test_fill_in_middle(spark, tmp_path):
    rows = [(i if i % 17 else None, t, "n", 5) for i, t in enumerate(TEXTS * 3)] + [(3, "again", "n", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    made = infill.infilled(docs)
    back = made.select("*", infill.restored(made["output"], made["form"]).alias("text")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in rows)
    for r in back:
        digest = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        t, n = r["text"], len(r["text"])
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want = ("plain", None, None, t)
        elif h[3] % 100 < 20:
            want = ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["n"]) == (*want, n)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(infill.query(spark, str(tmp_path))) == duck_rows(con, infill.SQL)
    assert infill.infilled(docs.limit(0)).collect() == []


def test_wavelet_matrix():
    r = random.Random(5)
    for size, most in ((0, 1), (1, 0), (63, 3), (64, 1), (1000, 70000), (4096, 49407)):
        ids = np.array([r.choice([0, most, r.randrange(most + 1)]) for _ in range(size)], np.uint32)
        m = token_shards.Shard.open(token_shards.Shard(7, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), token_shards.WaveletMatrix.of(ids)).bytes() + b"\n").tokens
        assert (m.ids() == ids).all()
        assert (m.access(range(size)) == ids).all()
        for token in {0, most, most + 1, 1 << 20, *ids[:20].tolist()}:
            where = np.flatnonzero(ids == token)
            assert (m.occurrences(token) == where).all() and (m.occurrences(token, 1, 3) == where[1:3]).all()
            assert m.count(token) == len(where) and m.count(token, size // 3, size // 2) == ((where >= size // 3) & (where < size // 2)).sum()


WORDS = ["Hello", "don't", "I'LL", "J̌", "́x", "été", "日本", "a,b", "...", "x1y22", "\x1c", "\x85", "T̈", "İ", "|", "(word),", "<word|endoftext|>", "<|ENDOFTEXT|>", "--a", "b_c", "µ!", "<|endoftext|>", "ﬁ", "naïve", "ΑΣ", "🙂🙂"]


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(9)
    texts = ["".join(r.choice(WORDS) + r.choice([" ", "\n", "", "\t\t ", "\x0b", " "]) for _ in range(r.randrange(60))) for _ in range(120)] + [None, "", " ", "word " * 3000]
    rows = [(None if i % 31 == 30 else 5 * i - 100, t, 1) for i, t in enumerate(texts)] + [(20, "same id", 2), (20, "same id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = Tokenizer.from_file(token_shards.vocabulary())
    plain = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [1]
    got = sorted((x for x in token_shards.query(spark, str(tmp_path)).collect()), key=lambda x: x["start"])
    want = sorted((str(i), len(ids := plain(t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["ids_crc32"]) for x in got) == want
    assert [x["start"] for x in got] == np.cumsum([0] + [x["n_tokens"] for x in got])[:-1].tolist()
    ids = [x["doc_id"] for x in got]
    missing = sum(i is None for i, *_ in rows)
    assert ids == [None] * missing + sorted(ids[missing:])

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_shards.write(docs, path, shard_tokens=200)
    assert token_shards.documents(spark, path).select("shard").distinct().count() > 10
    back = {(str(x["doc_id"]), tuple(np.frombuffer(x["ids"], "<u4").tolist())) for x in token_shards.documents(spark, path).collect()}
    assert back == {(str(i), tuple(plain(t))) for i, t, _ in rows}
    often = plain("word")[0]
    flat = [x for _, t, _ in rows for x in plain(t)]
    assert {x["token"]: x["n"] for x in token_shards.counts(spark, path, [1, often, 60000]).collect()} == {1: len(rows), often: flat.count(often), 60000: 0}
    assert token_shards.occurrences(spark, path, often).groupBy().count().first()[0] == flat.count(often)
    starts = [x["start"] for x in token_shards.with_starts(token_shards.digests(spark, path)).orderBy("start").collect()]
    assert starts == [x["start"] for x in got]


def test_token_shards_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert token_shards.query(spark, str(tmp_path)).collect() == []


def test_tokenizers_that_keep_spaces_get_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = token_shards.vocabulary("byte_bpe_50k.json")
    encode = token_shards.Encoder(file)
    ids, lengths = encode(pa.array(["two words", "", "three  more words"]))
    plain = [Tokenizer.from_file(file).encode(t, add_special_tokens=False).ids for t in ("two words", "", "three  more words")]
    assert not encode.by_words and lengths.tolist() == list(map(len, plain)) and ids.tolist() == sum(plain, [])
    assert token_shards.Encoder(token_shards.vocabulary()).by_words
    few = token_shards.Encoder(token_shards.vocabulary(), kept=3)
    assert [few(pa.array([t]))[0].tolist() for t in ("a b c d Àé", "a", "x y a ßµ1")] == [Tokenizer.from_file(token_shards.vocabulary()).encode(t, add_special_tokens=False).ids for t in ("a b c d Àé", "a", "x y a ßµ1")]
