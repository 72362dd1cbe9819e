"""SimHash near-duplicate groups: fingerprints, BK-trees by shard, connected components.

A text's words (lower-cased A-Z) give shingles of ``shingle`` words, repeats included; fingerprint bit i is set if it
is set in more than half of the shingles' XXH64 values. Equal fingerprints are folded into one node, named by its least
doc_id. Every node is copied under several exact keys (``block_keys``), so that similar fingerprints meet under a common one: the
64 bits fall into blocks, and any two fingerprints that differ in at most ``radius`` bits agree in all but ``radius``
blocks, so a key for each choice of the remaining blocks misses no link.

Each key's nodes form a shard. A shard's BK-tree files every fingerprint below its parent by their integer Hamming
distance; a search goes from a node at distance d only along edges from d - radius to d + radius. A shard of more than
``TREE_NODES`` nodes is dealt over several trees of bounded size and all of its rows are sent to each of them, so a hot
key is neither one task nor one large tree, and no link is lost. A shard returns links to one member for each of its
local components, never all pairs; ``components`` joins them.

The pipeline's stage (``one_of_each``) measures Jaccard similarity of shingle sets. Its fingerprints are SimHashes of 512
bits of the sets; shards are made by keys of least hashes, under which similar sets of any size meet; BK-trees of the
shards give the pairs within a wide radius, and every such pair is settled on the texts.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle of all; a null doc_id keeps its row and gets its group's least doc_id (null if the group has no other);
repeated rows share a group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, give_back, pieces, row_key, saved
from .components import components

#: Most nodes of one BK-tree; a larger shard is dealt over several.
TREE_NODES = 20_000
#: Rows of whole shards that are searched together.
ROWS_AT_ONCE = 100_000
#: (query, node) pairs held at once during a search.
FRONTIER = 2_000_000
SEED = 42
#: Up to so many hot keys are sent to every executor; beyond it Spark joins them.
BROADCAST_HOT = 100_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, in order. bytes.lower and bytes.split touch ASCII only, as the word rule asks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the values."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def remix(hashes: np.ndarray) -> np.ndarray:
    """A second, independent-looking value for each hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digest(distinct: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of hashes, as two longs: texts are folded only where these are equal."""
    x = xxhash.xxh3_128_intdigest(distinct.tobytes(), SEED)
    return signed(x >> 64), signed(x & (1 << 64) - 1)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, f0): 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out = [signed(majority(shingle_hashes(text, shingle))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "f0"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, f0 long")


def block_keys(n_nodes: int, radius: int) -> list[list[int]]:
    """Bit positions of each key. More nodes take more blocks, so that shards stay small: C(blocks, radius) keys."""
    blocks = radius + (1 if n_nodes < 1 << 23 else 2 if n_nodes < 1 << 28 else 3)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen, []) for chosen in itertools.combinations(spans, blocks - radius)]


def keyed(nodes: DataFrame, keys: list[list[int]], words: list[str]) -> DataFrame:
    """Every node once for each key, as (key, f0[, f1], node)."""
    columns = []
    for k, bits in enumerate(keys):
        key = F.lit(k).cast("long")
        for w, name in enumerate(words):
            mask = sum(1 << (b - 64 * w) for b in bits if b // 64 == w)
            key = F.xxhash64(key, F.col(name).bitwiseAND(F.lit(signed(mask))))
        columns.append(key)
    return nodes.select(F.explode(F.array(*columns)).alias("key"), *words, "node")


class Forest:
    """BK-trees of many shards at once, each built breadth first: a group's first fingerprint is its node, the rest fall into child groups by their distance to it."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray, n_shards: int):
        """shard: sorted shard numbers, one a row; prints: (rows, words) of uint64."""
        n = len(shard)
        self.prints, self.edge = prints, np.zeros(n, dtype=np.int16)
        self.root = np.full(n_shards, -1, dtype=np.int64)
        self.parent = parent = np.full(n, -1, dtype=np.int64)
        rows, group, above = np.arange(n), shard.astype(np.int64), np.full(n, -1, dtype=np.int64)
        while len(rows):
            order = np.argsort(group, kind="stable")
            rows, group, above = rows[order], group[order], above[order]
            first = np.concatenate(([True], group[1:] != group[:-1]))
            node = rows[first][np.cumsum(first) - 1]
            top = first & (above < 0)
            self.root[shard[rows[top]]] = rows[top]
            parent[rows[first]] = above[first]
            rest = ~first
            rows, above = rows[rest], node[rest]
            distance = np.bitwise_count(prints[rows] ^ prints[above]).sum(axis=1)
            self.edge[rows] = distance
            group = above * 1024 + distance
        # children of each node, in one array: those of node i stand from start[i] to start[i + 1]
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.argsort(parent[kids], kind="stable")]
        self.kids, self.start = kids, np.searchsorted(parent[kids], np.arange(n + 1))

    def search(self, shard: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query row of a shard: all nodes within radius, as (query, node, distance) arrays, piece by piece."""
        root = self.root[shard]
        todo = [(np.flatnonzero(root >= 0), root[root >= 0])]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            distance = np.bitwise_count(prints[query] ^ self.prints[node]).sum(axis=1).astype(np.int16)
            near = distance <= radius
            if near.any():
                yield query[near], node[near], distance[near]
            count = self.start[node + 1] - self.start[node]
            inner = count > 0
            query, node, distance, count = query[inner], node[inner], distance[inner], count[inner]
            if not len(query):
                continue
            at = np.repeat(self.start[node] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            kids = self.kids[at]
            keep = np.abs(self.edge[kids] - np.repeat(distance, count)) <= radius
            todo.append((np.repeat(query, count)[keep], kids[keep]))


class Union:
    """Least-label components over array batches of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def shards(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows sorted by (key, tree), nodes first, as tables of whole shards with each row's shard number and the places of the
    nodes. Of a shard of very many rows the nodes stay and the others come by and by."""

    def numbered(held: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        key, tree = held.column("key").to_numpy(), held.column("tree").to_numpy()
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])))
        return held, np.cumsum(fresh) - 1, np.flatnonzero(held.column("is_node").to_numpy())

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < at_once:
            continue
        held = held.combine_chunks()
        key, tree = held.column("key").to_numpy(), held.column("tree").to_numpy()
        last = int(np.flatnonzero((key != key[-1]) | (tree != tree[-1]))[-1]) + 1 if (key[0], tree[0]) != (key[-1], tree[-1]) else 0
        if last:
            yield numbered(held.slice(0, last))
            held = held.slice(last)
        if held.num_rows >= 2 * at_once:
            yield numbered(held)
            held = held.filter(held.column("is_node"))
        give_back()
    if held is not None and held.num_rows:
        yield numbered(held.combine_chunks())


def prints_of(held: pa.Table, words: list[str]) -> np.ndarray:
    return np.stack([held.column(w).to_numpy() for w in words], axis=1).view(np.uint64)


def shard_links(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(key, tree, is_node, f0[, f1], node), to links (a, b) of nodes within radius that share a key and tree: one joins each row to the least member of its local component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard, own in shards(batches):
            node, prints = held.column("node").to_numpy(), prints_of(held, words)
            forest = Forest(shard[own], prints[own], int(shard[-1]) + 1)
            union = Union(len(node))
            for query, found, _ in forest.search(shard, prints, radius):
                found = own[found]
                other = query != found
                union.add(query[other], found[other])
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, union.label, node)
            a, b = node, least[union.label]
            pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def planted(rows: DataFrame, asks: Column) -> DataFrame:
    """Rows (key, node, ..) dealt to trees, with ``tree`` and ``is_node``, sorted for the search. A hot key's rows are filed in one
    of its trees each; those that ask are sent to every tree of it."""
    sizes = rows.groupBy("key").count()
    hot = saved(sizes.filter(F.col("count") > TREE_NODES).select("key", F.ceil(F.col("count") / TREE_NODES).cast("int").alias("trees")))
    n_hot = hot.count()
    if not n_hot:
        dealt = rows.withColumn("tree", F.lit(0)).withColumn("is_node", F.lit(True))
    else:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        trees = F.coalesce("trees", F.lit(1))
        own = F.pmod(F.xxhash64("node"), trees).cast("int")
        rows = rows.join(hot, "key", "left").withColumn("own", own).withColumn("tree", F.explode(F.when(asks, F.sequence(F.lit(0), trees - 1)).otherwise(F.array("own"))))
        dealt = rows.withColumn("is_node", F.col("own") == F.col("tree")).drop("trees", "own")
    return dealt.repartition("key", "tree").sortWithinPartitions("key", "tree", F.desc("is_node"), "node")


def links_within(nodes: DataFrame, keys: list[list[int]], words: list[str], radius: int) -> DataFrame:
    """Links among nodes (f0[, f1], node), each found under some key."""
    return shard_links(planted(keyed(nodes, keys, words), F.lit(True)).select("key", "tree", "is_node", *words, "node"), words, radius)


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the least doc_id reachable over links of at most ``radius`` bits."""
    prints = saved(fingerprints(docs, shingle))
    # a node is named by its fingerprint, so that one whose rows have no id links others all the same
    nodes = saved(prints.groupBy("f0").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("f0")))
    found = components(links_within(nodes, block_keys(nodes.count(), radius), ["f0"], radius))
    known = saved(nodes.join(found, "node", "left").select("f0", "low", F.coalesce("component", "node").alias("c")))
    least = known.groupBy("c").agg(F.min("low").alias("component_id"))
    known = known.join(least, "c").select("f0", "component_id")
    return prints.join(known, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Near duplicates: shingles of five words, Jaccard similarity of the sets of distinct shingles.
SIMILARITY, WIDE_SHINGLE = 0.8, 5
#: Candidates meet under one of BANDS keys of BAND least hashes: a pair of similarity s in all but (1 - s^BAND)^BANDS of
#: cases, 7 in 100,000 at 0.8, whatever the length of the texts and the number of documents.
BAND, BANDS = 5, 24
#: Least shingle hashes kept of a text: a link between texts of so many shingles or fewer is settled on them.
SKETCH = 256
#: A link of longer texts is dropped on the sketches only below this share of the similarity (at 0.8: six standard
#: errors); all others are settled on the whole sets.
SCREEN = 0.8
#: Rows that carry sketches are searched so many together, and so many pairs of them are compared at once.
SKETCHES_AT_ONCE, COMPARED_AT_ONCE = 40_000, 4096
#: (shingle, hash function) pairs held at once.
HASHES_AT_ONCE = 1 << 16
_RANDOM = np.random.default_rng(SEED).integers(1 << 64, size=(2, BAND * BANDS, 1), dtype=np.uint64)
#: Factors (odd) and terms of the hash functions.
FACTOR, TERM = _RANDOM[0] | np.uint64(1), _RANDOM[1]
#: Up to so many ids are sent to every executor; beyond it Spark joins them.
BROADCAST_IDS = 500_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes, mixed once more, sorted."""
    return np.unique(remix(shingle_hashes(text, shingle)))


def bands(distinct: np.ndarray) -> list[int]:
    """The text's keys: of each band, a hash of its least values under BAND hash functions. An empty set has none."""
    if not len(distinct):
        return []
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = HASHES_AT_ONCE // len(least)
    for at in range(0, len(distinct), step):
        np.minimum(least, (FACTOR * distinct[at : at + step] + TERM).min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(part.tobytes(), k)) for k, part in enumerate(least.reshape(BANDS, BAND))]


#: Words of a wide fingerprint, and the bits in which two of them may differ for their texts to be verified. At similarity
#: 0.8 78 of 512 bits differ on average with a standard deviation of 8, so the radius keeps all but 5 in 10,000 of such
#: pairs and more above it; sets of four and five shingles are further apart, and have a wider one.
WIDE, WIDE_RADIUS = [f"f{i}" for i in range(8)], 104
WIDE_KIND = ", ".join(f"{w} long" for w in WIDE)
FEW_SHINGLES, FEW_RADIUS = 8, 140


def wide_print(distinct: np.ndarray) -> list[int]:
    out = []
    for _ in WIDE:
        out.append(signed(majority(distinct)))
        distinct = remix(distinct)
    return out


def set_keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, d0, d1, size, f0.., keys): of a text's shingle set the digest, the size, the SimHash of 512 bits, and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            sets = [shingle_set(text, shingle) for text in batch.column(2).to_pylist()]
            d = np.array([digest(x) for x in sets], dtype=np.int64).reshape(-1, 2)
            f = np.array(list(map(wide_print, sets)), dtype=np.int64).reshape(-1, len(WIDE))
            columns = [pa.array(x) for x in (d[:, 0], d[:, 1], np.array(list(map(len, sets)), dtype=np.int64), *f.T)]
            columns.append(pa.array(list(map(bands, sets)), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "d0", "d1", "size", *WIDE, "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "row", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, row long, d0 long, d1 long, size long, {WIDE_KIND}, keys array<long>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, size, f0..) under keys that several nodes have."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    return rows.join(shared, "key").join(nodes.select("node", "size", *WIDE), "node")


def tree_pairs(rows: DataFrame, similarity: float, edges: bool) -> DataFrame:
    """(key, tree, is_node, node, c, size, f0.., asks[, sketch]) to pairs (a, b) of different c within WIDE_RADIUS, whose sizes allow the similarity.

    With ``edges`` the pairs are those of each node with its parent in its shard's tree and with the shard's middle, two a
    node at most. Without, each row that asks is searched for in its shard's trees, along edges within the radius, and the
    sketches of what is found are compared: a pair that they rule out is no pair.
    """

    def pairs_of(held: pa.Table, shard: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, c, size, asks = (held.column(x).to_numpy() for x in ("node", "c", "size", "asks"))
        prints = prints_of(held, WIDE)
        forest = Forest(shard[own], prints[own], int(shard[-1]) + 1)
        if edges:
            below = np.flatnonzero(forest.parent >= 0)
            hub, apart = middles(shard[own], prints[own])
            found = [(own[below], own[forest.parent[below]], forest.edge[below]), (own, own[hub], apart)]
        else:
            who = np.flatnonzero(asks)
            found = ((who[q], own[n], distance) for q, n, distance in forest.search(shard[who], prints[who], FEW_RADIUS))
            sketches = sketch_rows(held.column("sketch"))
        for x, y, distance in found:
            least = np.minimum(size[x], size[y])
            keep = (c[x] != c[y]) & (least >= similarity * np.maximum(size[x], size[y])) & (distance <= np.where(least < FEW_SHINGLES, FEW_RADIUS, WIDE_RADIUS))
            x, y = x[keep], y[keep]
            if not edges:
                keep = may_reach(sketches, size, x, y, similarity)
                x, y = x[keep], y[keep]
            x, y = node[x], node[y]
            pairs = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a function of its own, so that its tables are gone when the next rows are gathered
        for some in shards(batches, ROWS_AT_ONCE if edges else SKETCHES_AT_ONCE):
            yield from pairs_of(*some)
            del some

    carried = ["key", "tree", "is_node", "node", "c", "size", *WIDE, "asks"]
    return rows.select(*carried, *([] if edges else ["sketch"])).mapInArrow(run, "a long, b long").distinct()


#: Pads sketches of fewer than SKETCH values.
PAD = np.uint32(0xFFFFFFFF)


def short_sketch(distinct: np.ndarray) -> np.ndarray:
    """The upper halves of the SKETCH least hashes of a sorted set."""
    return (distinct[:SKETCH] >> np.uint64(32)).astype(np.uint32)


def sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    out = np.full((len(column), SKETCH), PAD, dtype=np.uint32)
    for i, values in enumerate(column.to_pylist()):
        out[i, : len(values) // 4] = np.frombuffer(values, dtype=np.uint32)
    return out


def may_reach(sketches: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows (x, y) may be so similar by their sketches. Sets that a sketch holds whole are left two values of
    leeway, for halves of hashes that are equal by chance; larger ones are ruled out below SCREEN times the similarity."""
    out = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), COMPARED_AT_ONCE):
        a, b = x[at : at + COMPARED_AT_ONCE], y[at : at + COMPARED_AT_ONCE]
        both = np.sort(np.concatenate((sketches[a], sketches[b]), axis=1), axis=1)
        real, again = both != PAD, np.zeros(both.shape, dtype=bool)
        again[:, 1:] = both[:, 1:] == both[:, :-1]
        rank = np.cumsum(real & ~again, axis=1, dtype=np.int32)
        whole = np.maximum(size[a], size[b]) < SKETCH
        most = np.where(whole, 2 * SKETCH, SKETCH)
        shared = (again & real & (rank <= most[:, None])).sum(axis=1)
        union = np.minimum(rank[:, -1], most)
        out[at : at + len(a)] = np.where(whole, shared + 2 >= similarity * union, shared >= SCREEN * similarity * union)
    return out


def middles(shard: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of its shard that is nearest to the shard's majority of bits, and the distance to it. Edited copies
    of one text lie round it, so they are joined through it rather than by all pairs of them."""
    start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    count = np.diff(np.append(start, len(shard)))
    which = np.repeat(np.arange(len(start)), count)
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    middle = np.packbits(2 * np.add.reduceat(bits, start, axis=0, dtype=np.int64) > count[:, None], axis=1).view(np.uint64)
    far = np.bitwise_count(prints ^ middle[which]).sum(axis=1)
    hub = np.lexsort((far, which))[start][which]
    return hub, np.bitwise_count(prints ^ prints[hub]).sum(axis=1)


def first_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs along the edges of the shards' trees and with their middles, fewer than twice as many as there are rows."""
    rows = rows.withColumn("c", F.col("node")).withColumn("asks", F.lit(False))
    return tree_pairs(planted(rows, F.lit(False)), similarity, edges=True)


def other_pairs(rows: DataFrame, found: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """All pairs within the radius under a common key that are not joined yet and that sketches do not rule out: all but the
    key's largest component ask."""
    rows = saved(rows.join(found, "node", "left").select("key", "node", "size", *WIDE, F.coalesce("component", "node").alias("c")))
    counts = rows.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("most"), F.count("*").alias("n"))
    rows = saved(rows.join(counts.filter("n > 1").select("key", "most"), "key").withColumn("asks", F.col("c") != F.col("most")).drop("most"))
    sketches = sets_of(docs, first_rows(nodes, rows.select("node").distinct()), shingle, short_sketch)
    rows = rows.join(saved(sketches).withColumnRenamed("found", "sketch"), "node")
    return tree_pairs(planted(rows, F.col("asks")), similarity, edges=False)


def first_rows(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, id, row): the row that stands for each of these nodes."""
    return saved(nodes.select("node", "first.doc_id", "first.row").withColumnRenamed("doc_id", "id").join(ids, "node"))


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int, part: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """(node, found): the shingle sets, or a part of each, of the texts that stand for these nodes (node, id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = [part(shingle_set(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "found"])

    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed("row", "r")
    met = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")))
    # rows that repeat as a whole stand for their node alike
    return met.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def jaccard(a: bytes, b: bytes, most: int | None = None) -> float:
    """Of two sorted sets; with ``most`` of their least hashes, so many each: among the least of the union that both reach."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    union = np.union1d(x, y)
    if most and max(len(x), len(y)) >= most:
        union = union[:most]
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)) / len(union)


def measured(pairs: DataFrame, known: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """Those pairs (a, b) whose sets, or sketches of ``most`` hashes, are at least so similar; ``sure`` if the sets are whole."""
    met = pairs.select("a", "b").join(known.withColumnsRenamed({"node": "a", "found": "x"}), "a").join(known.withColumnsRenamed({"node": "b", "found": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            keep, sure = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sure.append(not most or max(len(x), len(y)) < 8 * most)
                keep.append(jaccard(x, y, None if sure[-1] else most) >= (least if sure[-1] else SCREEN * least))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (batch.column(0), batch.column(1), pa.array(sure, pa.bool_()))], names=["a", "b", "sure"])

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, sure boolean")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets of shingles are at least so similar, by the whole sets."""

    def sets(links: DataFrame, most: int | None = None) -> DataFrame:
        ids = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return saved(sets_of(docs, first_rows(nodes, ids), shingle, lambda x: x[:most]))

    if pairs.isEmpty():
        return pairs
    screened = saved(measured(pairs, sets(pairs, SKETCH), similarity, SKETCH))
    open_ = screened.filter("not sure")
    sure = screened.filter("sure").select("a", "b")
    return sure if open_.isEmpty() else saved(sure.unionByName(measured(open_, sets(open_), similarity).select("a", "b")))


def one_of_each(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates, all columns: of each group of texts at least so similar one row, that of the least doc_id.

    Texts of the same set of shingles are one node; different sets are different nodes. Nodes meet under keys of least
    hashes, in whose shards BK-trees file their SimHash. The trees' edges within the radius, and pairs with the middle of
    each shard, are verified first; then every pair that a search finds within it, that is not joined yet and whose
    sketches (carried along in the trees) do not rule it out.

    Defined cases: a row is known by its doc_id and a hash of all of its columns, so rows without an id, or that repeat
    one, are judged by their own texts; of a group a row with an id stays before one without, on a tie of ids the one of
    the least hash, and of rows that are equal as a whole one; null and blank texts are a group.
    """
    slim = docs.select("doc_id", "text", row_key(docs).alias("row"))
    prints = saved(set_keys(slim, shingle))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = prints.groupBy("d0", "d1").agg(F.min(rank).alias("first"), *[F.first(c).alias(c) for c in ("size", *WIDE, "keys")])
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    rows = saved(shared_keys(nodes))
    first = saved(first_pairs(rows, similarity))
    links = verified(first, nodes, slim, shingle, similarity)
    rest = other_pairs(rows, components(links), nodes, slim, shingle, similarity).join(first, ["a", "b"], "left_anti")
    more = verified(saved(rest), nodes, slim, shingle, similarity)
    found = components(links.unionByName(more))
    known = saved(nodes.select("d0", "d1", "node", "first").join(found, "node", "left").select("d0", "d1", "first", F.coalesce("component", "node").alias("c")))
    best = known.groupBy("c").agg(F.min("first").alias("best"))
    # the node that holds its group's row to stay keeps that row, the others none
    stay = known.join(best, "c").select("d0", "d1", F.when(F.col("first") == F.col("best"), F.col("first")).alias("stays"))
    judged = prints.select("d0", "d1", rank.alias("rank")).join(stay, ["d0", "d1"]).select("rank.doc_id", "rank.row", F.coalesce(F.col("rank") != F.col("stays"), F.lit(True)).alias("goes"))
    judged = saved(judged.groupBy("doc_id", "row").agg(F.max("goes").alias("goes"), F.count("*").alias("n")).filter("goes or n > 1"))
    key, g_id, g_row = free_names(docs, "row", "g_id", "g_row")
    of = lambda when: judged.filter(when).select(F.col("doc_id").alias(g_id), F.col("row").alias(g_row))
    gone, several = of("goes"), of("not goes")
    same = F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(key) == F.col(g_row))
    out = docs.withColumn(key, row_key(docs))
    out = out.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    if not several.isEmpty():
        out = out.join(several, same, "left_anti").unionByName(out.join(several, same, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
