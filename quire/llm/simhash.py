"""SimHash near duplicates: fingerprints, pivot distance tables, components.

Fingerprints are counted in Arrow batches. Distinct fingerprints meet in
buckets: a bucket's key is some of the fingerprint's bits. In a bucket every
fingerprint has its row of Hamming distances to many fixed pivots; a pair whose
rows differ anywhere by more than the radius cannot be near (triangle
inequality) and goes, the rest is verified on all bits. A bucket gives its
spanning forest, never all its pairs. Buckets over a bound are split into
chunks, and every pair of chunks is a bucket of its own, so no task holds an
unbounded group and no pair is lost.

Two plans of keys: ``exact_tables`` (pigeonhole: any two fingerprints within
the radius share at least one key) and ``sampled_tables`` (bit sampling for a
wide fingerprint, with a stated recall). The second only proposes clusters: their
members' shingle sets meet in blocks, where pairs are decided by exact similarity,
and a block again gives the spanning forest of what it links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import by_slices, removed, slices, split_join, stored, written

SEED = 42
#: Rows of a bucket above which it is split into chunk pairs.
MOST = 4096
#: Number of pivots.
PIVOTS = 16
ONES = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.float32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that scatters bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of all n-word shingles, repeats included; fewer words: of the whole sequence; none: no hash."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    rows = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) >= n else iter((b" ".join(words),))
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64)


def fingerprints(each: list[np.ndarray], width: int = 1) -> np.ndarray:
    """width 64-bit words for each text's hashes; a bit is 1 if set in over half of them (further words: of mixed hashes)."""
    count = np.array([len(e) for e in each])
    owner = np.repeat(np.arange(len(each)), count) * 256
    h = np.concatenate([*each, np.empty(0, np.uint64)])
    out = np.zeros((len(each), width), np.uint64)
    for w in range(width):
        if w:
            h = mixed(h)
        for byte in range(8):
            at = owner + (h >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)
            ones = np.bincount(at, minlength=256 * len(each)).reshape(-1, 256).astype(np.float32) @ ONES
            over = (2 * ones > count[:, None]).astype(np.uint64)
            out[:, w] |= (over << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def signatures(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, f0 (the fingerprint as a signed long) of every row."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            f = fingerprints([shingle_hashes(t, n) for t in part.column(1).to_pylist()]).view(np.int64)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(f[:, 0])], names=["key", "f0"])

        return run

    return kept.mapInArrow(by_slices(make, 256), f"key {kept.schema[0].dataType.simpleString()}, f0 long")


def exact_tables(n: int, radius: int) -> list[tuple[int, int]]:
    """(word, mask) of each key: the 64 bits are cut into blocks, and a key is blocks - radius of them.

    With ``radius`` bits differing at least blocks - radius blocks are equal. More blocks give longer
    keys and more tables; the fewest are taken whose keys expect at most 64 fingerprints.
    """
    for blocks in range(radius + 1, radius + 5):
        if n <= 64 << 64 * (blocks - radius) // blocks or blocks == radius + 4:
            cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
            bits = [sum(1 << x for x in range(cuts[b], cuts[b + 1])) for b in range(blocks)]
            return [(0, sum(c)) for c in combinations(bits, blocks - radius)]
    raise AssertionError


#: Sets under so many shingles differ in more bits than their angle tells, and are compared within a wider radius.
SMALL = 16


def apart(similarity: float, small: bool = False) -> float:
    """Share of bits expected to differ, at most, between two sets of this Jaccard similarity.

    Of all such sets those of equal size have the least cosine, 2j / (1 + j), and bits differ with probability acos of
    that over pi; few shingles give more, which the factor covers (worst of all sizes: 4 against 5, 1.238 times at 0.8;
    worst from SMALL on: 22 against 23, 1.0443 times; counted over all sizes up to 100).
    """
    return (1.24 if small else 1.045) * math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(share: float, bits: int) -> int:
    """Radius: the bits expected to differ and three standard deviations more."""
    return math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def sampled_tables(n: int, width: int, share: float, radius: int, recall: float = 0.99) -> list[tuple[int, int]]:
    """(word, mask) of each key: m random bits of one word; as many keys as give the recall, the radius's loss included, to pairs whose bits differ with probability ``share``."""
    bits = 64 * width
    m = min(32, max(12, math.ceil(math.log2(max(n, 1) / 1024))))
    at = [(math.comb(bits, h) * share**h * (1 - share) ** (bits - h), (1 - h / bits) ** m) for h in range(radius + 1)]
    need = width
    while sum(p * (1 - (1 - same) ** need) for p, same in at) < recall:
        need += width
    rng = np.random.default_rng(SEED)
    return [(t % width, sum(1 << int(b) for b in rng.choice(64, m, replace=False))) for t in range(need)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_pairs(f: np.ndarray, group: np.ndarray, radius: int, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (positions) of rows with the same group; group is sorted. Rows at one distance from each other are tested together."""
    table = np.bitwise_count(f[:, None, :] ^ pivots[None]).sum(2).astype(np.int16)
    left = np.arange(len(f))
    for d in range(1, len(f)):
        left = left[left + d < len(f)]
        left = left[group[left] == group[left + d]]  # runs are contiguous: who ends here has no farther partner
        if not len(left):
            return
        a = left
        for p in range(table.shape[1]):
            a = a[np.abs(table[a, p] - table[a + d, p]) <= radius]
            if len(a) < 64:
                break
        a = a[np.bitwise_count(f[a] ^ f[a + d]).sum(1) <= radius]
        if len(a):
            yield a, a + d


def forest(node: np.ndarray, f: np.ndarray, group: np.ndarray, radius: int, pivots: np.ndarray, m: np.ndarray | None = None, similarity: float = 0.0, tight: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it hangs together with in these buckets). With sizes m only pairs whose sizes allow the similarity count, and those of which neither is small must lie within ``tight``."""
    parent = np.arange(len(node))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in near_pairs(f, group, radius, pivots):
        open_ = parent[a] != parent[b]
        if m is not None and open_.any():
            a, b = a[open_], b[open_]
            least = np.minimum(m[a], m[b])
            open_ = (least >= similarity * np.maximum(m[a], m[b]) - 1e-9) & ((np.bitwise_count(f[a] ^ f[b]).sum(1) <= tight) | (least < SMALL))
        if open_.any():
            for x, y in zip(a[open_].tolist(), b[open_].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    if node[y] < node[x]:
                        x, y = y, x
                    parent[y] = x
            while (up := parent[parent]).tolist() != parent.tolist():
                parent[:] = up
    own = parent != np.arange(len(node))
    return node[own], node[parent[own]]


def bucket_edges(nodes: DataFrame, tables: list[tuple[int, int]], radius: int, width: int, alike: tuple[float, int, int] | None = None) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of all near pairs that share a key. nodes: node, f0..

    With alike = (similarity, radius of sets that are not small, number of tables they need) only pairs whose sizes m allow the similarity count; nodes: node, f0.., m.
    """
    names = [f"f{w}" for w in range(width)] + (["m"] if alike else [])
    keys = [F.struct(F.lit(t).alias("t"), F.col(f"f{w}").bitwiseAND(F.lit(_signed(mask))).alias("k")) for t, (w, mask) in enumerate(tables)]
    every_key = F.array(*keys)
    if alike and alike[2] < len(keys):  # who may meet a small set takes all tables
        every_key = F.when(F.col("m") < SMALL / alike[0] + 1, every_key).otherwise(F.array(*keys[: alike[2]]))
    keyed = nodes.select("node", *names, F.explode(every_key).alias("_k")).select("node", *names, "_k.t", "_k.k")
    heavy = stored(keyed.groupBy("t", "k").count().where(F.col("count") > MOST), "heavy-buckets")
    if n_heavy := heavy.count():
        chunks = heavy.select("t", "k", F.ceil(F.col("count") / F.lit(MOST)).cast("int").alias("_c"))
        keyed = keyed.join(F.broadcast(chunks) if n_heavy <= 100_000 else chunks, ["t", "k"], "left")
        mine = F.pmod(F.xxhash64("node"), F.coalesce(F.col("_c"), F.lit(1))).cast("int")
        keyed = keyed.withColumn("r", mine).withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_c"), F.lit(1)) - 1)))
        key = F.xxhash64("t", "k", F.least("r", "s"), F.greatest("r", "s"))
    else:
        key = F.xxhash64("t", "k")
    dealt = keyed.select(key.alias("g"), "node", *names)
    dealt = dealt.repartition("g").sortWithinPartitions("g")
    pivots = mixed(np.arange(1, PIVOTS * width + 1, dtype=np.uint64)).reshape(PIVOTS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on
            if cut:
                yield from done([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield from done(rest)

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        given = cols[1], np.stack(cols[2 : 2 + width], 1).view(np.uint64), cols[0], radius, pivots
        a, b = forest(*given, *cols[2 + width :], *alike[:2]) if alike else forest(*given)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of it) of every node of the edges, by large-star and small-star rounds until nothing changes.

    A star's edges meet its least node in parts, so a large component's centre is no task of its own.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    edges, folder = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        big = split_join(both, least, ["a"], "b", 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = split_join(big, low, ["a"], "b", 2 * seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        old = folder
        edges, folder = written(small.distinct(), "edges")
        removed(edges.sparkSession, old)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def first_of(*more: str):
    """The least key, null only if there is no other, with ``more`` of its row."""
    return F.min(F.struct(F.col("key").isNull().alias("none"), "key", *more)).alias("first")


def classes(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """node, first (of the whole component), n (rows of the node). nodes: node, first, n; a large component's nodes are dealt out."""
    of = stored(nodes.join(comp, "node", "left").select("node", "first", F.col("n").alias("rows"), F.coalesce("component", "node").alias("c")), "classes")
    least = of.groupBy("c").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return stored(split_join(of.select("node", "rows", "c"), least, ["c"], "node", of.count()).select("node", "first", F.col("rows").alias("n")), "classes")


def near_copies(docs: DataFrame, shingle: int = 4, radius: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable) for every row; links are fingerprints at most ``radius`` bits apart, none is lost.

    Null and empty texts have fingerprint zero and are linked like any other. A row without a key is
    linked too and gets its group's smallest key (null if nobody there has one). Ties and repeated
    rows give equal rows (a repeated key too); keys may be numbers or strings; an empty table gives an empty one; other columns are left out.
    """
    sig = stored(signatures(docs, shingle, text, key).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = stored(sig.groupBy("f0").agg(first_of(), F.count("*").alias("n")).withColumn("node", F.col("f0")), "fingerprints")
    n_nodes, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    comp = components(bucket_edges(nodes, exact_tables(n_nodes, radius), radius, 1))
    of = classes(nodes, comp).withColumnRenamed("node", "f0")
    out = split_join(sig, of, ["f0"], "row", total)
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("first.key").alias("component_id"))


#: Bits of the map of wanted rows, a fixed size: where it is full, more sets are shuffled and none is lost.
WANTED = 1 << 26
#: Words of the fingerprint that decides which pairs are counted exactly.
WIDE = 32
#: Shingles and texts of a part of a cluster, about: a larger cluster is many parts, and every two of them are a block.
PART, PART_ROWS = 500_000, 1024
#: What a marked table has besides the documents' own columns.
ROW, NODE, SIZE, BITS = "_simhash_row", "_simhash_node", "_simhash_size", "_simhash_f"


def shingle_sets(texts: list[str | None], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their digests, which stand for equal sets (64 bits)."""
    sets = [np.unique(shingle_hashes(t, n)) for t in texts]
    return sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def marked(docs: DataFrame, n: int, width: int, text: str) -> DataFrame:
    """The documents, all columns, and of each row's set of shingles the digest, the size and the fingerprint; rows are numbered. Written once."""
    own = [NODE, SIZE, *(f"{BITS}{w}" for w in range(width))]
    at = docs.columns.index(text)

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            sets, node = shingle_sets(part.column(at).to_pylist(), n)
            f = fingerprints(sets, width).view(np.int64)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(f[:, w]) for w in range(width))], names=[*part.schema.names, *own])

        return run

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in own)])
    return stored(docs.mapInArrow(by_slices(make, 256), schema).withColumn(ROW, F.monotonically_increasing_id()), "marked")


def wanted_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str) -> DataFrame:
    """wanted (node, row, others) with s, the row's shingle hashes, from the marked documents: shingles are made for the wanted rows only."""
    at = F.pmod(F.xxhash64("row"), F.lit(WANTED))
    bits = np.zeros(WANTED // 8, np.uint8)
    for r in wanted.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        bits = sent.value

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            where = part.column(1).to_numpy()
            part = part.take(pa.array(np.flatnonzero(bits[where >> 3] >> (where & 7).astype(np.uint8) & 1)))
            sets = shingle_sets(part.column(2).to_pylist(), n)[0]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["row", "s"])

        return run

    found = docs.select(F.col(ROW).alias("row"), F.col(text).alias("text")).select("row", at.alias("at"), "text").mapInArrow(by_slices(make, 256), "row long, s binary")
    return found.join(wanted, "row")


def linked(nodes: list[int], sets: list[np.ndarray], side: list[int], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose sets have the Jaccard similarity, exactly counted; between two sides only, if there are two.

    A wide fingerprint tells most pairs apart, and a row is held only against nodes that it does not hang together with yet, nearest first.
    """
    f, m, side = fingerprints(sets, WIDE), np.array([len(x) for x in sets]), np.array(side)
    wide, tight = (reach(apart(similarity, small), 64 * WIDE) for small in (True, False))
    two, label = bool((side != side[0]).any()), np.arange(len(nodes))
    for i in range(len(nodes)):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if two:
            rest = rest[side[rest] != side[i]]
        least, most = np.minimum(m[rest], m[i]), np.maximum(m[rest], m[i])
        rest, least = (x[least >= similarity * most - 1e-9] for x in (rest, least))
        d = np.bitwise_count(f[rest] ^ f[i]).sum(1)
        ok = d <= np.where(least < SMALL, wide, tight)
        for j in rest[ok][np.argsort(d[ok], kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            total = m[i] + m[j]
            if not total or (1 + similarity) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= similarity * total - 1e-9:
                label[label == label[j]] = label[i]
                yield max(nodes[i], nodes[j]), min(nodes[i], nodes[j])


def alike(docs: DataFrame, nodes: DataFrame, loose: DataFrame, n: int, similarity: float, text: str) -> DataFrame:
    """Edges between nodes of one cluster (loose: node, component) whose sets are alike. A cluster's nodes meet in blocks of two parts of about PART shingles, or PART_ROWS texts, each."""
    of = stored(loose.union(loose.select(F.col("component").alias("node"), "component")).distinct().join(nodes.select("node", "m", F.col("first.row").alias("row")), "node"), "clusters")
    sizes = of.groupBy("component").agg(F.ceil(F.greatest(F.sum("m") / PART, F.count("*") / PART_ROWS)).cast("int").alias("parts"), F.count("*").alias("n"))
    wanted = split_join(of.select("node", "row", "component"), sizes, ["component"], "node", of.count())
    wanted = stored(wanted.select("node", "row", "component", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("r")), "wanted")
    met = wanted_sets(docs, wanted, n, text).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(F.col("component").alias("g"), F.least("r", "o").alias("p"), F.greatest("r", "o").alias("q"), "r", "node", "s").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def edges() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                got = list(linked([x[1] for x in held], [np.frombuffer(x[2], np.uint64) for x in held], [x[0] for x in held], similarity))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in slices(batches):
            for g, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, p, q) != key:
                    yield from edges()
                    key, held = (g, p, q), []
                held.append(row)
        yield from edges()

    return stored(met.mapInArrow(run, "a long, b long"), "alike")


def similar_rows(docs: DataFrame, shingle: int, similarity: float, width: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The marked documents, and row, key, first (least key of the group and its first row) of every row.

    Links are pairs of texts whose sets of shingles have this Jaccard similarity at least.
    No other pair is linked: fingerprints only propose which texts may hang together, and all pairs of what they join are then decided by exact counts. Of pairs at exactly
    ``similarity`` 0.99 or more are proposed, of closer ones more. Texts with equal sets are one node.
    """
    shares = apart(similarity, True), apart(similarity)
    wide, tight = (reach(s, 64 * width) for s in shares)
    names = [f"f{w}" for w in range(width)]
    docs = marked(docs, shingle, width, text)
    sig = docs.select(F.col(ROW).alias("row"), F.col(key).alias("key"), F.col(NODE).alias("node"), F.col(SIZE).cast("int").alias("m"), *(F.col(f"{BITS}{w}").alias(x) for w, x in enumerate(names)))
    nodes = stored(sig.groupBy("node").agg(F.first("m").alias("m"), *(F.first(x).alias(x) for x in names), first_of("row"), F.count("*").alias("n")), "fingerprints")
    n_nodes, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tables = sampled_tables(n_nodes, width, shares[0], wide)
    some = len(sampled_tables(n_nodes, width, shares[1], tight))
    loose = components(bucket_edges(nodes, tables, wide, width, (similarity, tight, some)))
    comp = components(alike(docs, nodes, loose, shingle, similarity, text))
    return docs, split_join(sig.select("row", "key", "node"), classes(nodes.select("node", "first", "n"), comp), ["node"], "row", total).drop("node")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, component_id (smallest key of the group, null if nobody there has one) of every row: see similar_rows().

    Texts without words are one group. Repeated rows give equal rows; an empty table gives an empty one; other columns are left out.
    """
    return similar_rows(docs, shingle, similarity, width, text, key)[1].select(F.col("key").alias(key), F.col("first.key").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = 6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, all columns, exactly one row of each group: that with the smallest key, of repeated or missing keys the first row. See similar_rows()."""
    rows, found = similar_rows(docs, shingle, similarity, width, text, key)
    gone = stored(found.where("row != first.row").select(F.col("row").alias(ROW)), "near-duplicates")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
