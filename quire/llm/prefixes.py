"""Conversation prefix trie by a splitter skeleton.

A conversation is its turns' digests one after the other, so that its prefixes are prefixes of a sortable text. Splitters cut the
sorted conversations into shards. A trie node can have members in two shards only if its path is a prefix of a splitter's path:
these nodes are the skeleton, a trie that is broadcast. A shard's task walks its sorted conversations with a stack of open nodes, finishes
every other node and gives its part of the skeleton's; those parts are added up along the skeleton. Copies of one conversation are cut
by their ids, so a conversation that a third of the rows repeat fills many shards, and its node is in the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Hexadecimal digits of a turn's digest (128 bits of SHA-256), conversations of a shard and splitter candidates a shard, about.
DIGEST, SHARD, CANDIDATES = 32, 100_000, 32
#: Turns that a head of a shared conversation has at most, and conversations that share one.
HEAD, SHARED = 6, 100
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
RESULT = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)
#: What a shard's row is: a finished node, its part of a skeleton node, ids that end in a skeleton node.
WHOLE, PART, ENDS = range(3)
SHARD_ROW = f"kind int, up long, seq long, text string, {RESULT}"
#: Ids of one ENDS row.
PIECE = 4096
LOWEST = -(1 << 63)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of d, the digest, and n, the code points of the text) in order. Turns of one number go by their digests; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    x = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), digest.alias("d"), F.length(text).cast("long").alias("n")).alias("t"))
    return x.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame, h: Column, base: Column) -> DataFrame:
    """conv_id, path, lens: the first h turns of conversation ``base`` (fewer if it has no more, none if it is absent), then the conversation's own after its first h."""
    own = conversations(turns).withColumn("h", h.cast("int")).withColumn("base", base)
    own = stored(own, "conversations")
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, HEAD).alias("head"))
    none = F.expr("cast(array() as array<struct<d:string,n:bigint>>)")
    x = own.join(heads, "base", "left").select("conv_id", F.concat(F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("t"))
    return x.select("conv_id", F.array_join("t.d", "").alias("path"), F.col("t.n").alias("lens"))


def common(a: str, b: str) -> int:
    """Turns that two paths share at their start."""
    n, most = 0, min(len(a), len(b)) // DIGEST
    while n < most and a[n * DIGEST : (n + 1) * DIGEST] == b[n * DIGEST : (n + 1) * DIGEST]:
        n += 1
    return n


def cuts(sample: list[tuple[str, int, list[int]]], shards: int) -> tuple[list[tuple[str, int]], dict[str, tuple[int, int]]]:
    """Splitters (path, conv_id) and the skeleton (path to number and code points of the last text) from sorted (path, conv_id, lens).

    A splitter between different conversations is the shortest path that keeps them apart, between copies the path and the id.
    """
    at, skeleton = [], {"": (0, 0)}

    def add(path: str, turns: int, lens: list[int]) -> None:
        for d in range(1, turns + 1):
            skeleton.setdefault(path[: d * DIGEST], (len(skeleton), lens[d - 1]))

    for k in range(1, shards):
        j = k * len(sample) // shards
        if not j or sample[j][:2] == sample[j - 1][:2]:
            continue
        (a, _, _), (b, conv, lens) = sample[j - 1], sample[j]
        n = common(a, b)
        cut = (b, conv) if a == b else (b[: (n + 1) * DIGEST], LOWEST)
        if not at or cut > at[-1]:
            at.append(cut)
            add(b, n, lens)
    return at, skeleton


class Open:
    """A node on the path of the conversation that a shard is at."""

    __slots__ = ("children", "convs", "ends", "hash", "kids", "last", "leaves", "least", "number", "saved")

    def __init__(self, number: int | None, last: int) -> None:
        self.number, self.last, self.convs, self.kids, self.leaves, self.saved, self.least = number, last, 0, 0, 0, 0, None
        self.children: list[list] = []
        self.ends: list[str] = []
        self.hash = None

    def seen(self, conv_id: int) -> None:
        self.least = conv_id if self.least is None else min(self.least, conv_id)


def walked(rows: Iterator[tuple[int, str, list[int], int]], skeleton: dict[str, tuple[int, int]]) -> Iterator[tuple]:
    """SHARD_ROW rows of sorted (shard, path, lens, conv_id) rows: every node outside the skeleton, parts and ends of those in it."""
    stack: list[Open] = []
    path, shard, seq = "", None, 0

    def ends(node: Open) -> Iterator[tuple]:
        nonlocal seq
        if node.ends:
            yield (ENDS, node.number, (shard << 32) + seq, ",".join(node.ends), *[None] * len(NODE))
            node.ends, seq = [], seq + 1

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            at = len(stack)
            if node.number is not None:
                yield from ends(node)
                yield (PART, node.number, None, None, node.least, at, None, node.convs, node.kids, node.leaves, node.saved, None)
            else:
                up = stack[-1]
                leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.last
                for child in node.children:
                    child[2] = node.least
                    yield (WHOLE, None, None, None, *child)
                row = [node.least, at, None, node.convs, node.kids, leaves, saved, (node.hash or hashlib.sha256()).hexdigest()]
                up.seen(node.least)
                up.convs, up.kids, up.leaves, up.saved = up.convs + node.convs, up.kids + 1, up.leaves + leaves, up.saved + saved
                if up.number is None:
                    up.children.append(row)
                else:
                    yield (WHOLE, up.number, None, None, *row)

    for to, new, lens, conv_id in rows:
        if to != shard:
            yield from close(0)
            stack, path, shard, seq = [Open(0, 0)], "", to, 0
        keep = common(path, new)
        yield from close(keep + 1)
        for d in range(keep + 1, len(lens) + 1):
            known = skeleton.get(new[: d * DIGEST])
            stack.append(Open(known[0] if known else None, lens[d - 1]))
        path, node = new, stack[-1]
        node.seen(conv_id)
        node.convs += 1
        if node.number is None:
            # ids of one path come in ascending order, so the hash is fed as they come
            node.hash = node.hash or hashlib.sha256()
            node.hash.update(b"%d" % conv_id if node.convs == 1 else b",%d" % conv_id)
        else:
            node.ends.append(str(conv_id))
            if len(node.ends) == PIECE:
                yield from ends(node)
    yield from close(0)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


SHARD_SCHEMA = pa.schema([("kind", pa.int32()), ("up", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), *((c, pa.string() if c == "ends_sha256" else pa.int64()) for c in NODE)])


def hashed(pieces: DataFrame) -> DataFrame:
    """up, sha: SHA-256 of each skeleton node's ids, piece after piece; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, state = None, None
            for up, _, text in _rows(batches):
                if up != key:
                    if state:
                        yield key, state.hexdigest()
                    key, state = up, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if state:
                yield key, state.hexdigest()

        yield from _batches(rows(), pa.schema([("up", pa.int64()), ("sha", pa.string())]))

    return pieces.select("up", "seq", "text").repartition("up").sortWithinPartitions("up", "seq").mapInArrow(run, "up long, sha string")


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, path, lens) rows, one row a conv_id: RESULT.

    What is broadcast, and collected for it, is CANDIDATES * shards conversations' paths at most; a shard holds SHARD conversations, about.
    """
    spark = paths.sparkSession
    paths = stored(paths, "conversation-paths")
    total = paths.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    shards = min(shards, total)
    drawn = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(CANDIDATES * shards).select("path", "conv_id", "lens").collect()
    splitters, skeleton = cuts(sorted((r.path, r.conv_id, r.lens) for r in drawn), shards)
    sent = spark.sparkContext.broadcast((splitters, skeleton))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value[0]
        for b in batches:
            shard = [bisect_right(at, k) for k in zip(b["path"].to_pylist(), b["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["path"], b["lens"], b["conv_id"]], names=["shard", "path", "lens", "conv_id"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(walked(_rows(batches), sent.value[1]), SHARD_SCHEMA)

    dealt = paths.mapInArrow(deal, "shard int, path string, lens array<long>, conv_id long").repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = stored(dealt.mapInArrow(walk, SHARD_ROW), "trie-shards")

    # the skeleton is as small as what was broadcast: its parts are added up along it
    up = {n: skeleton[p[:-DIGEST]][0] if p else None for p, (n, _) in skeleton.items()}
    over = {n: [n] for n in up}
    for n in sorted(up):
        if up[n] is not None:
            over[n] = [n, *over[up[n]]]
    bones = spark.createDataFrame([(n, up[n], len(p) // DIGEST, last, over[n]) for p, (n, last) in skeleton.items()], "up long, parent long, depth long, last long, over array<long>")
    parts = made.where(F.col("kind") == PART).groupBy("up").agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("convs"), F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kids = bones.where("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("bone_kids"))
    x = bones.join(F.broadcast(parts), "up", "left").join(F.broadcast(kids), "up", "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.coalesce("bone_kids", F.lit(0)))
    x = stored(x, "trie-bones")
    members = x.select(F.explode("over").alias("up"), "least", "convs").groupBy("up").agg(F.min("least").alias("conv_id"), F.sum("convs").alias("n_convs"))
    x = x.join(F.broadcast(members), "up").withColumn("leaves", F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("last"))
    x = stored(x, "trie-members")
    sums = x.select(F.explode("over").alias("up"), "leaves", "saved").groupBy("up").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    least = x.select(F.col("up").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    skeletal = x.join(F.broadcast(sums), "up").join(F.broadcast(least), "parent", "left").join(F.broadcast(hashed(made.where(F.col("kind") == ENDS))), "up", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(none))).select(*NODE)
    whole = made.where(F.col("kind") == WHOLE).join(F.broadcast(least.withColumnRenamed("parent", "up").withColumnRenamed("parent_conv_id", "of")), "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of")).select(*NODE)
    return whole.unionByName(skeletal)


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """Every distinct start of the rebuilt conversations as a node; see ``rebuilt`` and ``trie``.

    Conversation c begins with the first crc32(c) % 6 turns of conversation c - c % 100. A turn without a number comes first, turns of one
    number go by the digests of role and text, repeated rows are turns of their own, null roles and texts are empty, texts of any length count whole. Rows without a
    conv_id take no part; a table with none but these gives an empty result. Other columns are left out.
    """
    c = F.col("conv_id")
    return trie(rebuilt(turns, F.crc32(c.cast("string")) % HEAD, c - c % SHARED), shards)
