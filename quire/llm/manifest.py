"""Merkle manifest of a data set: a tree of sixteens for each source, one over the sources, kept as append logs in postorder.

``ranked`` numbers the leaves of every tree by a range sort and offsets of runs. ``built`` gives each aligned block of
16**3 nodes to a builder, which appends leaves and inner nodes in the order in which they are complete; the roots of the blocks
are the next round's nodes, until every tree has one. Where a node stands in its tree's log is a closed formula of
level, index and number of leaves (``place``), so a proof asks the log for siblings by their places: no node holds a link.
Blocks are tasks of their own, so a source of any size is built and proved by many; no log, tree or source is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Children of a node as a power of two, levels that a builder adds, and so the nodes that it is given at most.
BITS, STEP = 4, 3
BLOCK = 1 << BITS * STEP
LOG = "g string, size long, level int, index long, pos long, digest binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree of so many leaves."""
    return -(-size >> BITS * level)


def height(size: int) -> int:
    level = 0
    while width(size, level) > 1:
        level += 1
    return level


def place(size: int, level: int, index: int) -> int:
    """Where a node stands in its tree's log, from 0: when it is complete all its leaves are there, and of every level the nodes that were complete before it."""
    last = min(index + 1 << BITS * level, size)
    return sum(width(last, m) if m <= level else last - 1 >> BITS * m for m in range(height(size) + 1)) - 1


def together(digests: list[bytes]) -> bytes:
    """SHA-256 of digests one after the other as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def completed(size: int, base: int, first: int, digests: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Level, index and digest of the nodes over an aligned run of a level's nodes (from ``first`` on), these included, in the order in which they are complete."""
    top, last = min(height(size), base + STEP), width(size, base) - 1
    open_: list[list[bytes]] = [[] for _ in range(STEP + 1)]
    for index, digest in enumerate(digests, first):
        up = 0
        yield base, index, digest
        open_[0].append(digest)
        while base + up < top and (len(open_[up]) == 1 << BITS or index == last):
            digest = together(open_[up])
            open_[up].clear()
            up += 1
            yield base + up, index >> BITS * up, digest
            open_[up].append(digest)


def siblings(size: int, level: int, index: int) -> list[int]:
    """Indices of the others of a node's run."""
    start = index >> BITS << BITS
    return [i for i in range(start, min(start + (1 << BITS), width(size, level))) if i != index]


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g and others) with index (from 0) and size in their tree by ``order``; equal rows are interchangeable.

    A range sort deals trees of any size over tasks; each task numbers its rows, and a run of one tree in one task starts where the runs before it end.
    """
    x = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    x = stored(x.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "manifest-order")
    runs = x.groupBy("g", "_part").agg(F.min("_row").alias("_lo"), F.count("*").alias("_n"))
    before = runs.select(F.col("g").alias("g0"), F.col("_part").alias("p0"), F.col("_n").alias("n0"))
    # a tree has no more runs than there are tasks
    totals = before.groupBy("g0").agg(F.array_sort(F.collect_list(F.struct("p0", "n0"))).alias("all"))
    at = runs.join(totals, F.col("g") == F.col("g0")).select("g", "_part", (F.aggregate(F.filter("all", lambda r: r["p0"] < F.col("_part")), F.lit(0).cast("long"), lambda a, r: a + r["n0"]) - F.col("_lo")).alias("_add"), F.aggregate("all", F.lit(0).cast("long"), lambda a, r: a + r["n0"]).alias("size"))
    return x.join(at, ["g", "_part"]).withColumn("index", F.col("_row") + F.col("_add")).drop("_part", "_row", "_add")


def blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of neighbouring rows that agree in their first columns; a group has a block's rows at most."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def built(leaves: DataFrame) -> DataFrame:
    """The logs of all trees over ranked leaves (g, index, size, digest): g, size, level, index, pos, digest."""
    nodes, base, log = leaves.select("g", "size", "index", "digest"), 0, None
    while True:

        def run(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for (g, size, _), rows in blocks(batches, 3):
                # what a round is given is in the log already, but for the leaves
                new = [n for n in completed(size, base, rows[0][0], [d for _, d in rows]) if not base or n[0] > base]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(new)), pa.array([size] * len(new), pa.int64()), pa.array([n[0] for n in new], pa.int32()), pa.array([n[1] for n in new], pa.int64()), pa.array([place(size, n[0], n[1]) for n in new], pa.int64()), pa.array([n[2] for n in new], pa.binary())], names=["g", "size", "level", "index", "pos", "digest"])

        work = nodes.select("g", "size", F.shiftright("index", BITS * STEP).alias("block"), "index", "digest")
        made = stored(work.repartition("g", "block").sortWithinPartitions("g", "block", "index").mapInArrow(run, LOG), "manifest-log")
        log = made if log is None else log.unionByName(made)
        base += STEP
        # trees that have more than one node at this level go on
        nodes = made.where((F.col("level") == base) & (F.col("size") > 1 << BITS * base)).select("g", "size", "index", "digest")
        if nodes.isEmpty():
            return log


def roots(log: DataFrame) -> DataFrame:
    """g, digest of the root of each tree: the last node of its log."""
    return log.groupBy("g").agg(F.max_by("digest", "pos").alias("digest"))


def upper(leaves: DataFrame, log: DataFrame) -> DataFrame:
    """g, block, level, slot, own, digest: for each block of leaves the siblings that its path has from the block's root up, found in the log by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                for level in range(STEP, height(size)):
                    index = block >> BITS * (level - STEP)
                    rows += [(g, block, level, i & 15, index & 15, place(size, level, i)) for i in siblings(size, level, index)]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["g", "block", "level", "slot", "own", "pos"])

    asked = leaves.where(f"size > {BLOCK}").select("g", "size", F.shiftright("index", BITS * STEP).alias("block")).distinct()
    asked = asked.mapInArrow(run, "g string, block long, level int, slot int, own int, pos long")
    return asked.join(log.where(f"level >= {STEP}").select("g", "pos", "digest"), ["g", "pos"]).select("g", "block", "level", "slot", "own", "digest")


def local_path(size: int, index: int, held: dict[int, bytes]) -> list[tuple[list[bytes], int]]:
    """Siblings inside a leaf's block, level by level, and how many of them come before it; held: the block's part of the log by place."""
    out = []
    for level in range(min(STEP, height(size))):
        at = index >> BITS * level
        out.append(([held[place(size, level, i)] for i in siblings(size, level, at)], at & 15))
    return out


def folded(leaf: bytes, path: list[tuple[list[bytes], int]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for others, own in path:
        leaf = together([*others[:own], leaf, *others[own:]])
    return leaf


def _whole(path: list[tuple[list[bytes], int]], rows: list[tuple], size: int, index: int) -> list[tuple[list[bytes], int]]:
    """A path inside a block and what the rows add above it; a run of one has no siblings and so no rows, but is folded like others."""
    above = {level: [] for level in range(STEP, height(size))}
    for level, slot, _, digest in sorted(rows):
        above[level].append((slot, digest))
    return path + [([d for _, d in above[level]], index >> BITS * level & 15) for level in sorted(above)]


def in_block(log: DataFrame) -> DataFrame:
    """g, block, place and digest of the nodes below the blocks' roots."""
    return log.where(f"level < {STEP}").select("g", F.expr(f"case level {' '.join(f'when {k} then shiftright(index, {BITS * (STEP - k)})' for k in range(STEP))} end").alias("block"), "pos", "digest")


#: What a row of a block's evidence is: a node of the block by place, a sibling above it, a sibling of the source's root, that root.
NODE, ABOVE, FOREST, SUBROOT = range(4)


def _evidence(df: DataFrame, kind: int) -> DataFrame:
    return df.select("g", "block", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(-1).cast(t).alias(c) for c, t in (("level", "int"), ("slot", "int"), ("own", "int"), ("pos", "long"))), "digest")


def forest_paths(sources: DataFrame, log: DataFrame) -> DataFrame:
    """source (a tree of documents), level, slot, own, digest: siblings of each source's root up to the whole root. sources: source, g, index, size, digest."""
    above = upper(sources, log)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held = {p: d for p, l, d in zip(right["pos"].to_pylist(), right["level"].to_pylist(), right["digest"].to_pylist()) if l < 0}
        rows = [r for r in zip(*(right[c].to_pylist() for c in ("level", "slot", "own", "digest"))) if r[0] >= 0]
        out = []
        for source, index, size in zip(*(left[c].to_pylist() for c in ("source", "index", "size"))):
            for level, (others, own) in enumerate(_whole(local_path(size, index, held), rows, size, index)):
                out += [(source, level, i + (i >= own), own, d) for i, d in enumerate(others)] or [(source, level, -1, 0, None)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["source", "level", "slot", "own", "digest"])

    left = sources.select("g", F.shiftright("index", BITS * STEP).alias("block"), "source", "index", "size")
    right = _evidence(in_block(log), NODE).unionByName(_evidence(above, ABOVE))
    return left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(run, "source string, level int, slot int, own int, digest binary")


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 over the five values, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, (doc_id, source, lang, n_chars, text))), 256))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """g (the source's tree; that of no source comes first), doc_id, digest, other (digest with A-Z of the text lowered where ``tampered`` holds)."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    c = {n: F.col(n) for n in names}
    other = F.when(tampered, leaf_digest(*(c[n] for n in names[:-1]), F.translate("text", UPPER, LOWER)))
    return docs.select(F.when(c["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), "source")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*c.values()).alias("digest"), other.alias("other"))


def manifest(docs: DataFrame, tampered: Column) -> dict[str, DataFrame]:
    """leaves (ranked), log (of the sources' trees), sources (ranked roots), forest (log of the tree over them)."""
    leaves = stored(ranked(leaves_of(docs, tampered), ["doc_id", "digest"]), "manifest-leaves")
    log = built(leaves)
    tops = roots(log).select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    sources = stored(ranked(tops, ["source"]), "manifest-sources")
    return {"leaves": leaves, "log": log, "sources": sources, "forest": built(sources)}


def proved(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, its source's root, the whole root, the digest of its proof's siblings, and the root that the proof
    gives for the text as found: where 5 divides crc32(doc_id) it was tampered with (its A-Z lowered).

    Null values are leaves like others (``-``), rows without a source a tree of their own, before the others; a null doc_id comes first and is not tampered
    with; of repeated doc_ids the leaves' order decides, equal rows stand side by side. A lone document is its source's root, a lone source
    the whole root, and a proof without siblings has the digest of nothing. An empty table gives an empty one; other columns are left out.
    """
    m = manifest(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    leaves, log, sources, forest = m["leaves"], m["log"], m["sources"], m["forest"]
    block = F.shiftright("index", BITS * STEP).alias("block")
    top = roots(forest).collect()  # one digest, or none
    if not top:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = bytes(top[0].digest)
    # a row for each block and level: small beside the leaves
    at = leaves.where(f"index % {BLOCK} = 0").select("g", block)
    paths = at.join(forest_paths(sources, forest).withColumnRenamed("source", "g"), "g")
    tops = at.join(sources.select(F.col("source").alias("g"), "digest"), "g")
    right = _evidence(in_block(log), NODE).unionByName(_evidence(upper(leaves, log), ABOVE)).unionByName(_evidence(paths, FOREST)).unionByName(_evidence(tops, SUBROOT))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        held, above, beyond, subroot = {}, [], [], b""
        for k, level, slot, own, pos, digest in zip(*(right[c].to_pylist() for c in ("kind", "level", "slot", "own", "pos", "digest"))):
            if k == NODE:
                held[pos] = digest
            elif k == ABOVE:
                above.append((level, slot, own, digest))
            elif k == FOREST:
                beyond.append((level, slot, own, digest))
            else:
                subroot = digest
        over = {}
        for level, slot, own, digest in sorted(beyond, key=lambda r: r[:2]):
            over.setdefault(level, ([], own))
            if digest is not None:
                over[level][0].append(digest)
        forest_path = [over[k] for k in sorted(over)]
        out = []
        for doc_id, index, size, leaf, other in zip(*(left[c].to_pylist() for c in ("doc_id", "index", "size", "digest", "other"))):
            path = _whole(local_path(size, index, held), above, size, index) + forest_path
            got = folded(other or leaf, path)
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), together([d for others, _ in path for d in others]).hex(), got.hex(), got == root))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    left = leaves.select("g", block, "doc_id", "index", "size", "digest", "other")
    return left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(run, RESULT)
