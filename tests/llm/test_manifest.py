"""The manifest against a plain tree, its logs' places, and proofs on edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def climb(nodes):
    """Levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees[s] = climb([plain_leaf(r, r[4]) for r in by[s]])
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            leaf = trees[s][0][i]
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            got = plain_leaf(r, text)
            for a, b in path:
                got = h(*a, got, *b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), got, got == top[-1][0]))
    return out


def check(spark, rows, **parts):
    got = manifest.proved(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_against_plain_trees(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 1), ("b", 16), ("c", 17), ("é", 300), ("Z", 33), (None, 40)):
        rows += [(len(rows) + k, s, rng.choice(["en", None]), k, rng.choice(["Ab C", "x" * 5000, "", None, "É Ü"])) for k in range(n)]
    # null and repeated ids, equal rows, an empty source beside a missing one
    rows += [(None, "b", None, None, None), (None, "b", "en", 1, "T"), (7, "b", "en", 1, "Same"), (7, "b", "en", 1, "Same"), (7, "b", "en", 1, "Other"), (9, "", "", 0, "")]
    check(spark, rows)


def test_trees_beyond_a_builder(spark):
    """Two rounds of builders in the documents' tree and in the sources' tree."""
    check(spark, [(k, "hot", "en", k, f"T{k}") for k in range(4096 + 17)] + [(k, f"s{k}", "en", 1, "One") for k in range(4100)])


def test_one_document_and_none(spark):
    check(spark, [(5, "a", "en", 1, "X")])
    assert manifest.proved(spark.createDataFrame([], COLUMNS)).count() == 0


def test_clashing_columns(spark):
    rows = [(k, "a", "en", 1, "T") for k in range(20)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("g", F.lit(1)).withColumn("index", F.lit(2)).withColumn("digest", F.lit("x")).withColumn("leaf", F.lit("y"))
    assert sorted(r.doc_id for r in manifest.proved(df).collect()) == list(range(20))


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 256, 257, 300, 4096, 4097, 5000])
def test_places_are_postorder(size):
    """A recursive postorder walk meets the nodes at the places that the formula gives, and a builder appends them in that order."""

    def walk(level, index):
        if level:
            for c in range(index * 16, min(index * 16 + 16, manifest.width(size, level - 1))):
                yield from walk(level - 1, c)
        yield level, index

    order = list(walk(manifest.height(size), 0))
    assert [manifest.place(size, *n) for n in order] == list(range(len(order)))
    run = [(lv, i) for lv, i, _ in manifest.completed(size, 0, 0, [b"\0" * 32] * min(size, manifest.BLOCK))]
    assert run == order[: len(run)]


def test_log_is_whole(spark):
    rows = [(k, "a" if k % 3 else "b", "en", 1, f"t{k}") for k in range(900)]
    m = manifest.manifest(spark.createDataFrame(rows, COLUMNS), F.lit(False))
    for g, n in (("sa", 600), ("sb", 300)):
        pos = [r.pos for r in m["log"].where(F.col("g") == g).orderBy("pos").collect()]
        assert pos == list(range(sum(manifest.width(n, k) for k in range(manifest.height(n) + 1))))
