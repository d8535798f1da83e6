"""The prefix trie against a plain one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import prefixes

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()[:32]
    for c in own:
        own[c] = [t[1:] for t in sorted(own[c], key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))]
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        k = kids.get(p, [])
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(sums[c][1] for c in k)
        sums[p] = (sum(sums[c][0] for c in k) or 1, saved)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(k), *sums[p], sha))
    return sorted(out, key=str)


def check(spark, rows, shards):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("path", F.lit("p")).withColumn("lens", F.lit(1)).withColumn("base", F.lit(0))
    got = prefixes.conversation_trie(df, shards)
    assert got.columns == list(prefixes.NODE)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def made(n, seed, words=3, most=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é😀"][:words])))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_against_plain_trie(spark, shards):
    check(spark, made(400, 1), shards)


def test_copies_fill_shards(spark):
    """A third of the conversations are one and the same, and so is their last node's list of ids."""
    rows = [r for r in made(120, 2) if r[0] % 3] + [(c, t, "user", f"same {t}") for c in range(0, 120, 3) for t in range(4)]
    check(spark, rows, 16)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (7, 0, "assistant", "z"), (7, 1, "", "long " * 20000), (-5, 0, "u", "n"), (-150, 3, "u", "n"), (101, 0, "u", "q"), (300, 0, "u", "b"), (301, 0, "u", "c"), (305, 0, "u", "c")]
    check(spark, rows, 4)
    assert prefixes.conversation_trie(spark.createDataFrame(rows[:1], COLUMNS)).count() == 0
    assert prefixes.conversation_trie(spark.createDataFrame([], COLUMNS)).count() == 0


def test_pieces_of_ids(spark, monkeypatch):
    """Ids of a skeleton node are hashed over pieces and shards."""
    monkeypatch.setattr(prefixes, "PIECE", 2)
    rows = [(c, 0, "u", "t") for c in range(1, 60)]
    out = list(prefixes.walked(iter([(c // 20, "a" * 32, [1], c) for c in range(1, 60)]), {"": (0, 0), "a" * 32: (1, 1)}))
    pieces = [r[3] for r in sorted((r for r in out if r[0] == prefixes.ENDS), key=lambda r: r[2])]
    assert ",".join(pieces) == ",".join(map(str, range(1, 60))) and max(p.count(",") for p in pieces) == 1
    check(spark, rows, 7)


def test_skeleton_is_what_splitters_share():
    a, b, c = "a" * 32, "b" * 32, "c" * 32
    sample = [(a + b, 1, [1, 2]), (a + b, 5, [1, 2]), (a + c, 2, [1, 3]), (b, 9, [4])]
    at, skeleton = prefixes.cuts(sample, 4)
    assert at == [(a + b, 5), (a + c, prefixes.LOWEST), (b, prefixes.LOWEST)]
    assert skeleton == {"": (0, 0), a: (1, 1), a + b: (2, 2)}
