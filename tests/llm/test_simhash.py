"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import xxhash

from quire.llm import queries, simhash


def brute(rows, n=4, radius=4):
    fps = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in near:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in ids}


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_pivots(spark, sf).collect()} == brute(rows)


def test_edges_and_chains(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(9, None), (8, ""), (7, " \n"), (6, "one"), (5, "one"), (4, "a b c"), (1 << 40, "x " * 20000)]
    for k in range(30):
        words[k * 7] = f"z{k}"
        rows.append((100 + k, " ".join(words)))
    got = simhash.near_copies(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == brute(rows)
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 16)
    rng = random.Random(3)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 300:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) if rng.random() < 0.7 else rng.getrandbits(64))
    f = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, f0 long")
    comp = {i: i for i in range(len(f))}
    comp |= {r.node: r.component for r in simhash.components(simhash.bucket_edges(nodes, simhash.exact_tables(len(f), 4), 4, 1)).collect()}
    want = {i: i for i in range(len(f))}
    for _ in range(len(f)):
        new = {i: min(want[j] for j in range(len(f)) if int(f[i] ^ f[j]).bit_count() <= 4) for i in want}
        if new == want:
            break
        want = new
    assert comp == want


def test_similar_groups_find_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(3000)]
    rows, truth = [], {}
    for g in range(40):
        words = [rng.choice(vocab) for _ in range(400)]
        for c in range(3):
            copy = list(words)
            for at in rng.sample(range(400), 4 * c):
                copy[at] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
            truth[len(rows) - 1] = g
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(truth[i] == truth[c] for i, c in got.items())
    assert sum(c != i for i, c in got.items()) >= 76


def test_similar_groups_decide_by_exact_similarity(spark):
    """Pairs that share 5-word shingles in a known share: each is linked exactly from 0.8 on."""
    rows, want = [], {}
    for pair in range(200):
        j = (0.70, 0.79, 0.80, 0.85)[pair % 4]
        shared = round(360 * j / (1 + j) * 2) // 2  # of 180 shingles on either side: shared / (360 - shared)
        while shared / (360 - shared) < j:
            shared += 1
        shared -= j == 0.79  # under it, not above
        base = [f"p{pair}w{k}" for k in range(184)]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(base[: shared + 4] + [f"q{pair}w{k}" for k in range(180 - shared)]))]
        a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows[-2:])
        want[pair] = len(a & b) / len(a | b) >= 0.8
        assert abs(len(a & b) / len(a | b) - j) < 0.012
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {p: got[2 * p + 1] == 2 * p for p in want}
    assert not [p for p in want if linked[p] and not want[p]]
    assert sum(linked.values()) >= 0.98 * sum(want.values())


def test_similar_groups_count_a_repeated_shingle_once(spark):
    own = [[f"d{i}w{k}" for k in range(100)] for i in range(2)]
    line = "the same line again and again ".split()
    rows = [(i, " ".join(own[i] + line * 200)) for i in range(2)] + [(2, " ".join(own[0] + line * 20)), (3, " ".join(own[1] + line * 3))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def brute_groups(rows, n=5, similarity=0.8):
    """Smallest key of every row's group by all pairs; rows: (key or None, text)."""
    sets = [set(simhash.shingle_hashes(t, n).tolist()) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        old = list(comp)
        for a in range(len(rows)):
            for b in range(a):
                union = len(sets[a] | sets[b])
                if not union or len(sets[a] & sets[b]) / union >= similarity - 1e-12:
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    return comp


def test_null_and_repeated_keys(spark):
    """Rows without a key and with repeated keys, near and equal, against all pairs; exactly one row of a group stays."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for g in range(12):
        w = [rng.choice(words) for _ in range(120)]
        for c in range(4):
            w = list(w)
            w[rng.randrange(120)] = f"x{g}{c}"
            texts.append(" ".join(w))
    keys = [None, 5, 5, 9] * 6 + [None, None, None, None] * 2 + [7, 7, None, 7] * 4
    rows = list(zip(keys, texts)) + [(5, texts[1]), (None, texts[1]), (3, None), (None, ""), (3, " ")]
    df = spark.createDataFrame([(k, t, i, 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, row int, node int")
    comp = brute_groups(rows)
    least = {c: min((k for k, d in zip((k for k, _ in rows), comp) if d == c and k is not None), default=None) for c in comp}
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.similar_groups(df).collect())
    assert got == sorted((str(k), str(least[c])) for (k, _), c in zip(rows, comp))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    seen = [(comp[r.row], r.doc_id) for r in kept.collect()]
    assert sorted(map(str, seen)) == sorted(str((c, least[c])) for c in set(comp))
    near = simhash.near_copies(df)
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    least = {c: min((rows[i][0] for i in want if want[i][1] == c and rows[i][0] is not None), default=None) for _, c in want.values()}
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near.collect()) == sorted((str(rows[i][0]), f, str(least[c])) for i, (f, c) in want.items())
    named = spark.createDataFrame([(f"k{k}" if k is not None else None, t) for k, t in rows], "doc_id string, text string")
    assert simhash.near_copies(named).count() == len(rows) == simhash.similar_groups(named).count()


def test_recall_against_all_pairs(spark, sf):
    """The groups of the given documents are those of all pairs; 0.9 of the links at least is asked for."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    comp = brute_groups(rows)
    want = {k: min(rows[j][0] for j, d in enumerate(comp) if d == comp[i]) for i, (k, _) in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    linked = [i for i in want if want[i] != i]
    assert linked and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)


def test_clusters_in_parts(spark, monkeypatch):
    """One topic's texts, many of them alike at 0.5 to 0.9 to one another: the same groups as by all pairs, in one block or in many."""
    rng = random.Random(8)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    comp = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shingles, texts in ((500_000, 1024), (300, 1024), (500_000, 7)):
        monkeypatch.setattr(simhash, "PART", shingles)
        monkeypatch.setattr(simhash, "PART_ROWS", texts)
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == dict(enumerate(comp))
    assert 3 < len(set(comp)) < 80


def test_linked_is_a_forest():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(60)], np.uint64)) for _ in range(40)]
    nodes = [1000 - k for k in range(40)]
    for side in ([0] * 40, [k % 2 for k in range(40)]):
        got = list(simhash.linked(nodes, sets, side, 0.8))
        assert len(got) < 40 and len({*got}) == len(got) and all(a > b for a, b in got)
        for a, b in got:
            x, y = (set(sets[nodes.index(n)].tolist()) for n in (a, b))
            assert len(x & y) >= 0.8 * len(x | y) and (side[0] == side[1] or (a - b) % 2)
