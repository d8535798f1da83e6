"""Leaked test items: WAND against scoring everything, planted passages, edges."""

import random

import numpy as np

from quire.llm import decontaminate as dc
from quire.llm import queries


def made(n=60, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    common = vocab[:20]
    text = lambda k: " ".join(rng.choice(common if rng.random() < 0.5 else vocab) for _ in range(k)) + ". " + " ".join(rng.choice(vocab) for _ in range(8)) + "."
    return rng, vocab, [(i, text(rng.randint(10, 100))) for i in range(n)]


def indexed(items, threshold=dc.THRESHOLD):
    parts = [s for _, t in items for s in dc.segments(dc.words(t))]
    df = dc.Counter(t for s in parts for t in set(s))
    return dc.Index(items, df, len(parts), sum(map(len, parts)) / len(parts), threshold), parts, df


def test_search_loses_nothing(monkeypatch):
    """Every segment's score by the plain formula, against what the block bounds let through."""
    rng, vocab, items = made()
    index, parts, df = indexed(items, 0.2)
    n, mean = len(parts), sum(map(len, parts)) / len(parts)
    weights = []
    for s in parts:
        raw = {t: dc.math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (dc.K1 + 1) / (c + dc.K1 * (1 - dc.B + dc.B * len(s) / mean)) for t, c in dc.Counter(s).items()}
        weights.append({t: v / sum(raw.values()) for t, v in raw.items()})
    seen = 0
    for k in range(300):
        monkeypatch.setattr(dc, "CELLS", (1 << 21, 64)[k % 2])
        w = [*dc.words(rng.choice(items)[1])[: rng.randint(3, 40)], *(rng.choice(vocab) for _ in range(30))][: dc.WINDOW]
        ids = np.array([index.term.get(x, -1) for x in w])
        want = {s: v for s, own in enumerate(weights) if (v := sum(own.get(t, 0.0) for t in set(w))) >= 0.2}
        window, seg, score = index.search(ids, np.full(len(ids), 7))
        for at in (6, 7):
            got = dict(zip(seg[window == at].tolist(), score[window == at].tolist()))
            assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-9 for s in got)
        seen += len(want)
    assert seen > 300


def brute(docs, items):
    out = set()
    for i, t in items:
        q, a = (dc.shingles(dc.words(x)) for x in dc.question_answer(t))
        for d, text in docs:
            w = dc.words(text)
            share = lambda s: len(s & dc.shingles(w, len(next(iter(s))))) / len(s) if s else 0
            if q and share(q) >= 0.5 and (share(a) >= 0.5 or share(q) >= 0.75 or not a):
                out.add((d, i))
    return out


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op4_bm25_wand(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_planted_and_edges(spark, monkeypatch):
    rng, vocab, items = made()
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    want = set()
    for i in range(0, 30):
        w = docs[i][1].split()
        at = rng.randint(0, len(w))
        docs[i] = (i, " ".join(w[:at]) + " " + items[i][1].upper().replace(" ", "\n ") + " " + " ".join(w[at:]))
        want.add((i, i))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "x " * 50000 + items[3][1])]
    want.add((103, 3))
    docs += [(None, "before " + items[4][1]), (None, "nothing here"), (104, items[5][1]), (104, items[5][1])]
    want |= {(None, 4), (104, 5)}
    d, b = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    rows = sorted((tuple(r) for r in dc.contaminated(d, b).collect()), key=str)
    assert {r[:2] for r in rows} == want and len(rows) == len(want) + 1
    kept = sorted((r.doc_id or -1, r.item_id) for r in dc.without_contaminated(d, b).collect())
    assert kept == sorted((i or -1, 7) for i, t in docs if (i, t) == (None, "nothing here") or i is not None and not any(i == j for j, _ in want))
    monkeypatch.setattr(dc, "SHARD", 2000)
    assert sorted((tuple(r) for r in dc.contaminated(d, b).collect()), key=str) == rows
    assert sorted((r.doc_id or -1, r.item_id) for r in dc.without_contaminated(d, b).collect()) == kept
    assert dc.contaminated(d.limit(0), b).count() == 0 and dc.contaminated(d, b.limit(0)).count() == 0
    assert dc.without_contaminated(d, b.limit(0)).count() == len(docs)
