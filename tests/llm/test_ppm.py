"""PPM scores against a plain trie walk, and the base score against counting."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import ppm, queries


class Plain:
    def __init__(self, texts, order):
        self.order, self.seen = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            data = [255] * order + list(t) + [254]
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[k][tuple(data[i - k : i])][data[i]] += 1

    def score(self, t):
        data, total = [255] * self.order + list(t) + [254], 0.0
        for i in range(self.order, len(data)):
            gone, p = set(), 1.0
            for k in range(self.order, -1, -1):
                c = {s: n for s, n in self.seen[k].get(tuple(data[i - k : i]), {}).items() if s not in gone}
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if data[i] in c:
                    p *= c[data[i]] / (n + d)
                    break
                p *= d / (n + d)
                gone |= set(c)
            else:
                p /= 255 - len(gone)
            total += math.log10(p)
        return total


def held(i, m=7):
    return zlib.crc32(str(i).encode()) % m == 2


def test_query_against_plain_trie(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Plain([(t or "").encode() for i, t in docs if not held(i)], ppm.ORDER)
    words = Counter(w for i, t in docs if not held(i) for w in t.encode().lower().split())
    ends = sum(not held(i) for i, _ in docs)
    n, v = sum(words.values()) + ends, len(words) + 1
    texts = dict(docs)
    for r in queries.op8_ppm_trie(spark, sf).collect():
        w = texts[r.doc_id].encode().lower().split()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(x in words for x in w) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)))
        if len(texts[r.doc_id]) < 4000:
            assert r.score == pytest.approx(plain.score(texts[r.doc_id].encode()), rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_of_a_context_sum_to_one(order):
    texts = [b"abracadabra", b"abcabd", b""]
    g, _ = ppm.grams(texts, order)
    k, c = np.unique(g, return_counts=True)
    model = ppm.Model(k, c, order)
    for context in (b"abra", b"zzzz", b"\xff\xff\xff\xff", b"xabc"):
        base = int.from_bytes(context[-order:], "big") << 8
        p = 10 ** model.logp(np.array([base | s for s in range(255)], np.uint64))
        assert p.sum() == pytest.approx(1)


def test_what_tasks_hold_changes_no_score(spark, sf, monkeypatch):
    """Few words and entries held, most joined by shuffles and worked out in small groups, against all held."""
    rows = [(i, " ".join(["often"] * 9 + [f"w{i % 11}", f"only{i}", "long" * 50 + str(i % 3)])) for i in range(80)] + [(5, "again again"), (5, "again again"), (None, "no key"), (None, None)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/documents.parquet")):
        every = sorted((tuple(r) for r in ppm.score(docs, grams_held=10**9, words_held=10**9).collect()), key=str)
        monkeypatch.setattr(ppm, "CHUNK", 50)
        few = sorted((tuple(r) for r in ppm.score(docs, grams_held=100, words_held=3).collect()), key=str)
        none = sorted((tuple(r) for r in ppm.score(docs, grams_held=0, words_held=0).collect()), key=str)
        for other in (few, none):
            assert [r[:5] for r in other] == [r[:5] for r in every] and len(other) == docs.count()
            assert [x for r in other for x in r[5:]] == pytest.approx([x for r in every for x in r[5:]])
        assert any(r[3] < r[2] for r in few)


def test_a_group_of_contexts_is_worked_out_as_the_whole_trie():
    texts = [b"abracadabra", b"abcabd", b"the cat sat on the mat", b""]
    k, c = np.unique(ppm.grams(texts, 4)[0], return_counts=True)
    low = np.bincount((k & np.uint64(0xFFFF)).astype(int), c, minlength=1 << 16).astype(np.int64)
    asked = np.unique(np.r_[k, ppm.grams([b"abrbcadxthe bat \xc3\xa9"], 4)[0]])
    ends = asked >> np.uint64(8) & np.uint64(0xFFFF)
    whole = ppm.Model(k, c, 4).logp(asked)
    for e in np.unique(ends):
        mine = k >> np.uint64(8) & np.uint64(0xFFFF) == e
        assert ppm.Model(k[mine], c[mine], 4, low).logp(asked[ends == e]) == pytest.approx(whole[ends == e])


def test_edges(spark):
    rows = [(i, "abc " * 5) for i in range(40)] + [(100, None), (101, ""), (102, "x" * 100000), (102, "x" * 100000), (103, "\u0000\U0001F600")]
    got = ppm.score(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (100, 101)} == {1}
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
