"""WARC round trips and exact nearest neighbours against brute force."""

import base64
import gzip
import hashlib

import numpy as np

from quire.llm import neighbours, queries, warc


def brute_pages(rows):
    top = {}
    for i, html in rows:
        top[html or ""] = max(i, top.get(html or "", i))
    return sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]) for i, h in rows)


def test_warc_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r)[:5] for r in queries.op2_warc_members(spark, sf).collect()) == brute_pages(rows)


def test_warc_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (4, "é中" * 200000), (5, "é中" * 200000), (6, "x"), (-7, "x")]
    df = spark.createDataFrame([(i, None if i == 6 else "http://x/\r\ny", h, "z") for i, h in rows], "page_id long, url string, html string, payload string")
    assert sorted(tuple(r)[:5] for r in warc.round_trip(df).collect()) == brute_pages(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_and_missing_page_ids(spark, monkeypatch):
    """Common payloads dealt out, null and repeated page_ids, records spread over many archives."""
    from quire.llm import common

    monkeypatch.setattr(common, "TOGETHER", 4)
    rows = [(k, f"p{k % 3}" if k % 2 else "same") for k in range(60)] + [(None, "same"), (None, "lone"), (None, "nobody"), (None, "nobody"), (59, "p2"), (59, "p2")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(5)
    top = {h: max((i for i, x in rows if x == h and i is not None), default=None) for _, h in rows}
    want = sorted(str((i, len(h), "response" if i == top[h] else "revisit", None if i == top[h] else top[h])) for i, h in rows)
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.round_trip(df).collect()) == want


def test_warc_index_and_members(spark, tmp_path):
    """The index names every member's place; a revisit keeps its heads and drops its payload."""
    df = spark.createDataFrame([(k, None if k % 4 == 0 else f"http://h/{k}", f"page {k % 7} " * 50) for k in range(40)], "page_id long, url string, html string").repartition(3)
    places = warc.write(df, f"file://{tmp_path}/whole")
    made = warc.normalise(places, warc.repeats(places), f"file://{tmp_path}/whole", f"file://{tmp_path}/members").collect()
    lines = [x.split("\t") for f in (tmp_path / "members").glob("*.idx") for x in f.read_text().splitlines()]
    assert len(lines) == 40 == sum(r.n_records for r in made)
    for name, offset, length, page, kind in lines:
        data = gzip.decompress((tmp_path / "members" / name).read_bytes()[int(offset) : int(offset) + int(length)])
        fields, block = warc.parsed(data)
        assert fields["warc-record-id"] == f"<urn:page:{page}>" and fields["warc-type"] == kind == ("response" if int(page) >= 33 else "revisit")
        assert (f"page {int(page) % 7} ".encode() in block) == (kind == "response") and ("warc-target-uri" in fields) == (int(page) % 4 > 0)


def test_split_records_at_any_cut():
    recs = [warc.record(i, "u", b"p" * i, "D", None if i % 2 else 9) for i in range(20)]
    data = gzip.compress(b"".join(recs[:10])) + gzip.compress(b"".join(recs[10:]))

    class Source:
        at = 0

        def read(self, n):
            self.at += 7
            return data[self.at - 7 : self.at]

    assert [r + b"\r\n\r\n" for r in warc.split_records(warc.inflated(Source()))] == recs


def brute_near(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = set()
    for qi, q in good:
        if qi % 20 == 0:
            s = sorted((-float(np.cumsum(q * x)[-1]), i) for i, x in good if i != qi)
            out |= {(qi, r + 1, i, -d) for r, (d, i) in enumerate(s[:k])}
    return out


def test_neighbours_query(spark, sf, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_near(rows, 20)
    assert {tuple(r) for r in queries.op10_block_matrix(spark, sf).collect()} == want
    monkeypatch.setattr(neighbours, "GROUP", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "TILE", 3)
    assert {tuple(r) for r in queries.op10_block_matrix(spark, sf).collect()} == want


def test_neighbours_edges(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(100)] + [(100, [1.0, 2.0]), (101, None), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert {tuple(r) for r in neighbours.nearest(df).collect()} == brute_near(rows, 20)
    assert {tuple(r) for r in neighbours.nearest(df.where("vec_id < 5")).collect()} == brute_near(rows[:5], 20)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_of_extreme_numbers(spark):
    """Products that overflow, numbers under the smallest normal one, components of all sizes, in double precision."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-320, 200)).tolist()) for i in range(200)]
    rows += [(200, [1e200, 1e200, 0.0, 0.0]), (201, [1e200, -1e200, 0.0, 0.0]), (202, [5e-324, 0.0, 0.0, 0.0]), (220, [5e-324, 5e-324, 0.0, 0.0]), (240, [1e-310, 1e200, 1.0, -1.0])]
    want = set()
    with np.errstate(all="ignore"):
        for qi, q in rows:
            if qi % 20 == 0 and any(q):
                s = [(-float(neighbours.exact(np.array([q]), np.array([x]))[0]), i) for i, x in rows if i != qi and any(x)]
                want |= {(qi, r + 1, i, -d) for r, (d, i) in enumerate(sorted(x for x in s if x[0] == x[0])[:20])}
    got = {tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_neighbours_of_repeated_keys(spark):
    rows = [(0, [1.0, 1.0]), (0, [2.0, 0.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (9, [0.0, 5.0])]
    got = sorted((r.query_id, r.vec_id, r.score) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted((0, i, float(np.dot(q, v))) for k, q in rows[:2] for i, v in rows[2:])


def test_copies_behind_a_repeated_id():
    """Equal vectors whose smallest ids are the query's own, many times, still give other ids; against all rows."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        x = rng.integers(1, 3, (80, 2)).astype(float)
        ids = rng.choice([20, 20, 20, 20, 7, 40, 41, 60, 90], 80)
        for k in (1, 3, 20):
            got = {}
            for q, v, s in neighbours.block_top(np.array([20, 40]), x[:2], ids, x, k):
                got.setdefault(q, []).append((-s, v))
            for n, q in enumerate((20, 40)):
                want = sorted((-float(x[n] @ c), int(i)) for i, c in zip(ids, x) if i != q)[:k]
                assert sorted(got.get(q, [])) == want
    ids = np.array([20] * 25 + [40])
    assert neighbours.block_top(np.array([20]), np.ones((1, 4)), ids, np.ones((26, 4)), 20) == [(20, 40, 4.0)]
