"""Rollups against a plain recount, idempotent commits, buckets, compaction, edges."""

import re
from collections import Counter

import public_tokenizers as P
import tiktoken

from quire.llm import bpe, queries, rollup
from quire.llm.common import scratch

FILE = P.path("byte_bpe_multi_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(FILE, "rb").read()), special_tokens={})


def recount(rows):
    """rows: source, lang, text in their order."""
    out, seen = {}, set()
    for source, lang, text in rows:
        t, first = text or "", text not in seen
        seen.add(text)
        for name, n in (("space-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("alnum-1", len(re.findall(r"[0-9A-Za-z]+", t))), (rollup.MODEL, len(ENC.encode_ordinary(t)))):
            got = out.setdefault((source, lang, name), [0, 0, 0, 0])
            for i, v in enumerate((1, n, first, n * first)):
                got[i] += v
    return Counter((*k, *v) for k, v in out.items())


def totals(df):
    return Counter(tuple(r) for r in df.select("source", "lang", "tokenizer", "n_docs", "n_tokens", "n_texts", "n_text_tokens").collect())


def test_query_matches_a_recount(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got, want = totals(queries.op9_delta_rollup(spark, sf)), recount([(r.source, r.lang, r.text) for r in docs])
    sums = lambda c: Counter({(k[2], i): 0 for k in c for i in (3, 4, 5, 6)} | Counter({(k[2], i): sum(x[i] for x in c if x[2] == k[2]) for k in c for i in (3, 4, 5, 6)}))
    assert Counter(k[:5] for k in got) == Counter(k[:5] for k in want)
    texts = {r.text for r in docs}
    assert {sums(got)[v, 5] for v in ("space-1", "alnum-1", rollup.MODEL)} == {len(texts)} and sums(got)[rollup.MODEL, 6] == sum(len(ENC.encode_ordinary(t or "")) for t in texts)


def test_edges(spark):
    rows = [("s", "en", "a b"), ("s", "en", "a b"), ("s", None, None), (None, None, None), ("t", "en", ""), ("t", "de", "word " * 60000)]
    df = spark.createDataFrame([(None if k % 2 else 7, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, source string, lang string, text string, key int, h string").coalesce(1)
    assert totals(rollup.maintained(df, FILE, P.PATTERN)) == recount(rows)
    assert rollup.maintained(df.limit(0), FILE, P.PATTERN).count() == 0


def test_commits(spark):
    folder = scratch(spark, "rollup")
    book = rollup.Rollup(spark, folder, 8)
    rows = lambda *r: spark.createDataFrame(r, "key long, tokenizer string, source string, lang string, n_tokens long")
    assert book.totals().count() == 0 and book.batches() == []
    assert book.commit("a", rows((1, "t", "s", "en", 5), (1, "t", "s", "en", 7), (2, "t", "s", "en", 3), (3, "t", None, None, 0), (None, "t", "s", "en", 9)))
    assert not book.commit("a", rows((9, "t", "s", "en", 100)))
    assert book.commit("b", rows((1, "t", "s2", "en", 4), (2, "t", "s", "en", None), (8, "t", "s", "en", None), (1, "u", "s", "en", 1)))
    want = {("s2", "en", "t", 1, 4), (None, None, "t", 1, 0), ("s", "en", "u", 1, 1)}
    assert {tuple(r) for r in book.totals().collect()} == want
    assert book.commit("c", rows()) and {tuple(r) for r in book.totals().collect()} == want
    assert {tuple(r)[:2] for r in book.present().collect()} == {(1, "t"), (3, "t"), (1, "u")}
    # a commit reads the buckets of its own rows
    bucket = spark.range(1, 2).selectExpr("pmod(xxhash64(id), 8) as b").first().b
    read = book.present([bucket]).inputFiles()
    assert read and all("bucket=" in f for f in read)
    plan = book.present([bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    # compaction keeps everything, a cut one counts for nothing, and later commits go on from it
    book.compact()
    again = rollup.Rollup(spark, folder, 99)
    assert again.buckets == 8 and again.batches() == ["a", "b", "c"] and again._open() == []
    assert {tuple(r) for r in again.totals().collect()} == want and not again.commit("b", rows((9, "t", "s", "en", 100)))
    assert again.commit("d", rows((1, "t", "s", "en", 6)))
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{folder}/base/000001/ledger")
    assert {tuple(r) for r in again.totals().collect()} == (want - {("s2", "en", "t", 1, 4)}) | {("s", "en", "t", 1, 6)}
    assert {tuple(r)[:2] for r in again.present().collect()} == {(1, "t"), (3, "t"), (1, "u")}
