"""The pipeline's stages, each on its own input, and its run."""

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from quire.llm import bpe, secrets, toxicity
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_simhash import brute_groups


def test_run_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf)
    rows = out.collect()
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 0 < len(rows) < docs.count() and all(r.utf8_ok for r in rows)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        text = texts[r.doc_id]
        base, more, *_ = secrets.scan_text(text)
        assert list(r.token_ids) == enc.encode_ordinary(secrets.redacted(text, base + more, cp.MASK) if base or more else text)


def test_stages_on_edges(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "", None, None, 0), (None, "token=abcdefghijkl", "en", "s", 18), (5, "one two three " * 9000, "en", "s", 1), (6, "one two three " * 9000, "en", "s", 1), (6, "one two three " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            got = stage(spark, given, sf)
            assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
            n = got.count()
            assert n <= given.count()
            if name == "simhash_near_dedup" and given is docs:
                assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 5]
            if name == "secrets" and given is docs:
                assert "token=" not in "".join(r.text or "" for r in got.collect()) and n == len(rows)
        assert cp.STAGES[-1][1](spark, given, sf).count() == given.count()


def test_first_stages_against_brute_force(spark, sf):
    """Toxicity, near duplicates and contamination, each on the given documents with null and repeated doc_ids among them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    at = docs.columns.index("doc_id"), docs.columns.index("text")
    other = lambda row, i, text: tuple(i if k == at[0] else text if k == at[1] else v for k, v in enumerate(row))
    long = max(rows, key=lambda r: min(len(r[at[1]] or ""), 5000))
    rows += [other(long, None, long[at[1]] + " more"), other(long, long[at[0]], long[at[1]]), other(rows[0], None, "see " + items[0][1]), other(rows[0], None, "a text of its own without a key")]
    given = spark.createDataFrame(rows, docs.schema)
    key = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    said = lambda kept: sorted(str((r[at[0]], r[at[1]])) for r in kept)
    weights = toxicity.fitted(given, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(weights)
    assert key(cp.toxic(spark, given, sf)) == said([r for r in rows if scorer.score(r[at[1]]) < cp.REJECT])
    found = {t for t in {r[at[1]] for r in rows} if leaked([(0, t)], items)}
    assert key(cp.decontaminated(spark, given, sf)) == said([r for r in rows if r[at[1]] not in found]) and "see " + items[0][1] in found
    comp = brute_groups([(r[at[0]], r[at[1]]) for r in rows])
    want = {c: min(((rows[i][at[0]] is None, rows[i][at[0]] or 0, i) for i in range(len(rows)) if comp[i] == c)) for c in set(comp)}
    got = cp.near_duplicates(spark, given, sf).collect()
    least = [rows[i] for *_, i in want.values()]
    extra = sorted(set(str((r.doc_id, r.text)) for r in got) - set(said(least)))
    assert len(got) - len(least) <= 0.1 * (len(rows) - len(least)) and len(extra) <= len(got) - len(least)
