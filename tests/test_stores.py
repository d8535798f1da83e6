"""Last writes and last attempts, stores of any size, and the audit report, on literal rows."""

import json

import pytest

from quire.operators import archive, audit, compact, knowledge, profile, scoring, segment
from quire.sources import stores
from tests.test_books import DENSE, SPARSE, book


def test_last_write_wins(spark):
    store = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], "id string, status string, n int")
    updates = spark.createDataFrame([("a", "first", 1), ("a", "second", 3), ("c", "x", 5), ("c", "y", 4), ("a", "third", 2), ("a", "second", 3)], store.schema)
    assert {tuple(r)[:2] for r in archive.upsert(store, updates, "id", "n").collect()} == {("a", "second"), ("b", "old"), ("c", "x")}
    assert archive.upsert(store, updates.limit(0), "id").count() == 2
    # rows have no order of their own: without one, different updates of a key are an error, equal ones are not
    with pytest.raises(Exception, match="no order tells the last"):
        archive.upsert(store, updates, "id").collect()
    assert archive.upsert(store, updates.where("n = 3"), "id").count() == 2


def test_finished_chapters_stay(spark):
    """A processed chapter is never done again; a failed call leaves empty knowledge and is a call done; an untouched chapter has none."""
    chapters = spark.createDataFrame([("b", i, i == 0, "kept" if i == 0 else None) for i in range(4)], "book_id string, index int, ai_processed boolean, summary string")
    first = knowledge.apply_responses(chapters, spark.createDataFrame([("b", 0, None), ("b", 1, '{"summary": "s", "concepts": ["c"]}'), ("b", 2, None)], "book_id string, chapter_index int, raw string"))
    again = knowledge.apply_responses(first, spark.createDataFrame([("b", 1, None), ("b", 2, "no json")], "book_id string, chapter_index int, raw string"))
    got = {r["index"]: (r.ai_processed, r.summary, r.ai_knowledge and r.ai_knowledge.concepts) for r in again.collect()}
    assert got == {0: (True, "kept", None), 1: (True, "s", ["c"]), 2: (True, "", []), 3: (False, None, None)}
    assert knowledge.call_metrics(again).first().ai_calls_done == 3 == knowledge.call_metrics(first).first().ai_calls_done
    with pytest.raises(Exception, match="no attempt to choose by"):
        knowledge.apply_responses(chapters, spark.createDataFrame([("b", 1, "x"), ("b", 1, "y")], "book_id string, chapter_index int, raw string")).collect()


def test_calls_of_a_finished_book(spark):
    """A summary that was there or failed is no call done; one made now, or taken from the only chapter summary, is."""
    books = spark.createDataFrame([(k, s, (4, 4, 5, 0)) for k, s in (("had", "old"), ("told", None), ("failed", None), ("one", None), ("none", ""))], "id string, summary string, pipeline_metrics struct<pages:int,chapters:int,ai_calls_total:int,ai_calls_done:int>")
    n = {"had": 2, "told": 2, "failed": 2, "one": 1, "none": 0}
    chapters = spark.createDataFrame([(b, i, i < n[b], f"s{i}" if i < n[b] else None) for b in n for i in range(3)], "book_id string, index int, ai_processed boolean, summary string")
    told = spark.createDataFrame([("told", "S"), ("failed", None)], "book_id string, raw string")
    got = {r.id: (r.summary, r.pipeline_metrics.ai_calls_done) for r in knowledge.finalize_books(books, chapters, told).collect()}
    assert got == {"had": ("old", 2), "told": ("S", 3), "failed": ("s0", 2), "one": ("s0", 2), "none": ("", 0)}


def test_last_attempt_wins(spark):
    chapters = spark.createDataFrame([("b", i, False, None) for i in range(4)], "book_id string, index int, ai_processed boolean, summary string")
    answers = [("b", 0, 2, '{"summary": "second"}'), ("b", 0, 1, '{"summary": "first"}'), ("b", 1, 1, '{"summary": "only"}'), ("b", 2, 1, '{"summary": "was"}'), ("b", 2, 3, None)]
    df = spark.createDataFrame(answers, "book_id string, chapter_index int, attempt int, raw string").coalesce(1)
    want = {0: (True, "second"), 1: (True, "only"), 2: (False, ""), 3: (False, None)}
    assert {r["index"]: (r.ai_processed, r.summary) for r in knowledge.apply_responses(chapters, df).collect()} == want
    # the order of rows tells nothing: without attempts two answers of a chapter are an error
    with pytest.raises(Exception, match="no attempt to choose by"):
        knowledge.apply_responses(chapters, df.drop("attempt")).collect()


def test_stores_have_as_many_buckets_as_their_size_asks_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BUCKETS", 2)
    monkeypatch.setattr(stores, "BUCKET_ROWS", 10)
    df = spark.range(200).selectExpr("concat('b', id) as id", "'t' as title")
    stores.write_store(df, "books", f"file://{tmp_path}/s")
    assert len(list((tmp_path / "s/books").glob("bucket=*"))) > 10
    assert stores.read_store(spark, "books", f"file://{tmp_path}/s").count() == 200


def test_decisions_and_report(spark, tmp_path):
    pages = ["Chapter 1: One\n" + SPARSE, DENSE, "A Lower Part\n" + SPARSE, "Chapter 2: Two\n" + SPARSE, DENSE, "Chapter 3: Three\n" + SPARSE]
    p = book(spark, pages).unionByName(book(spark, [DENSE.lower()] * 3).selectExpr("'c' as book_id", "page_num", "text"))
    log = audit.decision_log(p).collect()
    assert len(log) == 2 * len(segment.STAGES) and sum(r.selected for r in log) == 2
    of = lambda b: {r.stage: (r.result, r.n_chapters, r.selected) for r in log if r.book_id == b}
    assert of("b")[0] == ("none", 0, False) and of("b")[1] == ("ok", 3, True) and of("b")[8] == ("ok", 1, False)
    assert of("c")[8] == ("ok", 1, True) and of("c")[2] == ("none", 0, False)
    s = scoring.scored_lines(p)
    c = audit.candidates(s)
    chapters = segment.detect_chapters(p)
    groups = compact.group_chapters(chapters)
    outcomes, near = audit.candidate_outcomes(c, chapters, groups), audit.near_misses(s, c)
    stats = audit.audit_stats(outcomes, near, chapters, groups, profile.page_counts(p))
    path = f"file://{tmp_path}/report"
    stores.write_audit_report(stores.audit_report(outcomes, near, audit.decision_log(p), groups, stats), path)
    got = stores.read_audit_report(spark, path)
    report = {name: [r for r in df.collect() if r.book_id == "b"] for name, df in got.items()}
    assert sorted(d.stage for d in report["decisions"]) == list(range(9)) and {r.book_id for r in got["manifest"].collect()} == {"b", "c"}
    assert sorted((x.chapter_index, x.title) for x in report["groups"]) == [(0, "Chapter 1: One"), (1, "Chapter 2: Two"), (2, "Chapter 3: Three")]
    seen = sorted((r.page_num, r.title, r.score, r.confidence, r.outcome) for r in outcomes.collect() if r.book_id == "b")
    assert seen == sorted((x.page_num, x.title, x.score, x.confidence, x.outcome) for x in report["candidates"])
    assert {x[1] for x in seen if x[4] == "ACCEPTED"} == {"Chapter 1: One", "Chapter 2: Two", "Chapter 3: Three"}
    (numbers,) = report["statistics"]
    assert (numbers.n_pages, numbers.chapters, numbers.accepted, numbers.candidates) == (6, 3, 3, len(seen))
    assert [tuple(r) for r in report["manifest"]] == [("b", *(len(report[s]) for s in stores.REPORT))]
    lines = [json.loads(x) for f in (tmp_path / "report/records/section=candidates").glob("*.txt") for x in f.read_text().splitlines()]
    assert sorted((x["book_id"], x["page_num"]) for x in lines) == sorted((r.book_id, r.page_num) for r in outcomes.collect())


def test_report_keeps_a_books_first_near_misses(spark, tmp_path):
    """Fifty a book by page and line; sections without rows are empty, titles with quotes and line ends come back as they were."""
    odd = 'a "quoted"\nline \u2028 end'
    near = spark.createDataFrame([(b, p, line, odd, 20) for b in "bc" for p in range(40) for line in range(1 + (b == "b"))], "book_id string, page_num int, line_index int, text string, score int")
    none = {s: spark.createDataFrame([], ddl) for s, ddl in stores.REPORT.items()}
    path = f"file://{tmp_path}/near"
    stores.write_audit_report(stores.audit_report(none["candidates"], near, none["decisions"], none["groups"], none["statistics"]), path)
    got = stores.read_audit_report(spark, path)
    rows = sorted((r.book_id, r.page_num, r.line_index, r.text) for r in got["near_misses"].collect())
    assert rows == [("b", p, line, odd) for p in range(25) for line in (0, 1)] + [("c", p, 0, odd) for p in range(40)]
    assert got["groups"].count() == 0 and {r.book_id: r.near_misses for r in got["manifest"].collect()} == {"b": 50, "c": 40}


def test_dump_with_lines_that_cannot_be_read(spark, tmp_path):
    """Lines that are cut short, of other types, without a key or blank do not hinder the others; a store without a folder or outside the manifest stays."""
    path = f"file://{tmp_path}/dump"
    held = {
        "books": spark.createDataFrame([("a", "A\nline", (1, 2)), ("b", None, None)], "id string, title string, pipeline_metrics struct<pages:int,chapters:int>"),
        "knowledge": spark.createDataFrame([("a", ["x", "y"])], "book_id string, concepts array<string>"),
        "chunks": spark.createDataFrame([("c", "a")], "id string, book_id string"),
    }
    stores.export_archive({k: held[k] for k in ("books", "knowledge")}, path, 7)
    bad = ['{"id":"z","title":"cut', '{"title":"no key"}', '{"id":"n","pipeline_metrics":{"pages":"many"}}', "[]", "null"]
    (tmp_path / "dump/books/more.json").write_text("\n".join(["", *bad, "  ", '{"id":"late","title":"L","unknown":1}']) + "\n")
    old = {"books": spark.createDataFrame([("a", "old", None), ("kept", "K", None)], held["books"].schema), "knowledge": held["knowledge"].limit(0), "chunks": held["chunks"]}
    got = stores.import_archive(spark, path, old)
    assert {(r.id, r.title, r.pipeline_metrics and tuple(r.pipeline_metrics)) for r in got["books"].collect()} == {("a", "A\nline", (1, 2)), ("b", None, None), ("kept", "K", None), ("late", "L", None)}
    assert [tuple(r) for r in got["knowledge"].collect()] == [("a", ["x", "y"])] and got["chunks"] is old["chunks"]
    assert sorted(tuple(r) for r in stores.rejected_lines(spark, path, old).collect()) == sorted(("books", b) for b in bad)
