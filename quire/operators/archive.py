"""The archive of books, chapters, chunks and knowledge: upserts, cascades, listings.

Stores are DataFrames; every operation returns new ones. ``stores`` is a dict
of them by name; books are keyed by ``id``, the others carry ``book_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a book's status may be.
STATUS = ("processing", "extracted", "complete", "rate-limited", "error")


def _key(name: str) -> str:
    return "id" if name == "books" else "book_id"


def upsert(store: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Inserts or overwrites by key; of several updates of one key that with the largest ``order`` holds. With no order given, or where it is equal, two different updates of a key are an error: rows have no order of their own."""
    row = F.struct(*store.columns)
    x = updates.select(F.col(key).alias("_key"), row.alias("_u"), (F.col(order) if order else F.lit(0)).alias("_o"), F.to_json(row).alias("_j"))
    best = x.groupBy("_key").agg(F.max("_o").alias("_o"))
    same = F.col("_key").eqNullSafe(F.col("_key0")) & F.col("_o").eqNullSafe(F.col("_o0"))
    last = x.join(best.select(F.col("_key").alias("_key0"), F.col("_o").alias("_o0")), same).groupBy("_key").agg(F.first("_u").alias("_u"), (F.min("_j") != F.max("_j")).alias("_two"))
    last = last.where(F.when(F.col("_two"), F.raise_error(F.lit("a key has several updates and no order tells the last")).cast("boolean")).otherwise(F.lit(True))).select("_u.*")
    return store.join(last.select(key), key, "left_anti").select(*store.columns).unionByName(last)


def get_by_book(store: DataFrame, ids: DataFrame, index: str = "index") -> DataFrame:
    """Records of the given books (book_id), by book and index."""
    return store.join(ids.select("book_id").distinct(), "book_id", "left_semi").orderBy("book_id", index)


def pending_chapters(chapters: DataFrame, ids: DataFrame) -> DataFrame:
    """book_id, id, index, error: chapters still to process; a book without any chapter is an error row."""
    todo = chapters.join(ids.select("book_id").distinct(), "book_id", "left_semi").where("not ai_processed").select("book_id", "id", "index", F.lit(None).cast("string").alias("error"))
    none = ids.select("book_id").distinct().join(chapters.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("index"), F.lit("the book has no chapters").alias("error"))
    return todo.unionByName(none)


def delete_books(stores: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All stores without the given books (book_id)."""
    gone = ids.select(F.col("book_id").alias("_g")).distinct()
    return {name: s.join(gone, s[_key(name)] == gone["_g"], "left_anti") for name, s in stores.items()}


def reset_for_reprocess(stores: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Chapters of the given books unprocessed and without results, their knowledge gone, the books ``extracted`` without summary."""
    hit = ids.select(F.col("book_id").alias("_g")).distinct().withColumn("_hit", F.lit(True))
    out = dict(stores)
    if "chapters" in stores:
        c = stores["chapters"]
        x = c.join(hit, c["book_id"] == hit["_g"], "left")
        out["chapters"] = x.select(*((F.when(F.col("_hit"), F.lit(False if n == "ai_processed" else None).cast(t)).otherwise(c[n]).alias(n) if n in ("ai_processed", "summary", "ai_knowledge") else c[n]) for n, t in c.dtypes))
    if "knowledge" in stores:
        out["knowledge"] = stores["knowledge"].join(hit, stores["knowledge"]["book_id"] == hit["_g"], "left_anti")
    if "books" in stores:
        b = stores["books"]
        x = b.join(hit, b["id"] == hit["_g"], "left")
        out["books"] = x.select(*((F.when(F.col("_hit"), F.lit("extracted" if n == "status" else None).cast(t)).otherwise(b[n]).alias(n) if n in ("status", "summary") else b[n]) for n, t in b.dtypes))
    return out


def clear_all_books(stores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """delete_books for every book there is; rows whose book is gone already stay."""
    return delete_books(stores, stores["books"].select(F.col("id").alias("book_id")))


def reset_queue(books: DataFrame) -> DataFrame:
    """Books that were being processed are ``extracted`` again."""
    return books.withColumn("status", F.when(F.col("status") == "processing", "extracted").otherwise(F.col("status")))


def mark_failures(books: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: book_id, kind (rate-limit, error or cancelled-fresh): a rate limit marks the book, an error too unless it is extracted or rate-limited, a cancelled fresh run goes."""
    f = failures.groupBy("book_id").agg(F.max(F.when(F.col("kind") == "cancelled-fresh", 3).when(F.col("kind") == "rate-limit", 2).otherwise(1)).alias("_f"))
    x = books.join(f, books["id"] == f["book_id"], "left").drop("book_id").where("_f is null or _f != 3")
    return x.withColumn("status", F.when(F.col("_f") == 2, "rate-limited").when((F.col("_f") == 1) & ~F.coalesce(F.col("status").isin("extracted", "rate-limited"), F.lit(False)), "error").otherwise(F.col("status"))).drop("_f")


def library_listing(books: DataFrame) -> DataFrame:
    """Newest first (no created_at counts as 0, ties by id), with the total."""
    total = books.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))  # one row
    return books.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one").orderBy(F.coalesce("created_at", F.lit(0)).desc(), "id")


def book_detail(books: DataFrame, chapters: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Books with their ordered chapters and their knowledge."""
    c = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("index", "id", "title", "summary", "ai_processed"))).alias("chapters"))
    k = knowledge.select("book_id", F.struct(*(x for x in knowledge.columns if x != "book_id")).alias("knowledge"))
    return books.join(c, books["id"] == c["book_id"], "left").drop("book_id").join(k, books["id"] == k["book_id"], "left").drop("book_id")


def orphan_records(stores: dict[str, DataFrame]) -> DataFrame:
    """store, book_id, n: records whose book is not there."""
    ids = stores["books"].select(F.col("id").alias("book_id"))
    out = None
    for name in sorted(set(stores) - {"books"}):
        one = stores[name].join(ids, "book_id", "left_anti").groupBy("book_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "book_id", "n")
        out = one if out is None else out.unionByName(one)
    return out
