"""Reading pages and glyph runs, writing and exchanging the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.operators import archive
from quire.sources.shared import children

LINE = "struct<text:string,y:double,x:double,line_width:double,font_size:double,bold:boolean,italic:boolean>"
PAGES = f"book_id string, page_num int, text string, width double, height double, lines array<{LINE}>"
ITEMS = "book_id string, page_num int, item_seq int, str string, x double, y double, scale_x double, scale_y double, width double, font_name string"
STORES = ("books", "chunks", "chapters", "knowledge")
#: Fewest buckets of a store, and records of a bucket, about: a store of any size has buckets of one size.
BUCKETS, BUCKET_ROWS = 64, 250_000


def _read(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    if fmt not in ("parquet", "json"):
        raise ValueError(f"format {fmt!r} is neither parquet nor json")
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages, text only (geometry null) or rich."""
    return _read(spark, path, fmt, PAGES)


def read_text_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, ITEMS)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(df: DataFrame, store: str, path: str, buckets: int | None = None) -> None:
    """Writes a store below path, in buckets by a hash of its book so that upserts of few books touch few folders; as many as its size asks for, if none are given."""
    if store not in STORES:
        raise ValueError(f"no store {store!r}")
    key = "id" if store == "books" else "book_id"
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    df.withColumn("bucket", bucket_of(key, buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{store}")


def read_store(spark: SparkSession, store: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{store}").drop("bucket")


def write_versions(df: DataFrame, key: str, path: str, buckets: int, version: int = 0) -> None:
    """Writes the buckets that df has rows in as a version; other buckets keep theirs. Writing a version again replaces it."""
    out = df.withColumn("bucket", bucket_of(key, buckets)).withColumn("v", F.lit(version)).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(path)


def latest(spark: SparkSession, path: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest version (no newer than ``upto``) of every bucket, or of those given. Only those folders are read."""
    names = [f"bucket={b}" for b in buckets] if buckets is not None else [n for n in children(spark, path) if n.startswith("bucket=")]
    found = {n: max((v for v in (int(c[2:]) for c in children(spark, f"{path}/{n}") if c.startswith("v=")) if upto is None or v <= upto), default=None) for n in names}
    paths = [f"{path}/{n}/v={v}" for n, v in found.items() if v is not None]
    whole = spark.read.option("basePath", path).parquet(*(paths or [path]))
    return (whole if paths else whole.limit(0)).drop("bucket", "v")


def export_archive(stores: dict[str, DataFrame], path: str, exported_at_ms: int) -> None:
    """One JSON data set for each store and a manifest of one row; settings never."""
    for name, df in stores.items():
        if name in STORES:
            df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(stores.values())).sparkSession
    spark.createDataFrame([(exported_at_ms, sorted(set(stores) & set(STORES)))], "exported_at long, stores array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _record_key(store: str) -> str:
    return "book_id" if store == "knowledge" else "id"


def _dumped(spark: SparkSession, path: str, store: str, schema: StructType) -> DataFrame:
    """line, record, fits: the lines of a dumped store that are not blank; one that is no JSON of this schema, or has no key, does not fit."""
    bad = "_corrupt_line"
    record = F.from_json("line", StructType([*schema.fields, StructField(bad, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    x = spark.read.text(f"{path}/{store}").select(F.col("value").alias("line")).where(F.trim("line") != "").select("line", record.alias("r"))
    fits = F.col(f"r.{bad}").isNull() & F.col(f"r.{_record_key(store)}").isNotNull()
    return x.select("line", F.struct(*(F.col(f"r.{c}").alias(c) for c in schema.names)).alias("record"), fits.alias("fits"))


def _dumped_stores(spark: SparkSession, path: str, stores: dict[str, DataFrame]) -> list[str]:
    """Those of the stores that the dump's manifest names and that have a folder in it."""
    named = spark.read.schema("exported_at long, stores array<string>").json(f"{path}/manifest").select(F.explode("stores")).collect()
    return [name for (name,) in named if name in stores and children(spark, f"{path}/{name}")]


def import_archive(spark: SparkSession, path: str, stores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stores with a dump's records over those of the same key; a store the dump does not have stays. A line that cannot be read as a record is left out, see rejected_lines(); all others go in."""
    out = dict(stores)
    for name in _dumped_stores(spark, path, stores):
        records = _dumped(spark, path, name, stores[name].schema).where("fits").select("record.*")
        out[name] = archive.upsert(stores[name], records, _record_key(name))
    return out


def rejected_lines(spark: SparkSession, path: str, stores: dict[str, DataFrame]) -> DataFrame:
    """store, line: what import_archive() leaves out of a dump."""
    out = spark.createDataFrame([], "store string, line string")
    for name in _dumped_stores(spark, path, stores):
        out = out.unionByName(_dumped(spark, path, name, stores[name].schema).where("not fits").select(F.lit(name).alias("store"), "line"))
    return out


#: What a report tells of a book, section by section; a record is one row.
REPORT = {
    "statistics": "book_id string, n_pages long, strategy string, chapters long, groups long, candidates long, accepted long, rejected long, with_keyword long, without_keyword long, near_misses long, suspect_pct double, pages_per_candidate double, pages_per_group double, cap_hit boolean",
    "decisions": "book_id string, stage int, strategy string, result string, n_chapters int, selected boolean",
    "candidates": "book_id string, page_num int, title string, score int, confidence string, outcome string, outcome_reason string",
    "near_misses": "book_id string, page_num int, line_index int, text string, score int",
    "groups": "book_id string, chapter_index int, title string, page_start int, page_end int, n_pages int",
}
NEAR_MISSES = 50


def audit_report(outcomes: DataFrame, near: DataFrame, decisions: DataFrame, groups: DataFrame, stats: DataFrame) -> DataFrame:
    """book_id, section, record: a JSON text for each decision, candidate, group and near miss (a book's first 50) and one of a book's statistics; no value grows with a book."""
    w = Window.partitionBy("book_id").orderBy("page_num", "line_index")
    first = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NEAR_MISSES)
    out = None
    for section, df in {"statistics": stats, "decisions": decisions, "candidates": outcomes, "near_misses": first, "groups": groups}.items():
        names = StructType.fromDDL(REPORT[section]).names
        one = df.select("book_id", F.lit(section).alias("section"), F.to_json(F.struct(*names)).alias("record"))
        out = one if out is None else out.unionByName(one)
    return out


def write_audit_report(report: DataFrame, path: str) -> None:
    """JSON lines below path, a folder a section, and a manifest: each book with the number of its records in every section."""
    report.select("section", "record").write.mode("overwrite").partitionBy("section").text(f"{path}/records")
    written = report.sparkSession.read.schema("record string, section string").text(f"{path}/records").select(F.get_json_object("record", "$.book_id").alias("book_id"), "section")
    written.groupBy("book_id").agg(*(F.count_if(F.col("section") == s).alias(s) for s in REPORT)).write.mode("overwrite").json(f"{path}/manifest")


def read_audit_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of a written report by name (one that nothing was written of is empty), and its ``manifest``."""
    whole = spark.read.schema("record string, section string").text(f"{path}/records")
    out = {s: whole.where(F.col("section") == s).select(F.from_json("record", ddl).alias("r")).select("r.*") for s, ddl in REPORT.items()}
    return out | {"manifest": spark.read.schema("book_id string, " + ", ".join(f"{s} long" for s in REPORT)).json(f"{path}/manifest")}
