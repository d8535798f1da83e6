"""Token counts as rollups kept by deltas: signed rows, additive totals, idempotent commits.

A batch holds inserts, revised counts and deletes of (row, tokenizer
version). Its commit turns them into signed ledger rows (what was known is taken
back, what is new is added) and their sums by source, language and tokenizer
version. Totals are the sums of all batches' sums: no commit reads a text or
recounts a row it does not touch. The ledger lies in buckets by a hash of the
row's key, and a commit reads the buckets that its own rows lie in and no
other; ``compact`` folds all batches into one, so that a bucket's history stays short. A batch counts from the moment its sums are
whole; committing it again changes nothing, and one that was cut short is made anew.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import LONG, transducer
from quire.llm.common import by_slices, hadoop, scratch, stored

LEDGER = "key long, tokenizer string, source string, lang string, sign int, n_tokens long, bucket int"
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Rows of a bucket, about, where the number of buckets is made to measure.
BUCKET_ROWS = 1_000_000


class Rollup:
    """The ledger and the sums below one shared folder. The number of buckets is that of the folder's first use."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder
        if self._whole("buckets"):
            buckets = spark.read.parquet(f"{folder}/buckets").first().n
        else:
            spark.createDataFrame([(buckets,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")
        self.buckets = buckets

    def _whole(self, what: str) -> bool:
        fs, p = hadoop(self.spark, f"{self.folder}/{what}/_SUCCESS")
        return fs.exists(p)

    def _names(self, what: str) -> list[str]:
        fs, p = hadoop(self.spark, f"{self.folder}/{what}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _base(self) -> tuple[list[str], list[str]]:
        """The last whole compaction (none or one), and the batches in it."""
        whole = [n for n in self._names("base") if self._whole(f"base/{n}/batches")]
        return (whole[-1:], [r.batch for r in self.spark.read.parquet(f"{self.folder}/base/{whole[-1]}/batches").collect()]) if whole else ([], [])

    def _open(self) -> list[str]:
        """Committed batches that no compaction holds."""
        inside = set(self._base()[1])
        return [n for n in self._names("sums") if n not in inside and self._whole(f"sums/{n}")]

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted({*self._base()[1], *self._open()})

    def _read(self, what: str, schema: str) -> DataFrame:
        parts = [f"{self.folder}/base/{b}/{what}" for b in self._base()[0]] + [f"{self.folder}/{what}/{b}" for b in self._open()]
        out = self.spark.createDataFrame([], schema)
        for path in parts:  # each with its own bucket folders
            out = out.unionByName(self.spark.read.schema(schema).parquet(path))
        return out

    def present(self, buckets: list[int] | None = None) -> DataFrame:
        """key, tokenizer, source, lang, n_tokens of everything that counts now, in all buckets or those given."""
        rows = self._read("ledger", LEDGER)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        rows = rows.groupBy("key", "tokenizer", "source", "lang").agg(F.sum("sign").alias("s"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        return rows.where("s > 0").drop("s")

    def _write(self, rows: DataFrame, ledger: str, sums: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(ledger)
        # sums last: they are what makes the batch count
        rows = self.spark.read.schema(LEDGER).parquet(ledger)
        rows.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.mode("overwrite").parquet(sums)

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch: key, tokenizer, source, lang, n_tokens (null: delete). False if it was committed before.

        Of several changes of one row and version in a batch the largest count holds, a delete only if it is alone. Changes
        without key or tokenizer take no part; deleting what is not there changes nothing; null source and lang are groups of their own.
        """
        if batch in self.batches():
            return False
        c = changes.select(F.col("key").cast("long").alias("key"), F.col("tokenizer").cast("string").alias("tokenizer"), F.struct(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).alias("to")).where("key is not null and tokenizer is not null")
        c = stored(c.groupBy("key", "tokenizer").agg(F.max("to").alias("to")), "changes")
        touched = [r.b for r in c.select(self._bucket().alias("b")).distinct().collect()]
        before = self.present(touched).join(c.select("key", "tokenizer"), ["key", "tokenizer"]).select("key", "tokenizer", "source", "lang", F.lit(-1).alias("sign"), "n_tokens")
        after = c.where("to.n_tokens is not null").select("key", "tokenizer", "to.source", "to.lang", F.lit(1).alias("sign"), "to.n_tokens")
        self._write(before.unionByName(after), f"{self.folder}/ledger/{batch}", f"{self.folder}/sums/{batch}")
        return True

    def compact(self) -> None:
        """Folds all committed batches into one; totals and what is present stay. Cut short, it leaves everything as it was."""
        done = self.batches()
        name = f"{len(self._names('base')):06d}"
        top = f"{self.folder}/base/{name}"
        self._write(self.present().select("key", "tokenizer", "source", "lang", F.lit(1).alias("sign"), "n_tokens"), f"{top}/ledger", f"{top}/sums")
        self.spark.createDataFrame([(b,) for b in done], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{top}/batches")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without a row are left out."""
        return self._read("sums", SUMS).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")


#: Tokenizer versions that built-in functions count: name, pattern of a token.
PATTERNS = (("space-1", r"[^\x20\x09-\x0D]+"), ("alnum-1", r"[0-9A-Za-z]+"))
MODEL = "byte-bpe-1"


def counts(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """key (a number of the row), source, lang, h (digest of the text), estimate (a fifth of the bytes), tokens (tokenizer version to count) of every row; texts are read here only.

    The versions are two patterns and the byte-level BPE of the rank file, counted by its transducer. Null text: no tokens.
    """
    with open(rank_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"\xff")), 256)
    kept = docs.select("source", "lang", h.alias("h"), F.ceil(F.octet_length(text) / 5).alias("estimate"), *(F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in PATTERNS), text.alias("text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(MODEL, T.LongType())])

    def make():
        machine, split = transducer(sent.value), regex.compile(pattern)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(machine.encode(split.findall(x) if len(x) < LONG else (m[0] for m in split.finditer(x)))) for x in part.columns[-1].to_pylist()]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

        return run

    versions = F.create_map(*(x for name in (*(n for n, _ in PATTERNS), MODEL) for x in (F.lit(name), F.col(f"`{name}`"))))
    made = kept.mapInArrow(by_slices(make, keeps=True), schema).select(F.monotonically_increasing_id().alias("key"), "source", "lang", "h", "estimate", versions.alias("tokens"))
    return stored(made, "token-counts")  # keys are settled once written


def maintained(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """A corpus' life in commits: all rows with estimated counts, all revised to true ones, later exact copies deleted, the revision sent twice, the copies back again.

    Returns source, lang, tokenizer, n_docs and n_tokens of all rows, and n_texts and n_text_tokens as they were without the copies (a
    text's first row counts). Null text: no tokens; its copies are the null texts. Rows are told apart by their place, so missing and
    repeated doc_ids count like any other; very long texts stream; an empty table gives no totals; other columns are left out.
    """
    spark = docs.sparkSession
    rows = counts(docs, rank_file, pattern)
    book = Rollup(spark, scratch(spark, "rollup"), max(16, rows.count() // BUCKET_ROWS))
    true = rows.select("key", "source", "lang", "h", F.explode("tokens").alias("tokenizer", "n_tokens"))
    book.commit("1-estimates", rows.select("key", "source", "lang", F.explode(F.map_keys("tokens")).alias("tokenizer"), F.col("estimate").alias("n_tokens")))
    book.commit("2-revised", true)
    first = rows.groupBy("h").agg(F.min("key").alias("key"))
    copies = true.join(first, ["h", "key"], "left_anti")  # by text and row: the copies of one text never meet in one task
    book.commit("3-copies", copies.withColumn("n_tokens", F.lit(None)))
    book.commit("2-revised", true)
    book.compact()
    alone = stored(book.totals(), "totals")
    book.commit("4-copies-back", copies)
    zero = F.lit(0).cast("long")
    both = book.totals().withColumn("n_texts", zero).withColumn("n_text_tokens", zero).unionByName(alone.select("source", "lang", "tokenizer", zero.alias("n_docs"), zero.alias("n_tokens"), F.col("n_docs").alias("n_texts"), F.col("n_tokens").alias("n_text_tokens")))
    return both.groupBy("source", "lang", "tokenizer").agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_texts", "n_text_tokens")))
