"""What several training-data operators share: table reading, shared folders."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process a temporary folder is used.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its folder: lineage ends there, so a lost executor costs a re-read only."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, what: str) -> DataFrame:
    return written(df, what)[0]


def hadoop(spark: SparkSession, path: str):
    """The store and the path, as Spark's own readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


#: Rows of one key that stay together in a join at least, and the most keys that are ever split.
TOGETHER, HOT_KEYS = 4096, 50_000


def split_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, total: int) -> DataFrame:
    """many joined with one (a row for each key, ``n`` of them in many; n is dropped), without a task for a hot key.

    Keys with over total / HOT_KEYS rows (and over TOGETHER) are dealt by ``by`` to parts of about that many, and their row of ``one``
    goes to each part. total is the sum of n, so there are fewer than HOT_KEYS such keys: that bounds what is broadcast.
    """
    most = max(TOGETHER, total // HOT_KEYS)
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    hot = one.where(F.col("n") > most).select(*keys, parts.alias("_parts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    each = one.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(each, [*keys, "_part"]).drop("_part")


def crc_mod(key: str, m: int) -> Column:
    """crc32 of a column's text, modulo m."""
    return F.crc32(F.col(key).cast("string")) % F.lit(m)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small, so that Python never holds many long texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: The one large object that a Python worker keeps from task to task: what it is, and itself.
_HELD: dict[str, object] = {}


def held(what: str, make: Callable[[], object]):
    """A large object that later tasks of this Python worker use again. A worker keeps one: that of another operator goes."""
    if _HELD.get("what") != what:
        released()
        _HELD.update(what=what, value=make())
    return _HELD["value"]


def released() -> None:
    """Drops what the worker holds and gives freed memory back to the system, where its C library can."""
    if _HELD:
        _HELD.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def by_slices(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = 512, keeps: bool = False):
    """A function for mapInArrow: make() runs once a task, its result on every slice. Unless it keeps a held object, the worker's goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            released()
        f = make()
        for part in slices(batches, rows):
            out = f(part)
            if out.num_rows:
                yield out

    return run
