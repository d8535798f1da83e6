"""Ordered rows of keys of any size.

A window over a whole key is one task, however large the key. Here rows are dealt to (key, block), a block being a range of what orders
them; a block is a window of its own, and what its rows need of the blocks before or after (counts, a neighbour, a value that still holds) comes
from a table of one row a block. So a key spreads over as many tasks as it has blocks, and only that table meets by key.

``block`` must not fall as the rows go on in ``order``; rows whose block is null come first. Null keys are keys like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Numbers of one block, where the order is by numbers that are mostly consecutive (pages, chapters).
BLOCK = 4096
FIRST = -(1 << 63)


def block_of(number: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(number) / size)


def _dealt(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    # a struct of nulls is no null and equals its like, so that joins keep null keys
    return df.withColumn("_k", F.struct(*keys)).withColumn("_b", F.coalesce(block.cast("long"), F.lit(FIRST)))


def _windows() -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    """Of the rows of a block, of the blocks of a key in order, of all blocks of a key."""
    return Window.partitionBy("_k", "_b"), Window.partitionBy("_k").orderBy("_b"), Window.partitionBy("_k")


def _joined(df: DataFrame, by_block: DataFrame) -> DataFrame:
    return df.join(by_block, ["_k", "_b"])


def numbered(df: DataFrame, keys: list[str], block: Column, order: list[str], lags: dict[str, str] | None = None, leads: dict[str, str] | None = None, whole: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """df with ``pos`` (from 1) and ``of`` (rows of the key), columns of the row before (lags: new name to column) and after (leads), and
    an aggregate over the key (whole: new name to the name of ``min`` or ``max`` and a column). ``order`` must be total in a key."""
    lags, leads, whole = lags or {}, leads or {}, whole or {}
    rows, blocks, key = _windows()
    x = _dealt(df, keys, block)
    some = lambda names: F.struct(*(F.col(c).alias(n) for n, c in names.items())) if names else F.lit(None).cast("struct<x:int>")
    s = x.groupBy("_k", "_b").agg(F.count("*").alias("_n"), F.max_by(some(lags), F.struct(*order)).alias("_last"), F.min_by(some(leads), F.struct(*order)).alias("_first"), *(getattr(F, f)(c).alias(n) for n, (f, c) in whole.items()))
    s = s.select("_k", "_b", (F.sum("_n").over(blocks) - F.col("_n")).alias("_before"), F.sum("_n").over(key).alias("of"), F.lag("_last").over(blocks).alias("_prev"), F.lead("_first").over(blocks).alias("_next"), *(getattr(F, f)(n).over(key).alias(n) for n, (f, _) in whole.items()))
    x = _joined(x, s)
    w = rows.orderBy(*order)
    x = x.withColumn("pos", (F.row_number().over(w) + F.col("_before")).cast("long"))
    if lags:
        x = x.withColumn("_prev", F.coalesce(F.lag(some(lags)).over(w), "_prev"))
    if leads:
        x = x.withColumn("_next", F.coalesce(F.lead(some(leads)).over(w), "_next"))
    mine = [c for c in df.columns if c not in {*lags, *leads, *whole, "pos", "of"}]
    return x.select(*mine, "pos", "of", *(F.col(f"_prev.{n}").alias(n) for n in lags), *(F.col(f"_next.{n}").alias(n) for n in leads), *whole)


def summed(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, before: str, total: str) -> DataFrame:
    """df with the sum of ``value`` (never null) over the rows of the key that stand before a row, and over all of them. ``order`` must be total in a key."""
    x = _dealt(df, keys, block)
    rows, blocks, key = _windows()
    s = x.groupBy("_k", "_b").agg(F.sum(value).alias("_s")).select("_k", "_b", (F.sum("_s").over(blocks) - F.col("_s")).alias("_before"), F.sum("_s").over(key).alias(total))
    return _joined(x, s).withColumn(before, F.col("_before") + F.sum(value).over(rows.orderBy(*order)) - F.col(value)).drop("_k", "_b", "_before")


def carried(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str) -> DataFrame:
    """df with null in ``value`` filled by the last value that stands before it in the key."""
    x = _dealt(df, keys, block)
    rows, blocks, _ = _windows()
    known = F.col(value).isNotNull()
    s = x.groupBy("_k", "_b").agg(F.max_by(value, F.when(known, F.struct(*order))).alias("_last"))
    s = s.select("_k", "_b", F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_held"))
    here = F.last(value, ignorenulls=True).over(rows.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(x, s).withColumn(value, F.coalesce(here, "_held")).drop("_k", "_b", "_held")


def runs(df: DataFrame, keys: list[str], block: Column, order: list[str], begins: Column) -> DataFrame:
    """df with ``run`` (from 1; rows before the first beginning: 0) and ``place`` in it (from 1): a row that ``begins`` starts a run."""
    rows, blocks, _ = _windows()
    w = rows.orderBy(*order)
    x = _dealt(df, keys, block).withColumn("_begins", F.coalesce(begins, F.lit(False))).withColumn("_i", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_at", F.max(F.when(F.col("_begins"), F.col("_i"))).over(upto)).withColumn("_c", F.count_if("_begins").over(upto))
    s = x.groupBy("_k", "_b").agg(F.count("*").alias("_n"), F.max("_at").alias("_top"), F.max("_c").alias("_count"))
    # rows from a block's last beginning to its end; of blocks without one that share a beginning before them the sum
    s = s.withColumn("_tail", F.col("_n") - F.coalesce("_top", F.lit(1)) + 1).withColumn("_since", F.count("_top").over(blocks))
    s = s.withColumn("_open", F.sum("_tail").over(Window.partitionBy("_k", "_since").orderBy("_b")))
    s = s.select("_k", "_b", F.coalesce(F.lag("_open").over(blocks), F.lit(0)).alias("_carry"), (F.sum("_count").over(blocks) - F.col("_count")).alias("_runs"))
    place = F.when(F.col("_at").isNull(), F.col("_i") + F.col("_carry")).otherwise(F.col("_i") - F.col("_at") + 1)
    return _joined(x, s).withColumn("run", F.col("_c") + F.col("_runs")).withColumn("place", place.cast("long")).drop("_k", "_b", "_begins", "_i", "_at", "_c", "_carry", "_runs")
