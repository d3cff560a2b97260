"""Monotone ULIDs: within one millisecond each next id is the one before plus one, in 80 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.functions.identity import CROCKFORD, ulid_time
from corpusledger.runtime import materialise

#: The 80 bits are held in two numbers of 40, eight digits of five bits each.
HALF = 40


def _digits(half: Column) -> Column:
    digits = [F.substring(F.lit(CROCKFORD), (F.shiftright(half, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(7, -1, -1)]
    return F.concat(*digits)


def first_halves(millis: Column, seed: str) -> tuple[Column, Column]:
    """Where a millisecond begins: bits of a hash, equal on every rerun. The highest bit is left free, so that counting up never overflows."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), millis.cast("string")).cast("binary"), 256)
    high, low = (F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(2))
    return high.bitwiseAND(F.lit((1 << (HALF - 1)) - 1)), low


def plus(high: Column, low: Column, n: Column) -> tuple[Column, Column]:
    """(high, low) + n with the carry."""
    both = low + n
    return high + F.shiftright(both, HALF), both.bitwiseAND(F.lit((1 << HALF) - 1))


def ranked(rows: DataFrame, millis: str, key: str, parts: int | None = None) -> DataFrame:
    """The rows with ``_rank``, their place (from 0) within their millisecond by ``key``, which is unique.

    Rows are dealt by ranges of (millisecond, key), so a millisecond of very many rows is shared out. Only the first millisecond of a range can
    have begun in an earlier one: what precedes it is a table of one row a range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(parts, millis, key).withColumn("_part", F.spark_partition_id()), "ulid-ranges")
    held = dealt.groupBy("_part", millis).agg(F.count(F.lit(1)).alias("n"))
    edges = [F.struct(f(millis).alias(millis), by("n", millis).alias("n")) for f, by in ((F.min, F.min_by), (F.max, F.max_by))]
    ends = held.groupBy("_part").agg(F.array_distinct(F.array(*edges)).alias("ends")).select("_part", F.explode("ends").alias("end")).select("_part", "end.*")
    # Two rows a range at most: its first and its last millisecond.
    before = Window.partitionBy(millis).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(F.broadcast(ends.select("_part", millis, F.sum("n").over(before).alias("_ahead"))), ["_part", millis], "left")
    place = F.row_number().over(Window.partitionBy("_part", millis).orderBy(key)) - 1
    return met.withColumn("_rank", place + F.coalesce("_ahead", F.lit(0))).drop("_part", "_ahead")


def monotone_ulids(rows: DataFrame, millis: str, key: str, seed: str = "0", parts: int | None = None) -> DataFrame:
    """The rows with ``ulid``: unique, rising with (millis, key), and the same on every rerun. A row without a time gets a null."""
    high, low = plus(*first_halves(F.col(millis), seed), F.col("_rank"))
    return ranked(rows, millis, key, parts).withColumn("ulid", F.concat(ulid_time(F.col(millis)), _digits(high), _digits(low))).drop("_rank")
