"""Pieces that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusledger.runtime import in_small_batches, materialise  # noqa: F401  (operators take the first from here)

_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, for one operator at a time: asking for another's drops it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are written and no longer referred to; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def plain_names(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns numbered, so that no name of ours meets one of the caller's, and the new names of ``columns``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = 1000, most_hot: int = 10_000, hashed: bool = False) -> DataFrame:
    """Left join of ``rows`` to ``groups``, unique by ``key``, that no large group can make uneven.

    The ``most_hot`` largest groups of at least ``hot_rows`` rows are broadcast, a table of at most
    that many rows; all other rows are shuffled by key, where no group holds more than a
    ``most_hot``-th part of them. Rows found in the broadcast are dealt evenly meanwhile.
    ``hashed``: groups are looked up in a hash table of each partition, where there are far fewer groups than rows, and neither is sorted.
    """
    columns = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) >= hot_rows).orderBy(F.desc(size), key).limit(most_hot)
    hot = hot.select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in columns])
    cold = groups.select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in columns])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    apart = F.col("_hot").isNotNull()
    met = met.withColumn("_at", F.when(~apart, F.col(key)))
    met = met.withColumn("_deal", F.when(apart, F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    cold = cold.withColumn("_zero", F.lit(0).cast("long"))
    met = met.join(cold.hint("shuffle_hash") if hashed else cold, (F.col("_at") == F.col("_cold")) & (F.col("_deal") == F.col("_zero")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns])


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """A row by its id and a hash of its text: ids may be null or repeat with different texts."""
    return F.struct(doc_id.cast("long").alias("doc_id"), text_hash.alias("key"))


def join_by_id(docs: DataFrame, decisions: DataFrame, id_col: str, most: int = 500_000, weight: str | None = None) -> DataFrame:
    """Left join of whole documents to decisions, unique by ``_cl_id``; a null id meets a null id.

    ``decisions`` is broadcast while it has at most ``most`` rows, or ``weight`` summed over them, and shuffled beyond.
    """
    decisions = materialise(decisions, "decisions")
    size = decisions.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0
    decisions = decisions.drop(weight) if weight else decisions
    met = docs.join(F.broadcast(decisions) if size <= most else decisions, F.col(id_col).eqNullSafe(F.col("_cl_id")), "left")
    return met.drop("_cl_id")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of (u, v): one row ``node, component`` per node that any edge touches.

    Alternating large-star and small-star passes, each a shuffle of the edges; the component is its
    smallest node. Every pass is written to the shared folder, and only a count and a checksum come
    back to the driver.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(minima(both), f"{tag}-low")
        return join_groups(both.filter("v > u"), low, "u", "degree").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = materialise(minima(down), f"{tag}-low")
        moved = join_groups(down, low, "u", "degree").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-edges")
    before = state(edges)
    while before[0]:
        edges = materialise(small_star(materialise(large_star(edges), f"{tag}-large")), f"{tag}-edges")
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
