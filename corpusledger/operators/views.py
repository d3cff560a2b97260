"""Catalogue views: current documents, health, growth, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_documents(documents: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents with their current version and its content."""
    current = documents.withColumnRenamed("current_version", "version_no")
    return current.join(versions, ["document_id", "version_no"]).join(contents, "content_hash")


def current_version(documents: DataFrame, versions: DataFrame, document_id) -> DataFrame:
    one = documents.filter(F.col("document_id") == document_id).select("document_id", F.col("current_version").alias("version_no"))
    return versions.filter(F.col("document_id") == document_id).join(one, ["document_id", "version_no"])


def source_health(sources: DataFrame, documents: DataFrame, runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Documents, failed documents, last success and recent failed runs of every source.

    Both sides are aggregated by source before they are joined, so no document meets a run and a count needs no distinct:
    ``documents`` has a row per document.
    """
    held = documents.groupBy("source_id").agg(
        F.count("document_id").alias("documents"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed_documents")
    )
    recent = (F.col("status") == "failed") & (F.col("started_at") > as_of - F.expr(f"interval {days} days"))
    ran = runs.groupBy("source_id").agg(
        F.max(F.when(F.col("status") == "completed", F.col("started_at"))).alias("last_success_at"), F.sum(F.when(recent, 1).otherwise(0)).alias("failed_runs_7d")
    )
    zero = {"documents": 0, "failed_documents": 0, "failed_runs_7d": 0}
    return sources.join(held, "source_id", "left").join(ran, "source_id", "left").fillna(zero)


def daily_growth(versions: DataFrame, contents: DataFrame, at: str = "fetched_at") -> DataFrame:
    """Versions and their bytes by day; a shared content counts once for each version."""
    met = versions.join(contents.select("content_hash", "byte_size"), "content_hash")
    return met.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def recent_runs(runs: DataFrame, limit: int = 25, source: str | None = None, source_col: str = "source_id", at: str = "started_at", key: str = "run_id") -> DataFrame:
    """The latest runs, of one source or of all; ties by the larger run id."""
    some = runs if source is None else runs.filter(F.col(source_col) == source)
    return some.orderBy(F.desc(at), F.desc(key)).limit(limit)


def totals(contents: DataFrame) -> DataFrame:
    return contents.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def source_counts(documents: DataFrame, source: str = "source_id") -> DataFrame:
    return documents.groupBy(source).agg(F.count(F.lit(1)).alias("documents"))


def shared_contents(refs: DataFrame, hash_col: str = "content_hash", source: str = "source_id") -> DataFrame:
    """Contents that more than one source published."""
    return refs.groupBy(hash_col).agg(F.countDistinct(source).alias("sources"), F.count(F.lit(1)).alias("refs")).filter("sources > 1")


def dashboard_totals(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("documents").alias("documents"),
        F.sum("failed_documents").alias("failed_documents"),
        F.sum("failed_runs_7d").alias("failed_runs_7d"),
    )
