"""Sweeps, withdrawal, quarantine and the promotion of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_full_sweep(mode: str = "mode", status: str = "status", error: str = "error_summary") -> Column:
    """Completed is not complete: a run that was cut short has an error summary."""
    return (F.col(mode) == "full") & (F.col(status) == "completed") & F.col(error).isNull()


def last_per_source(runs: DataFrame, condition: Column, value: str, order: Sequence[str], source: str = "source_id") -> DataFrame:
    """``value`` of each source's last run that meets the condition."""
    return runs.filter(condition).groupBy(source).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_full_sweep(runs: DataFrame, order: Sequence[str] = ("started_at", "run_id"), source: str = "source_id") -> DataFrame:
    return last_per_source(runs, is_full_sweep(), "ended_at", order, source)


def last_checkpoint(runs: DataFrame, order: Sequence[str] = ("started_at", "run_id"), source: str = "source_id") -> DataFrame:
    """Of completed runs only, whatever later failed runs saved."""
    return last_per_source(runs, (F.col("status") == "completed") & F.col("checkpoint").isNotNull(), "checkpoint", order, source)


def empty_streak(runs: DataFrame, found: str, order: Sequence[str], source: str = "source_id", depth: int = 10) -> DataFrame:
    """Leading runs that found nothing among each source's ``depth`` latest; truncated ones count too."""
    w = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    recent = runs.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= depth)
    first = F.min(F.when(F.col(found) > 0, F.col("_nth")))
    return recent.groupBy(source).agg(F.coalesce(first - 1, F.count(F.lit(1))).cast("long").alias("streak"))


def nth_latest_sweep(sweeps: DataFrame, n: int, at: str = "started_at", source: str = "source_id", key: str = "run_id") -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.desc(at), F.desc(key))
    return sweeps.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == n).select(source, F.col(at).alias("threshold"))


def withdraw_unseen(documents: DataFrame, sweeps: DataFrame, n: int = 3, seen: str = "last_seen", source: str = "source_id", at: str = "started_at", key: str = "run_id") -> DataFrame:
    """Documents that the last ``n`` complete sweeps of their source did not see.

    A document was missed by n sweeps exactly when the n-th latest one began after its last
    sighting, so the counting join with an inequality becomes an equality join to one row per source.
    """
    return documents.join(nth_latest_sweep(sweeps, n, at, source, key), source).filter(F.col(seen) < F.col("threshold"))


def failure_ratio(outcomes: DataFrame, key: str | None, order: Sequence[str], failed: Column, span: int = 100, limit: float = 0.5) -> DataFrame:
    """Share of failures among the last ``span`` outcomes, and whether it alarms; silent below ``span`` outcomes."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(*order).rowsBetween(-(span - 1), 0)
    bad, n = F.sum(F.when(failed, 1).otherwise(0)).over(w), F.count(F.lit(1)).over(w)
    return outcomes.withColumn("failures", bad).withColumn("seen", n).withColumn("alarm", (n == span) & (bad / n > limit))


def promote(sources: DataFrame, sweeps: DataFrame, as_of: Column, days: int = 30, source: str = "source_id") -> DataFrame:
    """Mode of the next run: full where no full sweep is known or the last is too old."""
    old = F.col("ended_at").isNull() | (F.col("ended_at") < as_of - F.expr(f"interval {days} days"))
    return sources.join(sweeps, source, "left").withColumn("next_mode", F.when(old, "full").otherwise("incremental"))


def quarantine(errors: DataFrame, ratios: DataFrame, streaks: DataFrame, documents: DataFrame, least_empty: int = 3, source: str = "source_id") -> DataFrame:
    """Sources to quarantine and why: a source-wide error, too many failures, or empty sweeps although documents are held."""
    held = documents.select(source).distinct()
    parts = [
        errors.filter("scope = 'source'").select(source, F.lit("error").alias("reason")),
        ratios.filter("alarm").select(source, F.lit("failure_ratio").alias("reason")),
        streaks.filter(F.col("streak") >= least_empty).join(held, source, "left_semi").select(source, F.lit("empty_sweeps").alias("reason")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def silent_sources(sources: DataFrame, runs: DataFrame, as_of: Column, hours: int, source: str = "source_id") -> DataFrame:
    """Enabled sources without a success for longer than the threshold; one that never succeeded is silent."""
    marks = runs.filter("status = 'completed'").groupBy(source).agg(F.max("started_at").alias("last_success_at"))
    met = sources.join(marks, source, "left")
    return met.filter(F.col("last_success_at").isNull() | (F.col("last_success_at") < as_of - F.expr(f"interval {hours} hours")))


def retry_failed(documents: DataFrame, limit: int = 50, at: str = "last_seen", key: str = "document_id") -> DataFrame:
    """The failed documents that the next incremental run tries again, oldest first."""
    return documents.filter("status = 'failed'").orderBy(at, key).limit(limit)


def collection_decision(refs: DataFrame, current: DataFrame, freshness: Column, keys: Sequence[str]) -> DataFrame:
    """skip, identical, new_version or new_document for each reference against the current versions."""
    met = refs.join(current, list(keys), "left")
    decision = (
        F.when(F.col("current_hash").isNull(), "new_document")
        .when(freshness != "changed", "skip")
        .when(F.col("current_hash") == F.col("content_hash"), "identical")
        .otherwise("new_version")
    )
    return met.withColumn("decision", decision)
