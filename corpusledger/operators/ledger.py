"""Current state as pure folds over append-only facts.

Nothing is updated in place: a table of facts is folded by key with one shuffle, and folding twice,
or in another row order, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_REASON = "non precise"
STALE_REASON = "execution interrompue"


def latest(facts: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The last fact of each key by ``order``, made by a partial aggregate: only one row per key and task is shuffled."""
    columns = [c for c in (columns or facts.columns) if c not in keys]
    packed = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return facts.groupBy(*keys).agg(packed).select(*keys, "_last.*")


def upsert_sources(facts: DataFrame, key: str, at: str, state: Sequence[str]) -> DataFrame:
    """Latest registration of each source; first_seen is kept from the first one."""
    tie = [at, *state]
    last = F.max_by(F.struct(*state), F.struct(*tie)).alias("_last")
    return facts.groupBy(key).agg(last, F.min(at).alias("first_seen"), F.max(at).alias("updated_at")).select(key, "_last.*", "first_seen", "updated_at")


def source_state(sources: DataFrame, state: str = "state", reason: str = "reason", at: str = "at") -> DataFrame:
    """Reason and date belong to a quarantine only; a quarantine without a reason gets the default."""
    held = F.col(state) == "quarantined"
    return sources.withColumn(reason, F.when(held, F.coalesce(F.col(reason), F.lit(DEFAULT_REASON)))).withColumn(at, F.when(held, F.col(at)))


def run_marks(runs: DataFrame, source: str = "source_id") -> DataFrame:
    """last_run_at of all runs, last_success_at of completed ones."""
    done = F.when(F.col("status") == "completed", F.col("ended_at"))
    return runs.groupBy(source).agg(F.max("started_at").alias("last_run_at"), F.max(done).alias("last_success_at"))


def fail_stale_runs(runs: DataFrame, before: Column, ended_at: Column) -> DataFrame:
    """Runs that began before ``before`` and still run have failed; ``ended_at`` is when that is found."""
    stale = (F.col("status") == "running") & (F.col("started_at") < before)
    return (
        runs.withColumn("error_summary", F.when(stale, F.lit(STALE_REASON)).otherwise(F.col("error_summary")))
        .withColumn("ended_at", F.when(stale, ended_at).otherwise(F.col("ended_at")))
        .withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status")))
    )


def fold_documents(facts: DataFrame, keys: Sequence[str], at: str, kind: str, url: str, order: Sequence[str]) -> DataFrame:
    """State of each document after its facts in order; ``kind`` is seen, stored, failed or withdrawn.

    A sighting of a withdrawn document makes it stored, even if nothing was ever stored, and clears
    the date; a failure leaves a stored document stored, and turns any other to failed while the date
    of withdrawal stays. The url is the last one known. The machine is a higher-order fold over one
    document's facts, of which each run adds one.
    """
    none = F.lit(None).cast(facts.schema[at].dataType)
    start = F.struct(F.lit(None).cast("string").alias("status"), none.alias("gone"))

    def step(s: Column, x: Column) -> Column:
        what, now = x[kind], s["status"]
        status = (
            F.when(what == "withdrawn", "withdrawn")
            .when(what == "stored", "stored")
            .when((what == "failed") & ~now.eqNullSafe("stored"), "failed")
            .when(what == "failed", now)
            .when(now == "withdrawn", "stored")
            .otherwise(F.coalesce(now, F.lit("discovered")))
        )
        back = (what == "stored") | ((what == "seen") & now.eqNullSafe("withdrawn"))
        return F.struct(status.alias("status"), F.when(what == "withdrawn", x[at]).when(~back, s["gone"]).alias("gone"))

    seen, named = list(dict.fromkeys([*order, at, kind])), F.col(url).isNotNull()
    folded = facts.groupBy(*keys).agg(
        F.min(F.when(F.col(kind) != "withdrawn", F.col(at))).alias("first_seen"),
        F.max(F.when(F.col(kind).isin("seen", "stored"), F.col(at))).alias("last_seen"),
        F.max_by(F.col(url), F.when(named, F.struct(*order))).alias("url"),
        F.aggregate(F.sort_array(F.collect_list(F.struct(*seen))), start, step).alias("_state"),
    )
    return folded.select(*keys, "first_seen", "last_seen", "url", F.col("_state.status").alias("status"), F.col("_state.gone").alias("withdrawn_at"))


def commit_versions(facts: DataFrame, hash_col: str = "content_hash", order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Idempotent commit: one row per (document, version); the first hash wins."""
    rest = [c for c in facts.columns if c not in ("document_id", "version_no")]
    first = F.min_by(F.struct(*rest), F.struct(*order, hash_col)).alias("_first")
    return facts.groupBy("document_id", "version_no").agg(first).select("document_id", "version_no", "_first.*")


def version_conflicts(facts: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """(document, version) pairs that were committed with different hashes."""
    found = F.countDistinct(hash_col).alias("hashes")
    return facts.groupBy("document_id", "version_no").agg(found).filter("hashes > 1")


def number_versions(states: DataFrame, key: str, order: Sequence[str], hash_col: str) -> DataFrame:
    """Only changes of content make a version: numbered from 1, with the version superseded."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = states.withColumn("_before", F.lag(hash_col).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(hash_col)))
    number = F.row_number().over(w)
    return changed.withColumn("version_no", number).withColumn("supersedes", F.lag("version_no").over(w)).drop("_before")


def content_objects(refs: DataFrame, hash_col: str, size_col: str, order: Sequence[str]) -> DataFrame:
    """First writer of each content and how many references it has."""
    rest = [c for c in refs.columns if c not in (hash_col, size_col)]
    first = F.min_by(F.struct(size_col, *rest), F.struct(*order)).alias("_first")
    return refs.groupBy(hash_col).agg(first, F.count(F.lit(1)).alias("ref_count")).select(hash_col, "_first.*", "ref_count")


def new_objects(incoming: DataFrame, existing: DataFrame, hash_col: str, order: Sequence[str]) -> DataFrame:
    """Insert or ignore: first of each hash among the incoming that the store does not have."""
    fresh = incoming.join(existing.select(hash_col), hash_col, "left_anti")
    return _first(fresh, hash_col, order)


def _first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(key, "_first.*")


def recount(objects: DataFrame, versions: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """ref_count derived from versions, 0 for objects that none refers to."""
    counts = versions.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_n"))
    return objects.join(counts, hash_col, "left").withColumn("ref_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def number_attempts(attempts: DataFrame, document: str, run: str, order: Sequence[str]) -> DataFrame:
    return attempts.withColumn("attempt_no", F.row_number().over(Window.partitionBy(document, run).orderBy(*order)))


def attempt_outcomes(attempts: DataFrame, run: str, outcome: str, kinds: Sequence[str]) -> DataFrame:
    """Counters of each run, one column per outcome."""
    return attempts.groupBy(run).agg(F.count(F.lit(1)).alias("attempts"), *[F.sum(F.when(F.col(outcome) == k, 1).otherwise(0)).alias(k) for k in kinds])


def verify_state(checks: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Latest check of each object."""
    return latest(checks, [hash_col], ["checked_at", "result"])


def attach_references(references: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Descriptor bodies: the references of each object, one per (document, version), in that order."""
    once = _first(references.withColumn("_key", F.struct(hash_col, "document_id", "version_no")), "_key", ["fetched_at"]).drop("_key")
    body = F.struct(*[c for c in ("document_id", "version_no", "source_id", "native_id", "fetched_at") if c in references.columns])
    return once.groupBy(hash_col).agg(F.sort_array(F.collect_list(body)).alias("references"))


def purge(objects: DataFrame, purged: DataFrame, hash_col: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(objects that stay, tombstones of those that go)."""
    return objects.join(purged.select(hash_col), hash_col, "left_anti"), objects.join(purged, hash_col)
