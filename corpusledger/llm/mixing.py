"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, by code point with null last, weigh ``weights`` in turn and share ``budget`` times all words.
A target stops at ``cap`` times its source's words; what is above is shared again by weight until
none is above (water filling, solved in closed form over the sorted sources). Each source is taken
in complete epochs first. What remains of its target is filled in the order of the keys
``-ln(u) / w`` with u drawn from the document id and w the document's quality weight, up to the
word the target ends at.

The order within a source is never sorted in one task: rows fall into key buckets of about
``bucket_rows`` rows, bucket sums are accumulated, and only the one bucket in which a source's
budget ends is sorted and prefix-summed. Only the table of sources is broadcast, and only while it
has at most ``broadcast_sources`` rows. Everything is DataFrame functions.

Defined cases: a null text has no words; a document without words is taken 0 words. Null sources
are one source, the last. Rows that repeat are documents of their own; equal keys are ordered by id
and size. A null id draws the key of the empty string. An empty table gives an empty result.
Quality rows that repeat an id count with their highest quality. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.llm.common import join_by_id, plain_names
from corpusledger.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight of labelled documents by quality; unlabelled ones weigh 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Exponential key from 52 bits of the id's MD5, so that any engine can draw the same."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def targets(rows: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """One row per source: source, n, source_size, target. A few rows: the order of all sources needs one task."""
    ranked = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(every) * budget)
        .withColumn("spent", F.coalesce(F.sum("most").over(filled), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", (F.col("all") - F.col("spent")) / (F.sum("weight").over(every) - F.col("used")))
    )
    # The first source whose cap lies above the level fixes the level of it and all after it.
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)
    target = F.when(F.col("ratio") >= F.coalesce(first["ratio"], F.lit(float("inf"))), F.col("weight") * first["level"])
    return shared.select("source", "n", "source_size", F.coalesce(target, F.col("most")).alias("target"))


def _plan(
    rows: DataFrame, weights: Sequence[float], budget: float, cap: float, bucket_rows: int, broadcast_sources: int
) -> tuple[Callable[[DataFrame], DataFrame], Callable[..., DataFrame]]:
    """From ``rows`` (source, size, key): the plan of each source and where in it its budget ends, as functions.

    The first joins the plan to rows by ``source``. The second marks rows so joined with ``extra`` (words of the last, incomplete
    pass) and ``pass`` (1 if that pass takes the row).
    """
    plan = targets(rows, weights, budget, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn(
        "rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long")
    )
    plan = materialise(plan.withColumn("buckets", F.ceil(F.col("n") / bucket_rows).cast("long")), "mix-plan")
    small = plan.count() <= broadcast_sources

    def with_source(left: DataFrame, right: DataFrame, source: str = "source") -> DataFrame:
        right = right.withColumnRenamed("source", "of")
        return left.join(F.broadcast(right) if small else right, F.col(source).eqNullSafe(F.col("of"))).drop("of")

    def bucket(key: str) -> Column:
        return F.least(F.floor((1 - F.exp(-F.col(key))) * F.col("buckets")), F.col("buckets") - 1)

    sums = with_source(rows, plan.select("source", "buckets", "rest")).groupBy("source", "rest", bucket("key").alias("bucket")).agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
        .filter("before < rest")
        .groupBy("source")
        .agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
        .withColumnRenamed("source", "ended")
    )
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("ended")), "left").drop("ended")
    plan = plan.fillna({"last": -1, "before": 0}).select("source", *[F.col(c).alias(f"_mx_{c}") for c in ("source_size", "target", "epochs", "rest", "buckets", "last", "before")])
    plan = materialise(plan, "mix-ends")

    def placed(df: DataFrame) -> DataFrame:
        met = with_source(df, plan, "_mx_source").withColumnRenamed("_mx_buckets", "buckets")
        return met.withColumn("_mx_bucket", bucket("_mx_key")).drop("buckets")

    def filled(df: DataFrame, cut_last: bool) -> DataFrame:
        early = F.col("_mx_bucket") < F.col("_mx_last")
        whole = df.filter("_mx_bucket != _mx_last").withColumn("_mx_extra", F.when(early, F.col("_mx_size")).otherwise(F.lit(0))).withColumn("_mx_pass", early.cast("long"))
        order = Window.partitionBy("_mx_source", "_mx_bucket").orderBy("_mx_key", "_mx_id", "_mx_size").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("_mx_rest") - F.col("_mx_before") - F.coalesce(F.sum("_mx_size").over(order), F.lit(0))
        edge = df.filter("_mx_bucket = _mx_last").withColumn("_mx_left", left)
        if cut_last:
            edge = edge.withColumn("_mx_extra", F.greatest(F.lit(0), F.least("_mx_size", "_mx_left"))).withColumn("_mx_pass", (F.col("_mx_left") > 0).cast("long"))
        else:
            fits = (F.col("_mx_left") > 0) & (2 * F.col("_mx_left") >= F.col("_mx_size"))
            edge = edge.withColumn("_mx_extra", F.when(fits, F.col("_mx_size")).otherwise(F.lit(0))).withColumn("_mx_pass", fits.cast("long"))
        return whole.unionByName(edge.drop("_mx_left"))

    return placed, filled


def _graded(rows: DataFrame, quality: DataFrame | None, id_col: str) -> DataFrame:
    """Adds ``_mx_weight``: one for rows that no label grades."""
    if quality is None:
        return rows.withColumn("_mx_weight", F.lit(1.0))
    weight = F.lit(1.0)
    for grade, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("grade") == grade, F.lit(value)).otherwise(weight)
    graded = quality.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_cl_id")).agg(F.max("quality").alias("grade"))
    graded = graded.select("_cl_id", weight.alias("_mx_weight")).filter("_mx_weight != 1.0")
    return join_by_id(rows, graded, id_col).withColumn("_mx_weight", F.coalesce("_mx_weight", F.lit(1.0)))


def _keyed(docs: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows with their id, source, size and key beside."""
    docs = docs.withColumn("_mx_id", F.col(id_col).cast("long")).withColumn("_mx_source", F.col(source_col).cast("string"))
    docs = _graded(docs.withColumn("_mx_size", words(F.col(text_col))), quality, "_mx_id")
    return docs.withColumn("_mx_key", sampling_key(F.col("_mx_id"), F.col("_mx_weight"))).drop("_mx_weight")


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: float = 1.5,
    cap: float = 2.0,
    cut_last: bool = True,
    bucket_rows: int = 4096,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row.

    ``quality`` has doc_id and quality. ``copies`` counts the passes that take the document, the last
    maybe in part. With ``cut_last`` false the document in which the budget ends is taken whole if at
    least half of it fits, and else not.
    """
    rows = materialise(_keyed(docs, quality, id_col, text_col, source_col).select("_mx_id", "_mx_source", "_mx_size", "_mx_key"), "mix-rows")
    narrow = rows.select(F.col("_mx_source").alias("source"), F.col("_mx_size").alias("size"), F.col("_mx_key").alias("key"))
    placed, filled = _plan(narrow, weights, budget, cap, bucket_rows, broadcast_sources)
    return filled(placed(rows), cut_last).select(
        F.col("_mx_id").alias("doc_id"),
        F.col("_mx_size").alias("size"),
        F.col("_mx_source_size").alias("source_size"),
        F.round("_mx_target", 3).alias("target"),
        (F.col("_mx_epochs") * F.col("_mx_size") + F.col("_mx_extra")).cast("long").alias("taken"),
        (F.col("_mx_epochs") + F.col("_mx_pass")).alias("copies"),
    )


def take(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as many times as it is taken, whole, with all its columns.

    Rows carry their columns through the plan, so that texts that share an id are each taken by themselves; only
    the bucket in which a source's budget ends is shuffled.
    """
    names = docs.columns
    docs, (id_col, text_col, source_col) = plain_names(docs, id_col, text_col, source_col)
    keyed = _keyed(docs, quality, id_col, text_col, source_col)
    narrow = keyed.select(F.col("_mx_source").alias("source"), F.col("_mx_size").alias("size"), F.col("_mx_key").alias("key"))
    placed, filled = _plan(materialise(narrow, "mix-rows"), WEIGHTS, 1.5, 2.0, 4096, 100_000)
    copies = (F.col("_mx_epochs") + F.col("_mx_pass")).cast("int")
    met = filled(placed(keyed), cut_last=False).withColumn("_mx_copies", copies).filter("_mx_copies > 0")
    return met.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).select(*docs.columns).toDF(*names)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id, source, text
), k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / w AS key FROM d
), s AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), v AS (
  SELECT *, (total - coalesce(sum(most) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), x AS (SELECT min(ratio) AS ratio, arg_min(level, ratio) AS level FROM v WHERE ratio > level),
t AS (
  SELECT v.source, v.source_size, CASE WHEN v.ratio >= coalesce(x.ratio, 'inf'::DOUBLE) THEN v.weight * x.level ELSE v.most END AS target FROM v, x
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, greatest(0, CAST(round(e.target - e.epochs * e.source_size) AS BIGINT)) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken,
       CAST(epochs + CASE WHEN rest - before > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o
"""
