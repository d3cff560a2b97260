"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every ASCII white-space character is deleted.
Three combining stages, each grouped by the digest *and* the full normalised text, so a digest
collision can never merge different texts:

1. each map task combines the copies it holds (the partial side of the salted aggregation);
2. copies are merged within (digest, salt), the salt being drawn from the document id, so that a
   group with a third of all rows is spread over ``salts`` tasks;
3. the salt winners, at most ``salts`` rows a text, are combined globally.

Defined cases: null texts count as empty, and all empty or white-space-only texts are equal. The
row with the most code points in the original text stays, then the smallest id; a null id loses to
any other. Rows that repeat both id and text count in ``group_size`` and only one of them is kept.
An empty table gives an empty result. Further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.llm.common import join_by_id, join_groups, plain_names
from corpusledger.runtime import materialise

WHITE_SPACE = " \t\n\x0b\f\r"

#: Weight of a code point in the rank, above the span of all 64-bit ids.
_SPAN = 10**20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank(doc_id: Column, text: Column) -> Column:
    """Largest for the row that stays; one decimal, so the hash aggregate can hold it in place."""
    wide = "decimal(38,0)"
    tie = F.coalesce(F.lit(2**63 - 1).cast(wide) - doc_id.cast(wide), F.lit(-1).cast(wide))
    return (F.length(text).cast(wide) * F.lit(str(_SPAN)).cast(wide) + tie).cast(wide)


def content_groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size, variants, content.

    ``variants`` counts the texts that share the digest; ``content`` is set only where it is above 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(text).alias("content"),
        _rank(F.col(id_col), text).alias("rank"),
    ).select("doc_id", "content", "rank", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max_by("doc_id", "rank").alias("doc_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("members")
    )
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max_by("doc_id", "rank").alias("keep_id"), F.sum("members").alias("group_size"))
    )
    variants = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return winners.withColumn("variants", variants).select(
        "digest", "keep_id", "group_size", "variants", F.when(F.col("variants") > 1, F.col("content")).alias("content")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """Every row's decision: doc_id, keep_id, group_size, kept, text_sha256.

    Only ids and digests travel in the last join. Texts travel there too for digests that more than
    one text shares, which no real corpus has for SHA-256 and which tests force with a weak digest.
    """
    groups = materialise(content_groups(docs, id_col, text_col, digest, salts), "exact-groups")
    content = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content"))
    marked = rows.select("doc_id", digest(F.col("content")).alias("digest"), sha256(F.col("content")).alias("text_sha256"), "content")

    plain = groups.filter("variants = 1").select("digest", "keep_id", "group_size")
    joined = join_groups(marked.select("doc_id", "digest", "text_sha256"), plain, "digest", "group_size").filter("group_size is not null")
    shared = groups.filter("variants > 1").select("digest", "content", "keep_id", "group_size")
    if not shared.isEmpty():
        joined = joined.unionByName(marked.join(shared, ["digest", "content"]).drop("content"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("text_sha256"))
    return joined.withColumn("nth", nth).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows without an id stay.

    An id that is on several rows is judged text by text: of each text that it keeps one row stays, that
    with the most code points, then the last by text and by the row's hash.
    """
    names = docs.columns
    docs, (id_col, text_col) = plain_names(docs, id_col, text_col)
    made = exact_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).filter("doc_id is not null")
    made = materialise(made.select("doc_id", "kept", "text_sha256"), "exact-decisions")
    rows = made.groupBy(F.col("doc_id").alias("_cl_id")).agg(F.max("kept").alias("_cl_kept"), (F.count(F.lit(1)) > 1).alias("_cl_many"))
    marked = join_by_id(docs, rows.filter("_cl_many or not _cl_kept").drop("_cl_kept"), id_col)
    stay = marked.filter("_cl_many is null").select(*docs.columns)
    many = rows.filter("_cl_many").select(F.col("_cl_id").alias("doc_id"))
    if many.isEmpty():
        return stay.toDF(*names)
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), sha256(normalised(F.col(text_col))).alias("sha"))
    kept = made.filter("kept").join(many, "doc_id").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("_cl_id"), F.lit(True).alias("_cl_stays"))
    met = join_by_id(marked.filter("_cl_many").drop("_cl_many").withColumn("_cl_key", key), kept, "_cl_key").filter("_cl_stays")
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    first = F.max_by(F.struct(*docs.columns), F.struct(size, F.col(text_col), F.xxhash64(*docs.columns))).alias("_cl_row")
    return stay.unionByName(met.groupBy("_cl_key").agg(first).select("_cl_row.*")).toDF(*names)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents
), k AS (
  SELECT doc_id, c, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size
  FROM d WINDOW w AS (PARTITION BY c ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM k
"""
