"""What may go: versions between those that must stay, and contents that nothing refers to (specified for the corpus, an addition of this engine).

Both are lists of what would go, to be looked at before anything acts on them. Nothing is windowed by document, so a document
of very many versions is no large task: what stays is an aggregation, what goes an anti join on (document_id, version_no), the key of a version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_versions(versions: DataFrame, at: str = "at", per_year: bool = True) -> DataFrame:
    """document_id, version_no of the first and last version of each document and, ``per_year``, the last of every year.

    A version without a time belongs to a year of its own.
    """
    years = versions.groupBy("document_id", F.year(at).alias("year")).agg(F.min("version_no").alias("low"), F.max("version_no").alias("high"))
    ends = years.groupBy("document_id").agg(F.array(F.min("low"), F.max("high")).alias("held"))
    if per_year:
        ends = ends.unionByName(years.select("document_id", F.array("high").alias("held")))
    return ends.select("document_id", F.explode("held").alias("version_no")).distinct()


def prunable(versions: DataFrame, at: str = "at", per_year: bool = True) -> DataFrame:
    """The versions that may go, with all their columns. Versions without a document or number stay."""
    known = versions.filter("document_id is not null and version_no is not null")
    return known.join(kept_versions(known, at, per_year), ["document_id", "version_no"], "left_anti")


def collectable(objects: DataFrame, versions: DataFrame, as_of: Column, days: int = 30, stored: str = "stored_at") -> DataFrame:
    """Contents without any reference for at least ``days``, with all their columns.

    References are recounted from the versions; a counter that an object carries is not believed. ``stored`` is when the content was
    stored or, later, lost its last reference; where it is null the age is not known and the content stays.
    """
    used = versions.select("content_hash").distinct()
    return objects.join(used, "content_hash", "left_anti").filter(F.datediff(as_of, F.col(stored)) >= days)
