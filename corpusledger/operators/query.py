"""Keyset pages of the corpus and filters of the event journal."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.runtime import materialise

from corpusledger.functions.identity import CURSOR_PREFIX

DEFAULT_LIMIT, MOST = 100, 1000


def to_cursor(key: str) -> str:
    return base64.urlsafe_b64encode(f"{CURSOR_PREFIX}{key}".encode()).decode().rstrip("=")


def from_cursor(cursor: str) -> str:
    text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode("utf-8", "replace")
    if not text.startswith(CURSOR_PREFIX):
        raise ValueError("unknown cursor")
    return text.removeprefix(CURSOR_PREFIX)


@dataclass(frozen=True)
class DocumentQuery:
    """A conjunction of optional conditions; ``changed_since`` is strict."""

    source_id: str | None = None
    status: str | None = None
    changed_since: Any = None
    cursor: str | None = None
    limit: int = DEFAULT_LIMIT

    @property
    def size(self) -> int:
        return max(1, min(MOST, self.limit))

    def apply(self, documents: DataFrame, key: str = "document_id", at: str = "fetched_at") -> DataFrame:
        """The page's rows and one more, in key order: a top-k, never a full sort."""
        out = documents
        for column, value in (("source_id", self.source_id), ("status", self.status)):
            if value is not None:
                out = out.filter(F.col(column) == value)
        if self.changed_since is not None:
            out = out.filter(F.col(at) > self.changed_since)
        if self.cursor is not None:
            out = out.filter(F.col(key) > F.lit(from_cursor(self.cursor)).cast(out.schema[key].dataType))
        return out.orderBy(key).limit(self.size + 1)

    def page(self, documents: DataFrame, key: str = "document_id", at: str = "fetched_at") -> tuple[list, str | None]:
        """Rows of the page, and the cursor of the next one if there is one."""
        rows = self.apply(documents, key, at).collect()
        more = len(rows) > self.size
        rows = rows[: self.size]
        return rows, to_cursor(str(rows[-1][key])) if more else None


def type_matches(column: Column, pattern: str) -> Column:
    """``*``, ``prefix.*`` or a whole type."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith(".*"):
        return column.startswith(pattern[:-1])
    return column == pattern


def filter_events(events: DataFrame, pattern: str = "*", since: Any = None, run_id: str | None = None, source: str | None = None) -> DataFrame:
    """``since`` is strict; ``source`` matches the end of the event's source path."""
    out = events.filter(type_matches(F.col("type"), pattern))
    if since is not None:
        out = out.filter(F.col("time") > since)
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if source is not None:
        out = out.filter(F.col("source").endswith(f"/{source}"))
    return out


def tail(events: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last rows by ``order``, in that order."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def content_batch(objects: DataFrame, after: str | None, limit: int, key: str = "content_hash") -> DataFrame:
    return (objects if after is None else objects.filter(F.col(key) > after)).orderBy(key).limit(limit)


def unverified_first(objects: DataFrame, limit: int, verified: str = "last_verified_at", stored: str = "stored_at", key: str = "content_hash") -> DataFrame:
    """Never verified objects first, then those verified longest ago."""
    return objects.orderBy(F.asc_nulls_first(verified), stored, key).limit(limit)


def failed_oldest_first(documents: DataFrame, limit: int, at: str, key: str, status: str = "status") -> DataFrame:
    return documents.filter(F.col(status) == "failed").orderBy(at, key).limit(limit)


def sources_in_order(sources: DataFrame, key: str = "source_id") -> DataFrame:
    """All sources by id, with their place. They are sorted in ranges; a range's rows are numbered on from the sizes of those before it.

    What comes to the driver is a number a partition.
    """
    ranged = materialise(sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = sorted(map(tuple, ranged.groupBy("_part").count().collect()))
    before = dict(zip((part for part, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    table = sources.sparkSession.createDataFrame(list(before.items()), "_at int, _before long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    met = ranged.join(F.broadcast(table), F.col("_part") == F.col("_at"))
    return met.select(*sources.columns, (F.col("_before") + nth).alias("place"))


def versions_in_order(versions: DataFrame, document: str = "document_id", number: str = "version_no") -> DataFrame:
    """Each document's versions with their place, oldest first."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(number)).cast("long"))


def pending(documents: DataFrame, states: Sequence[str], status: str = "status") -> DataFrame:
    """The part of the documents that a partial index on the status holds: the predicate reaches the scan."""
    return documents.filter(F.col(status).isin(list(states)))
