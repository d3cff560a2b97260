"""What a document source offers: its references, plans to fetch them, metadata, health and checkpoints, each as a table.

A source is any object with ``source_id``, ``api_version``, ``discover`` and ``resolve``; what more it can do is told by the
methods it has. All of them take and return DataFrames, so a source is a logical plan and nothing is fetched while it is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusledger.operators import pages
from corpusledger.sources.paged import checkpoint, restore

#: Columns of a reference; a fetch plan adds the request.
REFERENCE = ("native_id", "url", "title", "published_at", "declared_bytes")
PLAN = ("native_id", "method", "url", "headers", "accept")


@runtime_checkable
class Source(Protocol):
    source_id: str
    api_version: str

    def discover(self, spark: SparkSession, mode: str = "full", since: str | None = None, most: int | None = None) -> DataFrame: ...

    def resolve(self, refs: DataFrame) -> DataFrame: ...


#: capability -> the members that show it
CAPABILITIES = {
    "describable": ("describe",),
    "paged": ("discover_page",),
    "incremental": ("checkpoint", "restore"),
    "health_reporting": ("health",),
    "browser_assisted": ("browser_profile",),
}


def capabilities(source: object) -> dict[str, bool]:
    """What a source can do, by the members it has; nothing is declared."""
    return {name: all(getattr(source, member, None) is not None for member in members) for name, members in CAPABILITIES.items()}


def fetch_plan(refs: DataFrame, url: Column | None = None, method: str = "GET", headers: dict[str, str] | None = None, accept: str = "*/*") -> DataFrame:
    """One request per reference; nothing is downloaded."""
    pairs = [F.lit(x) for item in (headers or {}).items() for x in item]
    sent = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return refs.select("native_id", F.lit(method).alias("method"), (F.col("url") if url is None else url).alias("url"), sent.alias("headers"), F.lit(accept).alias("accept"))


def metadata(refs: DataFrame, raw: list[str], common: dict[str, str], locator: str, at: Column) -> DataFrame:
    """native_id with the metadata struct: raw fields, those under common names, and where each of these was found."""
    string = lambda c: F.col(c).cast("string")
    as_map = lambda pairs: F.map_filter(F.create_map(*[x for pair in pairs for x in pair]), lambda k, v: v.isNotNull())
    found = [F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("field"), F.lit(f"{locator}.{c}").alias("locator"), at.cast("string").alias("at"))) for name, c in common.items()]
    body = F.struct(
        as_map([(F.lit(c), string(c)) for c in raw]).alias("raw"),
        as_map([(F.lit(name), string(c)) for name, c in common.items()]).alias("common"),
        F.array_compact(F.array(*found)).alias("provenance"),
    )
    return refs.select("native_id", body.alias("metadata"))


def health_report(first_page: DataFrame, layout: str, status: str = "status", html: str = "html") -> DataFrame:
    """One row: down without an answer, degraded if the page has lost the layout's marker, else ok."""
    marker, empty = pages.MARKERS[layout]
    answered = F.coalesce(F.max(F.col(status).between(200, 399)), F.lit(False))
    known = F.coalesce(F.max(F.col(html).contains(marker) | F.col(html).rlike(empty)), F.lit(False))
    state = F.when(~answered, "down").when(~known, "degraded").otherwise("ok")
    return first_page.agg(state.alias("status"), F.when(answered & ~known, F.lit("structure changed")).alias("detail"))


@dataclass
class PagedSource:
    """A skeleton for sources with a paged index: parse, stop and resume are its hooks.

    ``layout`` names the markup; :meth:`parse`, :meth:`is_known_page` and :meth:`resolve` may be overridden.
    """

    source_id: str
    path: str
    layout: str = "aside"
    base_url: str = "http://localhost"
    api_version: str = "1.0"
    state: dict = field(default_factory=dict)

    def pages(self, spark: SparkSession, first: int = 0, most: int | None = None) -> DataFrame:
        """Pages from ``first``, to before ``most`` if there is such a bound."""
        reader = spark.read.format("paged_index").option("path", self.path).option("base", self.base_url).option("resume", f"page:{first}")
        return (reader if most is None else reader.option("maxPages", most)).load()

    def parse(self, found: DataFrame) -> DataFrame:
        return pages.aside_entries(found, self.base_url) if self.layout == "aside" else pages.article_entries(found)

    def is_known_page(self, refs: DataFrame, since: str) -> DataFrame:
        """First page on which everything is older than ``since`` less a margin."""
        return pages.early_stop(refs.withColumn("published_at", F.col("published_at").cast("date")), "page", "published_at", F.lit(since).cast("date"))

    def discover(self, spark: SparkSession, mode: str = "full", since: str | None = None, most: int | None = None) -> DataFrame:
        """References in page order, each id at its first sight; an incremental run ends before the first page of old ones."""
        first = int(str(self.state.get("cursor", "page:0")).removeprefix("page:"))
        refs = self.parse(self.pages(spark, first))
        if mode == "incremental" and since:
            stop = self.is_known_page(refs, since).first()["stop_page"]
            refs = refs if stop is None else refs.filter(F.col("page") < stop)
        refs = pages.first_occurrence(refs, "native_id", ["page", "pos"])
        return refs if most is None else refs.orderBy("page", "pos").limit(most)

    def discover_page(self, spark: SparkSession, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """The references of one page, and the cursor of the next; None after the last."""
        page = int((cursor or "page:0").removeprefix("page:"))
        refs = self.parse(self.pages(spark, page, page + 1))
        return refs, None if self.pages(spark, page + 1, page + 2).isEmpty() else f"page:{page + 1}"

    def resolve(self, refs: DataFrame) -> DataFrame:
        return fetch_plan(refs)

    def describe(self, refs: DataFrame) -> DataFrame:
        named = [c for c in ("title", "published_at", "number", "label", "description") if c in refs.columns]
        return metadata(refs, named, {c: c for c in ("title", "published_at") if c in refs.columns}, self.layout, F.lit(None))

    def health(self, spark: SparkSession) -> DataFrame:
        return health_report(self.pages(spark, 0, 1), self.layout)

    def checkpoint(self, page: int, high_water: str | None = None) -> str:
        return checkpoint(f"page:{page}", high_water)

    def restore(self, text: str | None) -> None:
        self.state = restore(text)


#: Events that other systems may rely on, and those that are only seen inside.
PUBLIC_EVENTS = ("run.started", "run.completed", "document.discovered", "document.stored", "document.version_created", "document.failed", "source.quarantined", "integrity.violation")
INTERNAL_EVENTS = ("document.unchanged", "discovery.budget_exceeded", "plugin.loaded", "plugin.rejected", "plugin.disposed", "schema.migrated")


def event_visibility(kind: Column) -> Column:
    """public or internal; null for a type that the catalogue does not know. A prefix before the catalogue's names does not count."""
    named = lambda names: F.lit(False) if not names else kind.rlike(rf"(?:^|^[^.]+\.)(?:{'|'.join(map(re.escape, names))})$")
    return F.when(named(PUBLIC_EVENTS), "public").when(named(INTERNAL_EVENTS), "internal")


def match_sources(configured: DataFrame, offered: DataFrame, key: str = "source_id") -> DataFrame:
    """Every configured or offered source: loaded, missing (no plugin), conflict (several plugins of one id) or unused."""
    counts = offered.groupBy(key).agg(F.count(F.lit(1)).alias("plugins"))
    met = configured.select(key, F.lit(True).alias("_configured")).distinct().join(counts, key, "full")
    n = F.coalesce("plugins", F.lit(0))
    status = F.when(n > 1, "conflict").when(n == 0, "missing").when(F.col("_configured").isNull(), "unused").otherwise("loaded")
    return met.select(key, n.alias("plugins"), status.alias("status"))
