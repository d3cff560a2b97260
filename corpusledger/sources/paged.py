"""A paged index as a Spark data source, batch and stream; and scripted responses for tests.

The stream's offset is the page to go on from, so a restart resumes where the last batch ended.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = re.compile(r"page-(\d+)\.html")
SCHEMA = "page int, url string, status int, html string"


#: Pages that a task reads at least, and tasks that read a whole index at most.
RUN, MOST_RUNS = 16, 1024


class Run(InputPartition):
    """Pages from ``first`` to before ``end``."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _runs(first: int, end: int) -> list[InputPartition]:
    size = max(RUN, -(-(end - first) // MOST_RUNS))
    return [Run(at, min(at + size, end)) for at in range(first, end, size)]


def _folder(options: dict) -> tuple:
    """The filesystem of the path, any that Arrow opens, and the folder in it."""
    from pyarrow import fs

    path = options["path"]
    return fs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())


def _load(options: dict, run: Run | None) -> Iterator[tuple]:
    """Pages of a folder of ``page-N.html`` files, one by one; a live transport would be another scheme. A page that is not there is an error."""
    if run is None:  # no page at all
        return
    system, folder = _folder(options)
    for page in range(run.first, run.end):
        with system.open_input_file(f"{folder}/page-{page}.html") as file:
            yield page, f"{options.get('base', 'http://localhost')}/?page={page}", 200, file.read().decode("utf-8")


def _count(options: dict) -> int:
    """One more than the highest page."""
    from pyarrow import fs

    system, folder = _folder(options)
    found = [NAME.fullmatch(x.base_name) for x in system.get_file_info(fs.FileSelector(folder))]
    return max((int(m[1]) + 1 for m in found if m), default=0)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first = int(self.options.get("resume", "page:0").removeprefix("page:"))
        end, most = _count(self.options), self.options.get("maxpages")
        return _runs(first, end if most is None else min(end, int(most)))

    def read(self, partition: Run | None) -> Iterator[tuple]:
        return _load(self.options, partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"version": 1, "cursor": self.options.get("resume", "page:0")}

    def latestOffset(self) -> dict:
        return {"version": 1, "cursor": f"page:{_count(self.options)}"}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at = lambda o: int(o["cursor"].removeprefix("page:"))
        return _runs(at(start), at(end))

    def read(self, partition: Run | None) -> Iterator[tuple]:
        return _load(self.options, partition)


class PagedIndex(DataSource):
    """``spark.read.format("paged_index").option("path", folder)``; also base, resume (``page:N``) and maxPages, without which all pages are read. Keys come lower-cased."""

    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedIndex)


def checkpoint(cursor: str | None = None, high_water: str | None = None) -> str:
    return json.dumps({"version": 1, **({"cursor": cursor} if cursor else {}), **({"highWaterMark": high_water} if high_water else {})})


def restore(text: str | None) -> dict:
    """A saved state; empty if it is missing, cannot be read, or has another version."""
    try:
        state = json.loads(text or "{}")
    except ValueError:
        return {}
    return state if isinstance(state, dict) and state.get("version") == 1 else {}


def fixtures(spark: SparkSession, responses: dict[str, list[dict]]) -> DataFrame:
    """Scripted responses by URL, in order; the last one repeats, an unknown URL has none (404)."""
    rows = [(url, i, r.get("status", 200), json.dumps(r.get("headers", {})), r.get("body", ""), r.get("error")) for url, all_ in responses.items() for i, r in enumerate(all_)]
    return spark.createDataFrame(rows, "url string, seq int, status int, headers string, body string, error string")
