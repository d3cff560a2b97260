"""The event journal as JSON lines by day, and its in-memory tail."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusledger.operators.query import tail

EVENT = "spec_version string, id string, type string, source string, time string, run_id string, data string"


def write(events: DataFrame, root: str, mode: str = "append") -> None:
    """Day folders of JSON lines; retention is the removal of folders."""
    day = F.substring("time", 1, 10)
    events.withColumn("day", day).write.mode(mode).partitionBy("day").json(root)


def read(spark: SparkSession, root: str, days: int | None = 7, until: str | None = None) -> DataFrame:
    """The last ``days`` day folders up to ``until``; lines that cannot be read are left out."""
    rows = spark.read.schema(EVENT + ", day string").option("mode", "DROPMALFORMED").json(root)
    rows = rows.filter(F.col("id").isNotNull())
    if days is None:
        return rows
    kept = [day for day in folders(spark, root) if until is None or day <= until][-days:]
    return rows.filter(F.col("day").isin(kept))


def _listing(spark: SparkSession, root: str) -> tuple:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, {s.getPath().getName().removeprefix("day="): s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith("day=")}


def folders(spark: SparkSession, root: str) -> list[str]:
    """The days that the journal has folders for, ascending: a listing, no file is read."""
    return sorted(_listing(spark, root)[1])


def purge(spark: SparkSession, root: str, today: str, days: int = 90) -> list[str]:
    """Remove the folders of days more than ``days`` before ``today`` (ISO dates); names that are no dates stay. The days removed."""
    system, held = _listing(spark, root)
    first = date.fromisoformat(today) - timedelta(days=days)
    gone = sorted(day for day in held if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and date.fromisoformat(day) < first)
    for day in gone:
        system.delete(held[day], True)
    return gone


def ring(events: DataFrame, capacity: int = 10_000, *order: str) -> DataFrame:
    """The last ``capacity`` events, ascending."""
    return tail(events, capacity, *(order or ("time", "id")))
