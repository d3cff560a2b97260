"""Registered queries of expectations, retention and monotone ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusledger.operators import expectations, retention, ulids
from corpusledger.plans.catalogue import AS_OF, registered
from corpusledger.runtime import table

#: Suppliers are sources, line items what their runs found; returned ones failed. The day stands amid the data.
TODAY = "1998-06-01"
FOUND_SQL = f"""f AS (SELECT l_suppkey AS source_id, CAST(l_shipdate AS DATE) AS day, CAST(floor(l_extendedprice) AS BIGINT) AS size, l_returnflag = 'R' AS bad,
  date_diff('day', CAST(l_shipdate AS DATE), DATE '{TODAY}') AS age FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{TODAY}'),
m AS (SELECT source_id, quantile_disc(size, 0.5) FILTER (NOT bad AND age < 30) AS recent_median, quantile_disc(size, 0.5) FILTER (NOT bad AND age BETWEEN 30 AND 394) AS earlier_median
  FROM f WHERE age < 395 GROUP BY 1)"""
VERSIONS_SQL = """v AS (SELECT l_partkey AS document_id, l_orderkey * 8 + l_linenumber AS version_no, max(l_shipdate) AS made, l_orderkey AS content_hash FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber),
w AS (SELECT *, min(version_no) OVER (PARTITION BY document_id) AS low, max(version_no) OVER (PARTITION BY document_id) AS high,
  max(version_no) OVER (PARTITION BY document_id, year(made)) AS last FROM v)"""
FROM_ULID_SQL = "substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(({} >> (5 * i)) % 32 AS INTEGER) + 1, 1)"


def _days(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").withColumn("size", F.floor("l_extendedprice").cast("long"))
    return expectations.daily(found, "l_suppkey", "l_shipdate", "size", F.col("l_returnflag") == "R")


@registered(f"WITH {FOUND_SQL} SELECT * FROM m")
def source_size_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median sizes of the last 30 days and of the year before, by merging the days' sketches."""
    today = F.lit(TODAY).cast("date")
    return expectations.window_medians(_days(spark, d).filter(F.col("day") <= today), today)


@registered(f"""WITH {FOUND_SQL}, e AS (SELECT s_suppkey AS source_id, 1 + s_suppkey % 20 AS every, CASE WHEN s_suppkey % 5 = 0 THEN 6 ELSE 0 END AS least, s_suppkey % 2 AS most FROM supplier),
d AS (SELECT source_id, day, count(*) FILTER (NOT bad) AS found, count(*) FILTER (bad) AS failures FROM f GROUP BY 1, 2),
l AS (SELECT source_id, max(day) AS ran, max(day) FILTER (found > 0) AS got, arg_max(found, day) AS found, arg_max(failures, day) AS failures FROM d GROUP BY 1),
a AS (SELECT e.*, l.* EXCLUDE source_id, recent_median, earlier_median, date_diff('day', ran, DATE '{TODAY}') AS idle, date_diff('day', got, DATE '{TODAY}') AS barren
  FROM e LEFT JOIN l USING (source_id) LEFT JOIN m USING (source_id))
SELECT source_id, 'silent' AS alert, CAST(coalesce(idle, -1) AS DOUBLE) AS measured FROM a WHERE idle IS NULL OR idle > every
UNION ALL SELECT source_id, 'sterile', coalesce(barren, -1) FROM a WHERE barren IS NULL OR barren > 7
UNION ALL SELECT source_id, 'volume', found FROM a WHERE found > 5 * most OR found * 5 < least
UNION ALL SELECT source_id, 'failures', failures / (found + failures) FROM a WHERE failures / (found + failures) > 0.2
UNION ALL SELECT source_id, 'median_size', recent_median FROM a WHERE recent_median < 30000 OR recent_median > 40000
UNION ALL SELECT source_id, 'size_collapse', earlier_median / recent_median FROM a WHERE recent_median > 0 AND earlier_median / recent_median >= 10""")
def expectation_alerts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    expected = table(spark, d, "supplier").select(
        key.alias("source_id"), (1 + key % 20).alias("runs_every_days"), F.when(key % 5 == 0, 6).otherwise(0).alias("least_found"), (key % 2).alias("most_found"),
        F.lit(30_000).alias("least_bytes"), F.lit(40_000).alias("most_bytes"),
    )
    return expectations.alerts(expected, _days(spark, d), F.lit(TODAY).cast("date"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Parts are documents, each line of an order a version, the order its content."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at"))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("version_no")
    return lines.select(F.col("l_partkey").alias("document_id"), number, "at", F.col("l_orderkey").alias("content_hash"))


@registered(f"WITH {VERSIONS_SQL} SELECT document_id, version_no, content_hash FROM w WHERE version_no NOT IN (low, high, last)")
def prunable_versions(spark: SparkSession, d: str) -> DataFrame:
    return retention.prunable(_versions(spark, d)).select("document_id", "version_no", "content_hash")


@registered(f"""WITH {VERSIONS_SQL} SELECT o_orderkey AS content_hash, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF[:10]}') AS idle_days FROM orders
WHERE o_orderkey NOT IN (SELECT content_hash FROM w WHERE version_no IN (low, high, last)) AND date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF[:10]}') >= 30""")
def collectable_objects(spark: SparkSession, d: str) -> DataFrame:
    """Contents that nothing refers to once the prunable versions are gone."""
    versions = _versions(spark, d)
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("content_hash"), F.col("o_orderdate").alias("stored_at"))
    today = F.lit(AS_OF[:10]).cast("date")
    left = versions.join(retention.kept_versions(versions), ["document_id", "version_no"], "left_semi")
    gone = retention.collectable(objects, left, today)
    return gone.select("content_hash", F.datediff(today, "stored_at").cast("long").alias("idle_days"))


@registered(f"""WITH t AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY ms ORDER BY o_orderkey) - 1 AS n, sha256('0:' || ms) AS h FROM t),
s AS (SELECT *, CAST('0x' || substr(h, 1, 10) AS BIGINT) & 549755813887 AS high, CAST('0x' || substr(h, 11, 10) AS BIGINT) + n AS low FROM r)
SELECT o_orderkey, array_to_string(list_transform(range(9, -1, -1), lambda i: {FROM_ULID_SQL.format('ms')}), '')
  || array_to_string(list_transform(range(7, -1, -1), lambda i: {FROM_ULID_SQL.format('(high + (low >> 40))')}), '')
  || array_to_string(list_transform(range(7, -1, -1), lambda i: {FROM_ULID_SQL.format('(low & 1099511627775)')}), '') AS ulid FROM s""")
def monotone_ulids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return ulids.monotone_ulids(rows, "ms", "o_orderkey").select("o_orderkey", "ulid")
