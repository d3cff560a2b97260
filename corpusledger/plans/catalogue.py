"""The registered queries of the engine and their SQL oracles, over the driver's stand-in tables.

Each query runs an operator of this package on the table that plays its role; ``SQL`` beside it says
the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusledger.functions import content, decisions, identity, text
from corpusledger.operators import integrity, ledger, pages, policy, query, sweeps, views
from corpusledger.runtime import table

QUERIES: dict = {}
ORACLES: dict = {}

AS_OF = "1998-08-01 00:00:00"
ISO_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
#: Documents as references: id, hash and size of each text.
REFS_SQL = """refs AS (SELECT doc_id, source, text, sha256(concat(source, chr(31), CAST(doc_id AS VARCHAR))) AS document_id,
  'sha256:' || sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size FROM documents)"""
RUN_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS source_id, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"""


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def refs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        "source",
        "text",
        identity.document_id(F.col("source"), F.col("doc_id")).alias("document_id"),
        identity.content_hash(F.col("text")).alias("content_hash"),
        F.octet_length("text").cast("long").alias("byte_size"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("started_at"), status.alias("status")
    )


def versions(spark: SparkSession, d: str) -> DataFrame:
    said = F.col("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"),
        (F.col("turn") + 1).alias("version_no"),
        identity.content_hash(said).alias("content_hash"),
        F.octet_length(said).cast("long").alias("byte_size"),
    )


VERSIONS_SQL = """versions AS (SELECT conv_id AS document_id, turn + 1 AS version_no, 'sha256:' || sha256(text) AS content_hash,
  CAST(octet_length(encode(text)) AS BIGINT) AS byte_size FROM conversations)"""
CONTENTS_SQL = "contents AS (SELECT content_hash, any_value(byte_size) AS byte_size, count(*) AS ref_count FROM versions GROUP BY 1)"


def contents(found: DataFrame) -> DataFrame:
    return ledger.content_objects(found.select("content_hash", "byte_size"), "content_hash", "byte_size", ["byte_size"])


@registered(f"""WITH {VERSIONS_SQL}, {CONTENTS_SQL}, d AS (SELECT document_id, max(version_no) AS version_no FROM versions GROUP BY 1)
SELECT d.document_id, d.version_no, v.content_hash, c.byte_size, c.ref_count FROM d JOIN versions v USING (document_id, version_no) JOIN contents c USING (content_hash)""")
def current_documents(spark: SparkSession, d: str) -> DataFrame:
    all_ = versions(spark, d)
    docs = all_.groupBy("document_id").agg(F.max("version_no").alias("current_version"))
    found = views.current_documents(docs, all_.drop("byte_size"), contents(all_))
    return found.select("document_id", "version_no", "content_hash", "byte_size", "ref_count")


@registered(f"""WITH {VERSIONS_SQL} SELECT document_id, version_no, content_hash FROM versions WHERE document_id = 7
AND version_no = (SELECT max(version_no) FROM versions WHERE document_id = 7)""")
def current_version_lookup(spark: SparkSession, d: str) -> DataFrame:
    all_ = versions(spark, d)
    docs = all_.filter("document_id = 7").groupBy("document_id").agg(F.max("version_no").alias("current_version"))
    return views.current_version(docs, all_, 7).select("document_id", "version_no", "content_hash")


@registered(f"WITH {REFS_SQL} SELECT doc_id, document_id FROM refs")
def document_id_hash(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("doc_id", "document_id")


@registered(f"""WITH {REFS_SQL} SELECT content_hash, min(byte_size) AS byte_size, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id, count(*) AS ref_count
FROM refs GROUP BY 1""")
def content_objects(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.content_objects(refs(spark, d).select("content_hash", "byte_size", "source", "doc_id"), "content_hash", "byte_size", ["doc_id"])
    return found.select("content_hash", "byte_size", "source", "doc_id", "ref_count")


@registered(f"WITH {REFS_SQL} SELECT content_hash, count(DISTINCT source) AS sources, count(*) AS refs FROM refs GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    return views.shared_contents(refs(spark, d), source="source")


@registered(f"""WITH {REFS_SQL} SELECT doc_id, 'objects/' || substr(content_hash, 8, 2) || '/' || substr(content_hash, 10, 2) || '/' || substr(content_hash, 8)
|| CASE WHEN byte_size >= 4096 THEN '.bin.zst' ELSE '.bin' END AS path FROM refs""")
def shard_path(spark: SparkSession, d: str) -> DataFrame:
    packed = F.when(content.compressible(F.lit("text/plain"), F.col("byte_size")), "zstd").otherwise("none")
    return refs(spark, d).select("doc_id", identity.shard_path(F.col("content_hash"), packed).alias("path"))


@registered(f"""WITH {RUN_SQL}, held AS (SELECT o_custkey AS source_id, count(DISTINCT l_partkey) AS documents,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS failed_documents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
ran AS (SELECT source_id, max(CASE WHEN status = 'completed' THEN started_at END) AS ok,
  sum(CASE WHEN status = 'failed' AND started_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS failed FROM runs GROUP BY 1)
SELECT c_custkey AS source_id, coalesce(documents, 0) AS documents, coalesce(failed_documents, 0) AS failed_documents, {ISO_SQL.format("ok")} AS last_success_at,
  CAST(coalesce(failed, 0) AS BIGINT) AS failed_runs_7d FROM customer LEFT JOIN held ON held.source_id = c_custkey LEFT JOIN ran ON ran.source_id = c_custkey""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    docs = pairs.groupBy(F.col("o_custkey").alias("source_id"), F.col("l_partkey").alias("document_id")).agg(
        F.when(F.max((F.col("l_returnflag") == "R").cast("int")) == 1, "failed").otherwise("stored").alias("status")
    )
    health = views.source_health(sources, docs, runs(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return health.select("source_id", "documents", "failed_documents", identity.iso(F.col("last_success_at")).alias("last_success_at"), "failed_runs_7d")


@registered(f"""WITH {REFS_SQL}, c AS (SELECT content_hash, any_value(byte_size) AS byte_size FROM refs GROUP BY 1)
SELECT strftime(TIMESTAMP '2026-01-01' + INTERVAL (doc_id % 30) DAY, '%Y-%m-%d') AS day, count(*) AS versions, CAST(sum(c.byte_size) AS BIGINT) AS bytes
FROM refs JOIN c USING (content_hash) GROUP BY 1""")
def daily_growth(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d)
    at = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("timestamp")
    return views.daily_growth(found.select("content_hash", at.alias("fetched_at")), contents(found))


@registered(f"WITH {RUN_SQL} SELECT run_id, source_id, {ISO_SQL.format('started_at')} AS started_at, status FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 25")
def recent_runs_25(spark: SparkSession, d: str) -> DataFrame:
    return views.recent_runs(runs(spark, d)).withColumn("started_at", identity.iso(F.col("started_at")))


@registered(f"WITH {RUN_SQL} SELECT run_id, {ISO_SQL.format('started_at')} AS started_at, status FROM runs WHERE source_id = 4 ORDER BY runs.started_at DESC, run_id DESC LIMIT 20")
def runs_by_source_topn(spark: SparkSession, d: str) -> DataFrame:
    return views.recent_runs(runs(spark, d), 20, 4).select("run_id", identity.iso(F.col("started_at")).alias("started_at"), "status")


PAGE_SQL = "WITH {refs} SELECT document_id, doc_id, source FROM refs WHERE source = 'src1' {after} ORDER BY document_id LIMIT 11"


def _documents_of_source(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("document_id", "doc_id", "source", F.col("source").alias("source_id"))


@registered(PAGE_SQL.format(refs=REFS_SQL, after=""))
def document_page_first(spark: SparkSession, d: str) -> DataFrame:
    return query.DocumentQuery(source_id="src1", limit=10).apply(_documents_of_source(spark, d)).drop("source_id")


@registered(PAGE_SQL.format(refs=REFS_SQL, after="AND document_id > '8000'"))
def document_page_next(spark: SparkSession, d: str) -> DataFrame:
    return query.DocumentQuery(source_id="src1", limit=10, cursor=query.to_cursor("8000")).apply(_documents_of_source(spark, d)).drop("source_id")


@registered("SELECT doc_id, replace(replace(rtrim(base64(encode('v1:' || doc_id)), '='), '+', '-'), '/', '_') AS cursor, CAST(doc_id AS VARCHAR) AS back FROM documents")
def cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select("doc_id", identity.encode_cursor(F.col("doc_id")).alias("cursor"))
    return made.withColumn("back", identity.decode_cursor(F.col("cursor")))


@registered(f"WITH {RUN_SQL} SELECT run_id, source_id FROM runs WHERE status = 'failed' ORDER BY started_at, run_id LIMIT 50")
def failed_oldest_first(spark: SparkSession, d: str) -> DataFrame:
    return query.failed_oldest_first(runs(spark, d), 50, "started_at", "run_id").select("run_id", "source_id")


@registered(f"""WITH {REFS_SQL} SELECT doc_id, content_hash, quality FROM refs LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, byte_size, doc_id LIMIT 100""")
def unverified_priority(spark: SparkSession, d: str) -> DataFrame:
    met = refs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return query.unverified_first(met, 100, "quality", "byte_size", "doc_id").select("doc_id", "content_hash", "quality")


@registered(f"WITH {REFS_SQL}, c AS (SELECT content_hash, any_value(byte_size) AS b FROM refs GROUP BY 1) SELECT count(*) AS objects, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM c")
def object_totals(spark: SparkSession, d: str) -> DataFrame:
    return views.totals(contents(refs(spark, d)))


@registered("SELECT source AS source_id, count(*) AS documents FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.source_counts(table(spark, d, "documents").withColumnRenamed("source", "source_id"))


def _swept(spark: SparkSession, d: str) -> DataFrame:
    """Runs with mode, error summary and checkpoint by rule."""
    key = F.col("run_id")
    return runs(spark, d).select(
        "*",
        F.lit("full").alias("mode"),
        F.col("started_at").alias("ended_at"),
        F.when(key % 7 == 0, "budget").alias("error_summary"),
        F.when(key % 3 == 0, F.concat(F.lit('{"version":1,"cursor":"page:'), (key % 100).cast("string"), F.lit('"}'))).alias("checkpoint"),
    )


SWEPT_SQL = RUN_SQL + """, swept AS (SELECT *, CASE WHEN run_id % 7 = 0 THEN 'budget' END AS error_summary,
  CASE WHEN run_id % 3 = 0 THEN '{"version":1,"cursor":"page:' || (run_id % 100) || '"}' END AS checkpoint FROM runs)"""


@registered(f"""WITH {SWEPT_SQL} SELECT source_id, {ISO_SQL.format("arg_max(started_at, (started_at, run_id))")} AS ended_at FROM swept
WHERE status = 'completed' AND error_summary IS NULL GROUP BY 1""")
def last_full_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.last_full_sweep(_swept(spark, d)).withColumn("ended_at", identity.iso(F.col("ended_at")))


@registered(f"""WITH {SWEPT_SQL} SELECT source_id, arg_max(checkpoint, (started_at, run_id)) AS checkpoint FROM swept
WHERE status = 'completed' AND checkpoint IS NOT NULL GROUP BY 1""")
def last_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.last_checkpoint(_swept(spark, d))


def _found_per_run(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("found"))
    return runs(spark, d).join(lines, "run_id", "left").fillna({"found": 0})


STREAK_SQL = f"""WITH {RUN_SQL}, f AS (SELECT l_orderkey AS run_id, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS found FROM lineitem GROUP BY 1),
n AS (SELECT source_id, coalesce(found, 0) AS found, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS nth FROM runs LEFT JOIN f USING (run_id) WHERE status = 'completed'),
streaks AS (SELECT source_id, CAST(coalesce(min(CASE WHEN found > 0 THEN nth END) - 1, count(*)) AS BIGINT) AS streak FROM n WHERE nth <= 10 GROUP BY 1)"""


@registered(STREAK_SQL + " SELECT source_id, streak FROM streaks")
def empty_run_streak(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.empty_streak(_found_per_run(spark, d).filter("status = 'completed'"), "found", ["started_at", "run_id"])


@registered("""WITH d AS (SELECT o_custkey AS source_id, l_partkey AS document_id, max(o_orderdate) AS last_seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT source_id, document_id FROM d WHERE (SELECT count(*) FROM orders WHERE o_custkey = d.source_id AND o_orderstatus = 'F' AND o_orderdate > d.last_seen) >= 3""")
def withdraw_unseen(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    docs = pairs.groupBy(F.col("o_custkey").alias("source_id"), F.col("l_partkey").alias("document_id")).agg(F.max("o_orderdate").alias("last_seen"))
    return sweeps.withdraw_unseen(docs, runs(spark, d).filter("status = 'completed'")).select("source_id", "document_id")


RATIO_SQL = """ratio AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS failures, count(*) OVER w AS seen FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    # Ten outcomes a source, not a hundred: no stand-in source has so many.
    return sweeps.failure_ratio(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", span=10)


@registered(f"WITH {RATIO_SQL} SELECT event_id, CAST(failures AS BIGINT) AS failures, seen, seen = 10 AND failures / seen > 0.5 AS alarm FROM ratio")
def failure_ratio_window(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).select("event_id", "failures", "seen", "alarm")


@registered(f"""WITH {VERSIONS_SQL} SELECT document_id, version_no, content_hash, lag(version_no) OVER (PARTITION BY document_id ORDER BY version_no) AS supersedes FROM versions""")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    states = versions(spark, d).withColumnRenamed("version_no", "at")
    return ledger.number_versions(states, "document_id", ["at"], "content_hash").select("document_id", "version_no", "content_hash", "supersedes")


@registered("""WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_no FROM l WHERE before IS NULL OR before <> event_type""")
def change_detection_n3(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.number_versions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return found.select("user_id", "event_id", "event_type", "version_no")


@registered("""SELECT doc_id, CASE WHEN quality IS NOT NULL AND doc_id % 3 <> 0 THEN CASE WHEN quality = doc_id % 2 THEN 'etag_match' ELSE 'changed' END
WHEN toxic IS NOT NULL THEN CASE WHEN toxic = doc_id % 2 THEN 'not_modified' ELSE 'changed' END WHEN doc_id % 5 = 0 THEN 'incremental_skip' ELSE 'changed' END AS freshness
FROM documents LEFT JOIN labels USING (doc_id)""")
def freshness_ladder(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    now, key = (F.col("doc_id") % 2).cast("int"), F.col("doc_id")
    found = decisions.freshness(F.col("quality"), F.when(key % 3 != 0, now), F.col("toxic"), now, key % 5 == 0)
    return met.select("doc_id", found.alias("freshness"))


@registered("SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_shipdate, l_linenumber) AS attempt_no FROM lineitem")
def attempt_numbering(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.number_attempts(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", ["l_shipdate", "l_linenumber"])
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "attempt_no")


@registered("""SELECT l_orderkey AS run_id, count(*) AS attempts, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS success,
CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS transient_error FROM lineitem GROUP BY 1""")
def attempt_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "skipped").otherwise("transient_error")
    attempts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), outcome.alias("outcome"))
    return ledger.attempt_outcomes(attempts, "run_id", "outcome", ["success", "skipped", "transient_error"])


@registered(f"""SELECT user_id, arg_max(event_type, (ts, event_type, event_id)) AS event_type, arg_max(event_id, (ts, event_type, event_id)) AS event_id,
{ISO_SQL.format("min(ts)")} AS first_seen, {ISO_SQL.format("max(ts)")} AS updated_at FROM events GROUP BY 1""")
def upsert_source_latest(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.upsert_sources(table(spark, d, "events"), "user_id", "ts", ["event_type", "event_id"])
    return found.withColumn("first_seen", identity.iso(F.col("first_seen"))).withColumn("updated_at", identity.iso(F.col("updated_at")))


DISCOVERY_SQL = f"""WITH k AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' WHEN 'purchase' THEN 'stored' WHEN 'error' THEN 'failed' ELSE 'withdrawn' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'u' || event_id END AS url FROM events),
g AS (SELECT user_id, min(CASE WHEN kind <> 'withdrawn' THEN ts END) AS first_seen, max(CASE WHEN kind IN ('seen', 'stored') THEN ts END) AS last_seen,
  arg_max(url, (ts, event_id)) FILTER (url IS NOT NULL) AS url, list(kind || '@' || {ISO_SQL.format("ts")} ORDER BY ts, event_id) AS facts FROM k GROUP BY 1),
f AS (SELECT *, list_reduce(list_prepend('@', facts), lambda a, x: CASE split_part(x, '@', 1)
  WHEN 'seen' THEN CASE WHEN split_part(a, '@', 1) = '' THEN 'discovered@' WHEN split_part(a, '@', 1) = 'withdrawn' THEN 'stored@' ELSE a END
  WHEN 'stored' THEN 'stored@'
  WHEN 'failed' THEN CASE WHEN split_part(a, '@', 1) = 'stored' THEN a ELSE 'failed@' || split_part(a, '@', 2) END
  ELSE x END) AS state FROM g)
SELECT user_id, {ISO_SQL.format("first_seen")} AS first_seen, {ISO_SQL.format("last_seen")} AS last_seen, url, split_part(state, '@', 1) AS status, nullif(split_part(state, '@', 2), '') AS withdrawn_at FROM f"""


@registered(DISCOVERY_SQL)
def discovery_fold(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "seen").when(F.col("event_type") == "purchase", "stored")
    kind = kind.when(F.col("event_type") == "error", "failed").otherwise("withdrawn")
    facts = table(spark, d, "events").select(
        "user_id", "ts", "event_id", kind.alias("kind"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("url")
    )
    found = ledger.fold_documents(facts, ["user_id"], "ts", "kind", "url", ["ts", "event_id"])
    stamps = ("first_seen", "last_seen", "withdrawn_at")
    return found.select(*[identity.iso(F.col(c)).alias(c) if c in stamps else F.col(c) for c in found.columns])


@registered(f"""WITH {RUN_SQL} SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{AS_OF}' THEN 'failed' ELSE status END AS status,
CASE WHEN status = 'running' AND started_at < TIMESTAMP '{AS_OF}' THEN 'execution interrompue' END AS error_summary,
CASE WHEN status = 'running' AND started_at < TIMESTAMP '{AS_OF}' THEN '1998-08-02T06:00:00.000Z' END AS ended_at FROM runs""")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).withColumn("error_summary", F.lit(None).cast("string")).withColumn("ended_at", F.lit(None).cast("timestamp_ntz"))
    found = ledger.fail_stale_runs(rows, F.lit(AS_OF).cast("timestamp_ntz"), F.lit("1998-08-02 06:00:00").cast("timestamp_ntz"))
    return found.select("run_id", "status", "error_summary", identity.iso(F.col("ended_at")).alias("ended_at"))


@registered("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def orphan_versions(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_versions(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@registered("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def versions_without_content(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return integrity.versions_without_content(table(spark, d, "lineitem"), held, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


def _declared(spark: SparkSession, d: str) -> DataFrame:
    all_ = versions(spark, d)
    # Stand-in: every tenth document declares one version too few.
    return all_.groupBy("document_id").agg((F.count(F.lit(1)) - F.when(F.col("document_id") % 10 == 0, 1).otherwise(0)).alias("current_version"))


DECLARED_SQL = VERSIONS_SQL + ", declared AS (SELECT document_id, count(*) - CASE WHEN document_id % 10 = 0 THEN 1 ELSE 0 END AS current_version, max(version_no) AS highest FROM versions GROUP BY 1)"


@registered(f"WITH {DECLARED_SQL} SELECT document_id, current_version, highest FROM declared WHERE current_version <> highest")
def current_version_consistent(spark: SparkSession, d: str) -> DataFrame:
    return integrity.inconsistent_current(_declared(spark, d), versions(spark, d)).select("document_id", "current_version", "highest")


@registered(f"""WITH {DECLARED_SQL}, r AS (SELECT 'orphan_versions' AS invariant, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id)
UNION ALL SELECT 'versions_without_content', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)
UNION ALL SELECT 'current_version', count(*) FROM declared WHERE current_version <> highest) SELECT * FROM r WHERE n > 0""")
def invariant_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.invariant_report(
        orphan_versions=orphan_versions(spark, d), versions_without_content=versions_without_content(spark, d), current_version=current_version_consistent(spark, d)
    )


@registered(f"WITH {REFS_SQL} SELECT DISTINCT content_hash FROM refs WHERE content_hash NOT IN (SELECT content_hash FROM refs JOIN labels USING (doc_id))")
def unindexed_objects(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).select("doc_id", "content_hash")
    index = found.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return integrity.unindexed(found.select("content_hash").distinct(), index)


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Objects with damage by rule."""
    kind = F.col("doc_id") % 50
    found = refs(spark, d)
    result = integrity.verify(
        F.col("doc_id") % 97 == 0, kind != 1, kind != 2, F.when(kind == 3, F.col("byte_size") + 1).otherwise(F.col("byte_size")), F.col("byte_size"),
        F.when(kind == 4, F.lit("sha256:0")).otherwise(F.col("content_hash")), F.col("content_hash"),
    )
    return found.select("doc_id", "content_hash", "source", result.alias("result"))


RESULT_SQL = """CASE WHEN doc_id % 97 = 0 THEN 'ok' WHEN doc_id % 50 = 1 THEN 'missing_file' WHEN doc_id % 50 = 2 THEN 'unreadable'
WHEN doc_id % 50 = 3 THEN 'size_mismatch' WHEN doc_id % 50 = 4 THEN 'hash_mismatch' ELSE 'ok' END"""


@registered(f"""WITH r AS (SELECT {RESULT_SQL} AS result FROM documents) SELECT count(*) FILTER (result = 'ok') AS ok, count(*) FILTER (result = 'hash_mismatch') AS hash_mismatch,
count(*) FILTER (result = 'size_mismatch') AS size_mismatch, count(*) FILTER (result = 'unreadable') AS unreadable, count(*) FILTER (result = 'missing_file') AS missing_file FROM r""")
def integrity_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.result_counts(_checked(spark, d))


@registered(f"SELECT doc_id, {RESULT_SQL} AS result, CASE {RESULT_SQL} WHEN 'ok' THEN 'ok' WHEN 'missing_file' THEN 'missing' ELSE 'corrupt' END AS verify_status FROM documents")
def tombstone_verify(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("doc_id", "result", decisions.verify_status(F.col("result")).alias("verify_status"))


@registered(f"""WITH {REFS_SQL}, r AS (SELECT *, {RESULT_SQL} AS result FROM refs)
SELECT content_hash, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS documents FROM refs
WHERE content_hash IN (SELECT content_hash FROM r WHERE result NOT IN ('ok', 'missing_file')) GROUP BY 1""")
def violation_documents(spark: SparkSession, d: str) -> DataFrame:
    bad = _checked(spark, d).filter("result not in ('ok', 'missing_file')")
    return integrity.affected_documents(refs(spark, d), bad).withColumn("documents", F.array_join("documents", ","))


@registered("""SELECT conv_id AS document_id, max(turn + 1) AS current_version, count(DISTINCT turn) AS version_count, min(turn) AS first_seen, max(turn) AS last_changed,
arg_max(role, turn) FILTER (turn % 3 <> 2) AS url FROM conversations GROUP BY 1""")
def rebuild_documents(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("version_no"), F.col("turn").alias("fetched_at"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("url")
    )
    return integrity.rebuild_documents(found)


@registered(f"""WITH {REFS_SQL}, o AS (SELECT DISTINCT content_hash FROM refs), v AS (SELECT content_hash, count(*) AS n FROM refs SEMI JOIN labels USING (doc_id) GROUP BY 1)
SELECT content_hash, coalesce(n, 0) AS ref_count FROM o LEFT JOIN v USING (content_hash)""")
def ref_recount(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).select("doc_id", "content_hash")
    return ledger.recount(found.select("content_hash").distinct(), found.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"))


def _journal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("corpus.document."), F.col("event_type")).alias("type"), F.col("ts").alias("time"),
        F.concat(F.lit("/sources/"), (F.col("user_id") % 10).cast("string")).alias("source"), (F.col("event_id") % 7).cast("string").alias("run_id"),
    )


PATTERNS = ("*", "corpus.document.*", "corpus.document.error")


@registered("""WITH j AS (SELECT event_id, 'corpus.document.' || event_type AS type FROM events WHERE ts > TIMESTAMP '2024-01-10' AND event_id % 7 = 3 AND user_id % 10 = 4)
SELECT '*' AS pattern, event_id FROM j UNION ALL SELECT 'corpus.document.*', event_id FROM j UNION ALL SELECT 'corpus.document.error', event_id FROM j WHERE type = 'corpus.document.error'""")
def event_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    parts = [query.filter_events(_journal(spark, d), p, since, "3", "4").select(F.lit(p).alias("pattern"), "event_id") for p in PATTERNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registered("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    return query.tail(table(spark, d, "events"), 100, "ts", "event_id").select("event_id", "event_type")


@registered("SELECT event_id, event_type FROM events")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type")
    return events.unionByName(events).dropDuplicates(["event_id"])


LINKS_SQL = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)"""


@registered(f"""WITH {LINKS_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, regexp_replace(regexp_replace(split_part(href, '?', 1), '^.*/documents/', ''), '^/+|/+$', '', 'g') AS native_id FROM links""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(table(spark, d, "pages")).withColumn("native_id", text.stable_id(F.col("href")))


@registered(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#039;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
length(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS h1_chars FROM pages""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    found = lambda tag: F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return table(spark, d, "pages").select("page_id", text.strip_tags(found("title")).alias("title"), F.length(found("h1")).alias("h1_chars"))


@registered(f"WITH {LINKS_SQL} SELECT href, min(page_id) AS page_id, CAST(arg_min(pos, (page_id, pos)) AS INTEGER) AS pos FROM links GROUP BY 1")
def page_dedup_in_run(spark: SparkSession, d: str) -> DataFrame:
    return pages.first_occurrence(pages.links(table(spark, d, "pages")), "href", ["page_id", "pos"]).select("href", "page_id", "pos")


def _site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of ten sites, with the number of links and of links that are new on the site."""
    listed = pages.links(table(spark, d, "pages").select((F.col("page_id") % 10).alias("site"), "page_id", "html").select(F.struct("site", "page_id").alias("at"), "html"), "at")
    listed = listed.select("at.site", "at.page_id", "pos", "href")
    firsts = pages.first_occurrence(listed, "href", ["page_id", "pos"], "site").groupBy("site", "page_id").agg(F.count(F.lit(1)).alias("fresh"))
    counts = table(spark, d, "pages").select((F.col("page_id") % 10).alias("site"), "page_id", F.size(F.regexp_extract_all("html", F.lit("<a href"), F.lit(0))).alias("found"))
    signed = pages.signatures(listed, "page_id", "href")
    met = counts.join(firsts, ["site", "page_id"], "left").join(signed, "page_id", "left").fillna({"fresh": 0, "signature": ""})
    return pages.repeats(met, "page_id", "site")


SITE_SQL = f"""{LINKS_SQL}, f AS (SELECT page_id % 10 AS site, href, min(page_id) AS page_id FROM links GROUP BY 1, 2), n AS (SELECT page_id, count(*) AS fresh FROM f GROUP BY 1),
s AS (SELECT page_id, count(*) AS found, string_agg(href, chr(31) ORDER BY pos) AS signature FROM links GROUP BY 1),
site AS (SELECT page_id % 10 AS site, page_id, coalesce(found, 0) AS found, coalesce(fresh, 0) AS fresh, coalesce(signature, '') AS signature FROM pages LEFT JOIN n USING (page_id) LEFT JOIN s USING (page_id)),
marked AS (SELECT *, coalesce(signature = lag(signature) OVER (PARTITION BY site ORDER BY page_id), false) AS repeated, CASE WHEN fresh <= 3 THEN 1 ELSE 0 END AS flag FROM site),
isles AS (SELECT *, sum(1 - flag) OVER (PARTITION BY site ORDER BY page_id) AS isle FROM marked)"""


@registered(f"WITH {SITE_SQL} SELECT site, page_id, found, fresh, repeated, CAST(sum(flag) OVER (PARTITION BY site, isle ORDER BY page_id) AS BIGINT) AS streak FROM isles")
def page_signature_repeat(spark: SparkSession, d: str) -> DataFrame:
    found = pages.streaks(_site_pages(spark, d), "page_id", F.col("fresh") <= 3, "site")
    return found.select("site", "page_id", F.col("found").cast("long").alias("found"), "fresh", "repeated", "streak")


@registered("""WITH p AS (SELECT event_id // 20 AS page, max(ts) AS newest FROM events GROUP BY 1) SELECT min(page) AS stop_page FROM p WHERE newest < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY""")
def early_stop_page(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 20))
    return pages.early_stop(listed, "page", "ts", F.lit("2024-01-20").cast("timestamp_ntz"))


@registered(f"SELECT user_id, event_id, {ISO_SQL.format('max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS high_water FROM events")
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    found = pages.high_water(table(spark, d, "events").select("user_id", "event_id", "ts"), ["event_id"], "ts", "user_id")
    return found.select("user_id", "event_id", identity.iso(F.col("high_water")).alias("high_water"))


@registered("""SELECT doc_id, printf('%04d-%02d-%02d', 2000 + doc_id % 30, 1 + doc_id % 12, 1 + doc_id % 28) AS published_at,
CAST(CASE doc_id % 3 WHEN 0 THEN floor((doc_id + 0.5) * 1024 + 0.5) WHEN 1 THEN floor((doc_id + 0.5) * 1048576 + 0.5) ELSE floor(doc_id + 0.5 + 0.5) END AS BIGINT) AS bytes FROM documents""")
def size_date_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    said = F.format_string("Publié le %02d.%02d.%04d <b class='semibold'>%d,5 %s</b>", 1 + key % 28, 1 + key % 12, 2000 + key % 30, key,
                           F.when(key % 3 == 0, "Ko").when(key % 3 == 1, "Mo").otherwise("o"))
    return table(spark, d, "documents").select("doc_id", text.published_date(said).alias("published_at"), text.declared_size(said).alias("bytes"))


@registered("""WITH b AS (SELECT 'd' || doc_id AS id, text AS body FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'j' || event_id, props FROM events)
SELECT id, CASE WHEN body = '' OR (octet_length(encode(body)) > 3 AND substr(hex(encode(body)), 2 * (least(octet_length(encode(body)), 4096) - 3) + 1, 1) IN ('8', '9', 'A', 'B')) OR regexp_matches(substr(body, 1, 1000), '[\\x00-\\x08\\x0e-\\x1f]') THEN NULL WHEN starts_with(lower(ltrim(body)), '<!doctype html') OR starts_with(lower(ltrim(body)), '<html') THEN 'text/html'
WHEN starts_with(lower(ltrim(body)), '<?xml') THEN 'application/xml' WHEN starts_with(ltrim(body), '{') OR starts_with(ltrim(body), '[') THEN 'application/json' ELSE 'text/plain' END AS mime,
octet_length(encode(body)) >= 4096 AS compressible FROM b""")
def mime_sniff(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body"))
    bodies = bodies.unionByName(table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("body")))
    bodies = bodies.unionByName(table(spark, d, "events").select(F.concat(F.lit("j"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("body")))
    found = bodies.select("id", content.sniff_mime(F.col("body")).alias("mime"), F.octet_length("body").alias("size"))
    return found.select("id", "mime", content.compressible(F.coalesce("mime", F.lit("text/plain")), F.col("size")).alias("compressible"))


@registered(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages
WHERE regexp_matches(url, '^https://') AND regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(www\.)?th.*\.example\.org$')""")
def host_pattern(spark: SparkSession, d: str) -> DataFrame:
    host = text.url_host(F.col("url"))
    return table(spark, d, "pages").filter(F.col("url").startswith("https://") & host.rlike(r"^(www\.)?th.*\.example\.org$")).select("page_id", host.alias("host"))


ALLOWED = ["thther.example.org", "m.ththth.example.net", "therha.example.com", "ththre.example.com"]


@registered(f"SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN ({', '.join(repr(h) for h in ALLOWED)}) AND regexp_matches(url, '^https?:')")
def host_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(text.host_allowed(F.col("url"), ALLOWED)).select("page_id", "url")


@registered("""WITH r AS (SELECT event_id, user_id % 5 AS host, epoch_us(ts) // 1000 AS ms FROM events) SELECT event_id, count(*) OVER (PARTITION BY host ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS in_minute,
count(*) OVER (PARTITION BY host ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) > 1 AS over_quota,
CAST(coalesce(greatest(0, 60000 - (ms - lag(ms) OVER (PARTITION BY host ORDER BY ms, event_id))), 0) AS BIGINT) AS wait_ms FROM r""")
def sliding_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("host"), "ts")
    return policy.request_pressure(rows, "host", "ts", "event_id", quota=1, delay_ms=60_000).select("event_id", "in_minute", "over_quota", "wait_ms")


@registered("""WITH s AS (SELECT event_type AS host, list({'n': 1, 'fast': value, 'base': value} ORDER BY ts, event_id) AS x FROM events GROUP BY 1),
l AS (SELECT host, list_reduce(x, lambda a, v: {'n': a.n + 1, 'fast': 0.3::DOUBLE * v.fast + (1 - 0.3::DOUBLE) * a.fast,
  'base': CASE WHEN v.fast < a.base THEN 0.3::DOUBLE * v.fast + (1 - 0.3::DOUBLE) * a.base ELSE 0.01::DOUBLE * v.fast + (1 - 0.01::DOUBLE) * a.base END}) AS f FROM s)
SELECT host, f.n AS samples, round(f.fast, 6) AS fast, round(f.base, 6) AS baseline, round(CASE WHEN f.n < 5 OR f.base <= 0 OR f.fast / f.base <= 2 THEN 1 ELSE least(f.fast / f.base, 8) END, 6) AS factor FROM l""")
def adaptive_slowdown(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(F.col("event_type").alias("host"), "ts", "event_id", "value")
    found = policy.slowdown(samples, "host", ["ts", "event_id"], "value")
    return found.select("host", "samples", F.round("fast", 6).alias("fast"), F.round("baseline", 6).alias("baseline"), F.round("factor", 6).alias("factor"))


@registered("""WITH RECURSIVE e AS (SELECT user_id % 5 AS host, epoch_us(ts) // 1000 AS at_ms, event_type IN ('error', 'click') AS failed, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT host, n, event_id, at_ms, CAST('closed' AS VARCHAR) AS state, CASE WHEN failed THEN 1 ELSE 0 END AS bad, CAST(NULL AS BIGINT) AS opened FROM e WHERE n = 1
UNION ALL SELECT x.host, x.n, x.event_id, x.at_ms, x.state, CASE WHEN x.state = 'open' THEN x.bad WHEN x.failed THEN x.bad + 1 ELSE 0 END,
  CASE WHEN x.state = 'open' THEN x.opened WHEN x.failed AND x.bad + 1 >= 2 THEN x.at_ms END
FROM (SELECT e.*, r.bad, r.opened, CASE WHEN r.opened IS NULL THEN 'closed' WHEN e.at_ms - r.opened < 3600000 THEN 'open' ELSE 'half-open' END AS state FROM r JOIN e ON e.host = r.host AND e.n = r.n + 1) x)
SELECT host, at_ms, event_id, state, state <> 'open' AS allowed FROM r""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """An ordered state machine."""
    rows = table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").isin("error", "click").alias("failed"), "event_id"
    )
    return policy.breaker(rows, "host", "at_ms", "failed", "event_id", threshold=2, cooldown_ms=3_600_000)


WINDOWS = [
    {"days": "mon-fri", "from": "08:00", "to": "18:00"},
    {"days": "sat", "from": "22:00", "to": "06:00"},
    {"days": "fri-mon", "from": "19:00", "to": "19:30"},
    {"days": "*", "from": "8h", "to": "9h"},
]


@registered("""WITH t AS (SELECT event_id, dayofweek(ts) AS d, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_id FROM t WHERE (d BETWEEN 1 AND 5 AND m >= 480 AND m < 1080) OR (d = 6 AND m >= 1320) OR (d = 0 AND m < 360) OR (d IN (5, 6, 0, 1) AND m >= 1140 AND m < 1170)""")
def blackout_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(policy.in_blackout(F.col("ts"), WINDOWS)).select("event_id")


@registered("""SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 6 AND 20 AND (day(ts) IN (1, 15) OR dayofweek(ts) BETWEEN 1 AND 5)""")
def cron_due(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(policy.cron_matches(F.col("ts"), "*/15 6-20 1,15 * 1-5")).select("event_id")


@registered("SELECT CAST(n AS BIGINT) AS attempt, CASE WHEN n <= 1 THEN 0 ELSE CAST(1000 * pow(4, n - 2) AS BIGINT) END AS delay_ms FROM range(1, 6) t(n)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").alias("attempt"), decisions.backoff_ms(F.col("id")).alias("delay_ms"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/6\nDisallow: /*ref=\nDisallow: /fr/8*5$\n"


@registered(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, CASE WHEN starts_with(path, '/en/6') THEN 5 ELSE -1 END AS allow, greatest(CASE WHEN starts_with(path, '/en/') THEN 4 ELSE -1 END,
CASE WHEN contains(path, 'ref=') THEN 6 ELSE -1 END, CASE WHEN regexp_matches(path, '^/fr/8.*5$') THEN 8 ELSE -1 END) AS deny FROM p)
SELECT page_id, deny = -1 OR allow >= deny AS allowed FROM m""")
def robots_decision(spark: SparkSession, d: str) -> DataFrame:
    allowed = policy.robots_allowed(text.url_path(F.col("url")), policy.parse_robots(ROBOTS), "corpusledger/1.0", to_end=True)
    return table(spark, d, "pages").select("page_id", allowed.alias("allowed"))


@registered(f"""SELECT c_custkey AS source_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS ok FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey
WHERE ok IS NULL OR ok < TIMESTAMP '{AS_OF}' - INTERVAL 4800 HOUR""")
def silent_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return sweeps.silent_sources(sources, runs(spark, d), F.lit(AS_OF).cast("timestamp_ntz"), 4800).select("source_id")


@registered("""SELECT event_id, sha256('{"a":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS config_hash FROM events""")
def canonical_config_hash(spark: SparkSession, d: str) -> DataFrame:
    config = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(' , "a" : '), F.col("event_id").cast("string"), F.lit(" }"))
    return table(spark, d, "events").select("event_id", F.sha2(text.canonical_json(config).cast("binary"), 256).alias("config_hash"))


@registered(f"""{STREAK_SQL}, {RATIO_SQL} SELECT source_id, 'empty_sweeps' AS reason FROM streaks WHERE streak >= 2
UNION SELECT user_id, 'failure_ratio' FROM ratio WHERE seen = 10 AND failures / seen > 0.5 UNION SELECT o_custkey, 'error' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""")
def quarantine_candidates(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("source_id"), F.lit("source").alias("scope"))
    ratios = _ratios(spark, d).select(F.col("user_id").alias("source_id"), "alarm")
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"))
    return sweeps.quarantine(errors, ratios, empty_run_streak(spark, d), held, least_empty=2)


@registered(f"""WITH {REFS_SQL}, w AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS requests, CAST(sum(byte_size) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS bytes FROM refs)
SELECT doc_id, source, requests, bytes FROM w WHERE requests <= 30 AND bytes <= 60000""")
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    found = policy.within_budget(refs(spark, d), "source", ["doc_id"], "byte_size", requests=30, most_bytes=60_000)
    return found.select("doc_id", "source", F.col("requests").cast("long").alias("requests"), "bytes")


@registered(f"""WITH {REFS_SQL} SELECT doc_id, CASE WHEN byte_size < 200 THEN 'too_small' WHEN byte_size > 5000 THEN 'too_large' WHEN NOT starts_with(text, 'The') THEN 'magic' END AS violation FROM refs
WHERE byte_size < 200 OR byte_size > 5000 OR NOT starts_with(text, 'The')""")
def expectation_violations(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text").cast("binary")
    found = content.violation(body, F.col("byte_size"), F.lit("text/plain; charset=utf-8"), F.lit(None).cast("string"), 200, 5000, "546865", ["text/plain"])
    return refs(spark, d).select("doc_id", found.alias("violation")).filter("violation is not null")


@registered("""WITH v AS (SELECT event_id, user_id, event_type, event_id % 50 AS version_no FROM events) SELECT user_id AS document_id, version_no, count(DISTINCT event_type) AS hashes FROM v GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1""")
def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 50).alias("version_no"), F.col("event_type").alias("content_hash"))
    return ledger.version_conflicts(facts)


@registered("""SELECT user_id AS document_id, event_id % 50 AS version_no, arg_min(event_type, (ts, event_type)) AS content_hash FROM events GROUP BY 1, 2""")
def commit_idempotent(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), (F.col("event_id") % 50).alias("version_no"), F.col("event_type").alias("content_hash"), F.col("ts").alias("fetched_at")
    )
    return ledger.commit_versions(facts.unionByName(facts)).select("document_id", "version_no", "content_hash")


@registered(f"""WITH {SWEPT_SQL}, l AS (SELECT source_id, max(started_at) AS ended_at FROM swept WHERE status = 'completed' AND error_summary IS NULL GROUP BY 1)
SELECT c_custkey AS source_id, CASE WHEN ended_at IS NULL OR ended_at < TIMESTAMP '{AS_OF}' - INTERVAL 300 DAY THEN 'full' ELSE 'incremental' END AS next_mode FROM customer LEFT JOIN l ON source_id = c_custkey""")
def mode_promotion(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return sweeps.promote(sources, sweeps.last_full_sweep(_swept(spark, d)), F.lit(AS_OF).cast("timestamp_ntz"), 300).select("source_id", "next_mode")


@registered(f"""WITH {REFS_SQL}, cur AS (SELECT doc_id, content_hash AS h FROM refs SEMI JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN h IS NULL THEN 'new_document' WHEN doc_id % 5 = 0 THEN 'skip'
WHEN doc_id % 7 = 0 THEN 'new_version' ELSE 'identical' END AS decision FROM refs LEFT JOIN cur USING (doc_id)""")
def collection_ladder(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).select("doc_id", "content_hash")
    indexed = found.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    known = indexed.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("sha256:old")).otherwise(F.col("content_hash")).alias("current_hash"))
    fresh = F.when(F.col("doc_id") % 5 == 0, "etag_match").otherwise("changed")
    return sweeps.collection_decision(found, known, fresh, ["doc_id"]).select("doc_id", "decision")


@registered("""SELECT l_orderkey AS run_id, l_linenumber AS attempt, CASE WHEN l_suppkey % 3 = 0 THEN 'NetworkTimeout' ELSE 'SourceUnavailable' END AS error_class, true AS retryable, 'document' AS scope FROM lineitem WHERE l_returnflag = 'R'""")
def error_classification(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("l_suppkey") % 3 == 0, "Request TIMEOUT after 30 s").otherwise("connection refused")
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt"), decisions.network_error(said).alias("error_class"))
    return rows.join(F.broadcast(decisions.error_classes(spark)), "error_class").select("run_id", "attempt", "error_class", "retryable", "scope")


@registered("""SELECT o_orderkey, printf('%s', CASE WHEN o_orderkey < 1024 THEN printf('%d o', o_orderkey) WHEN o_orderkey < 1048576 THEN printf('%.2f Kio', round(o_orderkey / 1024.0::DOUBLE, 2)) ELSE printf('%.2f Mio', round(o_orderkey / 1048576.0::DOUBLE, 2)) END) AS size,
CASE WHEN o_orderkey * 977 < 1000 THEN printf('%d ms', o_orderkey * 977) WHEN o_orderkey * 977 >= 3600000 THEN printf('%d h %02d min', o_orderkey * 977 // 3600000, o_orderkey * 977 // 60000 % 60)
WHEN o_orderkey * 977 >= 60000 THEN printf('%d min %02d s', o_orderkey * 977 // 60000 % 60, o_orderkey * 977 // 1000 % 60) ELSE printf('%d s', o_orderkey * 977 // 1000) END AS duration FROM orders""")
def size_duration_format(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", content.format_bytes(key).alias("size"), content.format_duration(key * 977).alias("duration"))


@registered(f"""WITH {SITE_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS page FROM marked),
flagged AS (SELECT *, CASE WHEN found = 0 THEN 1 ELSE 0 END AS none, CASE WHEN found > 0 AND fresh <= 3 THEN 1 ELSE 0 END AS old FROM numbered),
islands AS (SELECT *, sum(1 - none) OVER (PARTITION BY site ORDER BY page) AS a, sum(1 - old) OVER (PARTITION BY site ORDER BY page) AS b FROM flagged),
streaked AS (SELECT *, sum(none) OVER (PARTITION BY site, a ORDER BY page) AS empties, sum(old) OVER (PARTITION BY site, b ORDER BY page) AS stales FROM islands),
stopped AS (SELECT *, min(CASE WHEN repeated OR empties >= 2 OR stales >= 4 THEN page END) OVER (PARTITION BY site) AS stop, max(page) OVER (PARTITION BY site) AS last FROM streaked)
SELECT site, page, coalesce(stop, last + 1) > 20 AS truncated FROM stopped WHERE (stop IS NULL OR page < stop) AND page < 20""")
def page_enumeration(spark: SparkSession, d: str) -> DataFrame:
    numbered = _site_pages(spark, d).withColumn("page", F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1)
    numbered = numbered.withColumn("fresh", F.greatest(F.col("fresh") - 3, F.lit(0)))
    found = pages.enumeration(numbered, "page", "found", "fresh", "repeated", "site", stale=4, most=20)
    return found.select("site", F.col("page").cast("long").alias("page"), "truncated")


@registered(f"""WITH {RUN_SQL}, held AS (SELECT o_custkey AS source_id, count(DISTINCT l_partkey) AS documents,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS failed_documents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT (SELECT count(*) FROM customer) AS sources, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(failed_documents) AS BIGINT) AS failed_documents,
  (SELECT count(*) FROM runs WHERE status = 'failed' AND started_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS failed_runs_7d FROM held""")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    return views.dashboard_totals(source_health(spark, d))


@registered("""SELECT c_custkey AS source_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'quarantined' ELSE 'active' END AS state,
CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal > 0 THEN c_name ELSE 'non precise' END END AS reason, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END AS at FROM customer""")
def source_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("source_id"), F.when(F.col("c_mktsegment") == "BUILDING", "quarantined").otherwise("active").alias("state"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("reason"), F.col("c_nationkey").alias("at"),
    )
    return ledger.source_state(rows)


@registered(f"""WITH {RUN_SQL} SELECT source_id, {ISO_SQL.format("max(started_at)")} AS last_run_at, {ISO_SQL.format("max(CASE WHEN status = 'completed' THEN started_at END)")} AS last_success_at FROM runs GROUP BY 1""")
def run_marks(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.run_marks(runs(spark, d).withColumn("ended_at", F.col("started_at")))
    return found.select("source_id", identity.iso(F.col("last_run_at")).alias("last_run_at"), identity.iso(F.col("last_success_at")).alias("last_success_at"))


@registered(f"""WITH {REFS_SQL} SELECT content_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM refs
WHERE content_hash NOT IN (SELECT content_hash FROM refs JOIN labels USING (doc_id)) GROUP BY 1""")
def insert_new_objects(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).select("doc_id", "content_hash", "source")
    existing = found.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return ledger.new_objects(found, existing, "content_hash", ["doc_id"]).select("content_hash", "doc_id", "source")


@registered(f"""WITH {REFS_SQL} SELECT content_hash, string_agg(document_id || ':' || source, ',' ORDER BY document_id) AS refs FROM refs GROUP BY 1""")
def descriptor_references(spark: SparkSession, d: str) -> DataFrame:
    rows = refs(spark, d).select("content_hash", "document_id", F.lit(1).alias("version_no"), F.col("source").alias("source_id"), F.col("doc_id").alias("native_id"), F.col("doc_id").alias("fetched_at"))
    joined = F.array_join(F.transform("references", lambda r: F.concat(r["document_id"], F.lit(":"), r["source_id"])), ",")
    return ledger.attach_references(rows).select("content_hash", joined.alias("refs"))


@registered(f"""WITH {REFS_SQL}, bad AS (SELECT DISTINCT content_hash FROM refs JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT content_hash, content_hash IN (SELECT content_hash FROM bad) AS tombstone FROM (SELECT DISTINCT content_hash FROM refs)""")
def purge_objects(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).select("doc_id", "content_hash")
    bad = found.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("content_hash").distinct()
    stay, gone = ledger.purge(found.select("content_hash").distinct(), bad)
    return stay.withColumn("tombstone", F.lit(False)).unionByName(gone.withColumn("tombstone", F.lit(True)))


@registered(f"""SELECT user_id AS content_hash, {ISO_SQL.format("max(ts)")} AS checked_at, arg_max(event_type, (ts, event_type)) AS result FROM events GROUP BY 1""")
def latest_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "events").select(F.col("user_id").alias("content_hash"), F.col("ts").alias("checked_at"), F.col("event_type").alias("result"))
    return ledger.verify_state(checks).select("content_hash", identity.iso(F.col("checked_at")).alias("checked_at"), "result")


@registered(f"""WITH {REFS_SQL}, o AS (SELECT content_hash, count(*) AS ref_count FROM refs GROUP BY 1) SELECT content_hash, ref_count FROM o WHERE content_hash > 'sha256:8' ORDER BY content_hash LIMIT 100""")
def content_batch(spark: SparkSession, d: str) -> DataFrame:
    found = refs(spark, d).groupBy("content_hash").agg(F.count(F.lit(1)).alias("ref_count"))
    return query.content_batch(found, "sha256:8", 100)


@registered("""SELECT l_orderkey, l_linenumber, 400 + l_suppkey % 110 AS status, 400 + l_suppkey % 110 IN (408, 425, 429, 500, 502, 503, 504) AS retryable FROM lineitem""")
def status_routing(spark: SparkSession, d: str) -> DataFrame:
    status = F.lit(400) + F.col("l_suppkey") % 110
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), decisions.retryable_status(status).alias("retryable"))


@registered("""SELECT o_orderkey, array_to_string(list_transform([9, 8, 7, 6, 5, 4, 3, 2, 1, 0], lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((epoch_ms(o_orderdate) >> (5 * i)) % 32 AS INTEGER) + 1, 1)), '') AS ulid_time FROM orders""")
def ulid_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", identity.ulid_time(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ulid_time"))


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.json_path(F.col("props"), "$.k").alias("k"))


@registered("""SELECT doc_id, CASE WHEN n_chars < 300 THEN 300 ELSE 100 END AS min_bytes, CASE WHEN n_chars < 300 THEN 4000 ELSE 5000 END AS max_bytes,
CASE WHEN n_chars < 300 THEN 'text/plain' ELSE 'text/html,text/plain' END AS mime_types FROM documents""")
def expectation_intersection(spark: SparkSession, d: str) -> DataFrame:
    short = F.col("n_chars") < 300
    kinds = F.array(F.lit("text/html"), F.lit("text/plain"))
    source = {"min_bytes": F.lit(100), "max_bytes": F.lit(5000), "mime_types": kinds}
    plan = {"min_bytes": F.when(short, 300).otherwise(50), "max_bytes": F.when(short, 4000).otherwise(9000), "mime_types": F.when(short, F.array(F.lit("text/plain"))).otherwise(kinds)}
    met = content.intersect_expectations(source, plan)
    return table(spark, d, "documents").select("doc_id", met["min_bytes"].alias("min_bytes"), met["max_bytes"].alias("max_bytes"), F.array_join(met["mime_types"], ",").alias("mime_types"))
