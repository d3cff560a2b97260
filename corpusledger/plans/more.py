"""Further registered queries: the content store, rendered index pages, validators and small operators."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusledger.functions import decisions, identity, schema, text
from corpusledger.operators import integrity, pages, policy, query, sweeps
from corpusledger.plans.catalogue import ISO_SQL, REFS_SQL, registered
from corpusledger.runtime import application_dir, materialise, table
from corpusledger.sources import contract, paged, registry, store

STORE_SQL = REFS_SQL + """, held AS (SELECT content_hash, min(doc_id) AS first, any_value(byte_size) AS byte_size, count(*) AS n FROM refs GROUP BY 1)"""


def _store(spark: SparkSession, d: str, damaged: bool = False) -> str:
    """A content store written from the documents into the shared folder. With ``damaged``, some objects lose or change their bytes."""
    root = f"{application_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").filter("text is not null")
    reference = F.struct(
        identity.document_id(F.col("source"), F.col("doc_id")).alias("documentId"), F.col("source").alias("sourceId"), F.col("doc_id").cast("string").alias("nativeId"),
        F.lit(1).alias("versionNo"), F.concat(F.lit("http://localhost/"), F.col("doc_id").cast("string")).alias("fetchedFromUrl"), F.lit("2026-01-01T00:00:00.000Z").alias("fetchedAt"),
    )
    rows = docs.select(F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("declared_mime"), reference.alias("reference"))
    if not damaged:
        materialise(store.store(rows, root), "store-receipt")
        return root
    # The same store, put together file by file: every tenth object (by its hash) is missing, every tenth changed, every tenth cut.
    # Copies write one file, the first of them, so contents need no shuffle.
    digit = F.conv(F.substring("hex", 1, 4), 16, 10).cast("int") % 10
    named = rows.withColumn("hex", F.sha2("content", 256)).withColumn("digit", digit).withColumn("hash", F.concat(F.lit("sha256:"), F.col("hex")))
    body = F.when(F.col("digit") == 1, F.concat(F.lit(b"\x01"), F.substring(F.col("content"), F.lit(2), F.octet_length("content")))).when(F.col("digit") == 2, F.concat("content", F.lit(b"x")))
    files = named.filter("digit != 0").select(identity.shard_path(F.col("hash"), F.lit("none")).alias("path"), F.coalesce(body, F.col("content")).cast("binary").alias("content"), F.lit(False).alias("replace"))
    held = named.groupBy("hash").agg(F.min(F.octet_length("content")).alias("size"), F.sort_array(F.collect_list("reference")).alias("references"))
    note = F.to_json(F.struct(F.col("hash").alias("contentHash"), F.col("size").alias("byteSize"), F.lit("text/plain").alias("mimeType"), "references"))
    notes = held.select(identity.descriptor_path(F.col("hash")).alias("path"), note.cast("binary").alias("content"), F.lit(True).alias("replace"))
    materialise(store.put(files.unionByName(notes), root), "store-files")
    return root


@registered(f"WITH {STORE_SQL} SELECT content_hash, byte_size, CAST(n AS INT) AS refs, TRUE AS bytes_present FROM held")
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    found = store.scan(spark, _store(spark, d))
    return found.select(F.col("contentHash").alias("content_hash"), F.col("byteSize").alias("byte_size"), F.size("references").alias("refs"), "bytes_present")


@registered(f"WITH {REFS_SQL} SELECT content_hash, byte_size, document_id, source AS source_id, CAST(doc_id AS VARCHAR) AS native_id, 1 AS version_no FROM refs WHERE text IS NOT NULL")
def store_references(spark: SparkSession, d: str) -> DataFrame:
    found = store.references(store.descriptors(spark, _store(spark, d)))
    return found.select("content_hash", "byte_size", "document_id", "source_id", "native_id", "version_no")


@registered(f"WITH {REFS_SQL} SELECT content_hash, any_value(text) AS text FROM refs WHERE text IS NOT NULL GROUP BY 1")
def store_objects_read(spark: SparkSession, d: str) -> DataFrame:
    bodies = store.unpacked(store.stored_files(spark, _store(spark, d), content=True, empty=True))
    return bodies.select("content_hash", F.col("content").cast("string").alias("text"))


DIGIT_SQL = "CAST('0x' || substr(content_hash, 8, 4) AS INT) % 10"
RESULT_SQL = f"CASE {DIGIT_SQL} WHEN 0 THEN 'missing_file' WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'size_mismatch' ELSE 'ok' END"


@registered(f"WITH {STORE_SQL} SELECT content_hash, {RESULT_SQL} AS result FROM held")
def store_verify(spark: SparkSession, d: str) -> DataFrame:
    return store.verify_store(spark, _store(spark, d, damaged=True))


@registered(f"""WITH {STORE_SQL}, r AS (SELECT *, {RESULT_SQL} AS result FROM held) SELECT count(*) AS objects, CAST(sum(n) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS versions,
CAST(0 AS BIGINT) AS tombstones, count(*) FILTER (result = 'ok') AS ok, count(*) FILTER (result = 'hash_mismatch') AS hash_mismatch, count(*) FILTER (result = 'size_mismatch') AS size_mismatch,
CAST(0 AS BIGINT) AS unreadable, count(*) FILTER (result = 'missing_file') AS missing_file,
coalesce(string_agg(content_hash, ' ' ORDER BY content_hash) FILTER (result = 'missing_file'), '') AS missing FROM r""")
def store_report(spark: SparkSession, d: str) -> DataFrame:
    return store.scan_report(spark, _store(spark, d, damaged=True)).withColumn("missing", F.array_join("missing", " "))


@registered(f"WITH {REFS_SQL} SELECT document_id, 1 AS current_version, CAST(1 AS BIGINT) AS version_count, 'http://localhost/' || doc_id AS url FROM refs WHERE text IS NOT NULL")
def store_rebuild(spark: SparkSession, d: str) -> DataFrame:
    found = store.references(store.descriptors(spark, _store(spark, d)))
    return integrity.rebuild_documents(found).select("document_id", "current_version", "version_count", "url")


@registered(f"""WITH {STORE_SQL}, q AS (SELECT content_hash, byte_size, first, {RESULT_SQL} AS result FROM held) SELECT content_hash, result FROM q ORDER BY byte_size, content_hash LIMIT 50""")
def verify_batch(spark: SparkSession, d: str) -> DataFrame:
    root = _store(spark, d, damaged=True)
    chosen = query.unverified_first(store.descriptors(spark, root).withColumn("checked", F.lit(None).cast("string")), 50, "checked", "byteSize", "contentHash")
    some = materialise(chosen.select(F.col("contentHash").alias("content_hash")), "verify-batch")
    return store.verify_store(spark, root, some)


def _aside_pages(spark: SparkSession, d: str) -> DataFrame:
    """Index pages rendered from parts, ten entries a page; a semibold element that is no size comes before the one that is."""
    entry = F.concat(
        F.lit("<aside class='doc loi'><a href='/doc/p"), F.col("p_partkey").cast("string"), F.lit("/' class='doc-title t'>"), F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit(" &amp; co</a><b class='semibold'>5 articles</b><b class='semibold'>"),
        F.col("p_size").cast("string"), F.lit(",5 Ko</b> Publié le 0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(".07.2026</aside>"),
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "")
    return table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.concat(F.lit("<main>"), listed, F.lit("</main>")).alias("html"))


@registered("""SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page, 'p' || p_partkey AS native_id, 'http://x/doc/p' || p_partkey || '/' AS url, p_name || ' & co' AS title,
'2026-07-0' || (p_partkey % 9 + 1) AS published_at, CAST(p_size * 1024 + 512 AS BIGINT) AS declared_bytes FROM part""")
def aside_index(spark: SparkSession, d: str) -> DataFrame:
    found = pages.aside_entries(_aside_pages(spark, d), "http://x/")
    return found.select("page", "native_id", "url", "title", "published_at", "declared_bytes")


@registered("""SELECT CAST(floor(s_suppkey / 10) AS BIGINT) AS page, 's' || s_suppkey AS native_id, 'http://x/documents/s' || s_suppkey AS url, s_name AS title, '2026-01-02' AS published_at FROM supplier""")
def article_index(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(
        F.lit('<article class="doc-entry" id=1><h3><i>'), F.col("s_name"), F.lit('</i></h3><a class=l href="/documents/s'), F.col("s_suppkey").cast("string"), F.lit('"><time datetime="2026-01-02"></time></a></article>')
    )
    listed = F.array_join(F.sort_array(F.collect_list(entry)), "\n")
    made = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 10).alias("page")).agg(listed.alias("html")).withColumn("url", F.lit("http://x/list?page=1"))
    return pages.article_entries(made).select("page", "native_id", "url", "title", "published_at")


@registered("SELECT page_id FROM pages WHERE NOT contains(coalesce(html, ''), 'doc-title') AND NOT regexp_matches(coalesce(html, ''), '(?i)1\\s*-\\s*0\\s+sur\\s+0|aucun r[ée]sultat')")
def structure_alarm(spark: SparkSession, d: str) -> DataFrame:
    return pages.structure_changed(table(spark, d, "pages").fillna({"html": ""}), "aside").select("page_id")


@registered("""SELECT e.event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS BIGINT) * 1000 WHEN event_id % 3 = 1 THEN CAST(greatest(0, 86400 - (event_id % 200) * 1000) AS BIGINT) * 1000 END AS wait_ms FROM events e""")
def retry_after(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    now = F.timestamp_add("SECOND", ((key % 200) * 1000).cast("int"), F.lit("2026-08-30 00:00:00").cast("timestamp"))
    value = F.when(key % 3 == 0, (key % 100).cast("string")).when(key % 3 == 1, F.lit("Mon, 31 Aug 2026 00:00:00 GMT")).otherwise("soon")
    return table(spark, d, "events").select("event_id", decisions.retry_after_ms(value, now).alias("wait_ms"))


@registered("""SELECT conv_id, turn, '{"outer":{"api_key":"[redacted]","list":[{"password":"[redacted]","n":' || turn || '}]},"role":"' || role || '"}' AS body FROM conversations""")
def redacted_records(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit('{"outer":{"api_key":"k","list":[{"password":{"a":1},"n":'), F.col("turn").cast("string"), F.lit('}]},"role":"'), F.col("role"), F.lit('"}'))
    return table(spark, d, "conversations").select("conv_id", "turn", text.redact_json(made).alias("body"))


@registered("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 10 END AS major, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 4 THEN 12 END AS minor, c_custkey % 5 IN (0, 1, 4) AND c_custkey % 5 <> 4 AS accepted,
c_custkey % 2 = 0 AS host_ok FROM customer""")
def api_ranges_and_hosts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    version = F.element_at(F.array(*map(F.lit, ("1.0", "^2.3", "v1.0", "1", "^10.12"))), (k + 1).cast("int"))
    host = F.when(F.col("c_custkey") % 2 == 0, F.lit("www.Example-1.org:8080")).otherwise("-bad..host")
    found = decisions.api_range(version)
    return table(spark, d, "customer").select(
        "c_custkey", found["major"].alias("major"), found["minor"].alias("minor"), decisions.accepts_api(version, (1, 0), (2, 9)).alias("accepted"), decisions.valid_host(host).alias("host_ok")
    )


@registered("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(10))) AS checksum FROM documents")
def script_checksum(spark: SparkSession, d: str) -> DataFrame:
    crlf = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", identity.checksum(crlf).alias("checksum"))


@registered(f"WITH {REFS_SQL} SELECT document_id FROM refs WHERE doc_id % 4 = 0 ORDER BY doc_id, document_id LIMIT 50")
def retry_oldest_failed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        identity.document_id(F.col("source"), F.col("doc_id")).alias("document_id"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("stored").alias("status"), F.col("doc_id").alias("last_seen")
    )
    return sweeps.retry_failed(docs).select("document_id")


CRONS = ("*/20 8-9 * * *", "0 0 1 * *", "30 12 * * 0", "never")


@registered(f"""WITH g AS (SELECT CAST(t AS TIMESTAMP) AS tick FROM range(TIMESTAMP '2026-08-25', TIMESTAMP '2026-09-03', INTERVAL 1 MINUTE) r(t))
SELECT c_custkey AS source_id, {ISO_SQL.format("tick")} AS tick FROM customer JOIN g ON CASE c_custkey % 4 WHEN 0 THEN minute(tick) % 20 = 0 AND hour(tick) IN (8, 9)
WHEN 1 THEN minute(tick) = 0 AND hour(tick) = 0 AND day(tick) = 1 WHEN 2 THEN minute(tick) = 30 AND hour(tick) = 12 AND dayofweek(tick) = 0 ELSE FALSE END""")
def scheduler_ticks(spark: SparkSession, d: str) -> DataFrame:
    cron = F.element_at(F.array(*map(F.lit, CRONS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    schedules = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), cron.alias("cron"))
    found = policy.schedule_ticks(schedules, datetime(2026, 8, 25), datetime(2026, 9, 3))
    return found.select("source_id", identity.iso(F.col("tick")).alias("tick"))


DUE_CRONS = ("*/15 6-20 1,15 * 1-5", "30 2 31 * *", "0 0 29 2 *", "59 23 * * 6", "never")


@registered(f"""WITH g AS (SELECT CAST(t AS TIMESTAMP) AS tick FROM range((SELECT date_trunc('minute', min(ts)) FROM events), (SELECT max(ts) + INTERVAL 4 YEAR FROM events), INTERVAL 1 MINUTE) r(t)),
due AS (SELECT 0 AS k, tick FROM g WHERE minute(tick) % 15 = 0 AND hour(tick) BETWEEN 6 AND 20 AND (day(tick) IN (1, 15) OR dayofweek(tick) BETWEEN 1 AND 5)
UNION ALL SELECT 1, tick FROM g WHERE minute(tick) = 30 AND hour(tick) = 2 AND day(tick) = 31
UNION ALL SELECT 2, tick FROM g WHERE minute(tick) = 0 AND hour(tick) = 0 AND day(tick) = 29 AND month(tick) = 2
UNION ALL SELECT 3, tick FROM g WHERE minute(tick) = 59 AND hour(tick) = 23 AND dayofweek(tick) = 6),
e AS (SELECT event_id, event_id % 5 AS k, ts FROM events)
SELECT event_id, {ISO_SQL.format("tick")} AS due_at FROM e ASOF LEFT JOIN due ON e.k = due.k AND e.ts < due.tick""")
def next_due(spark: SparkSession, d: str) -> DataFrame:
    cron = F.element_at(F.array(*map(F.lit, DUE_CRONS)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", identity.iso(policy.next_due_at(cron, F.col("ts"))).alias("due_at"))


@registered("""SELECT event_id FROM events WHERE hour(ts + INTERVAL 1 HOUR) >= 22 OR hour(ts + INTERVAL 1 HOUR) < 6""")
def blackout_in_zone(spark: SparkSession, d: str) -> DataFrame:
    night = [{"days": "*", "from": "22:00", "to": "06:00"}]
    return table(spark, d, "events").filter(policy.in_blackout(F.col("ts"), night, "Africa/Lagos")).select("event_id")


@registered("SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey AS source_id FROM customer")
def sources_in_order(spark: SparkSession, d: str) -> DataFrame:
    found = query.sources_in_order(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")))
    return found.select("place", "source_id")


@registered("SELECT conv_id AS document_id, CAST(turn + 1 AS BIGINT) AS version_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def versions_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("long").alias("version_no"))
    return query.versions_in_order(rows)


@registered("SELECT o_custkey AS source_id, count(*) AS open_documents FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def pending_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    return query.pending(rows, ("O", "P")).groupBy("source_id").agg(F.count(F.lit(1)).alias("open_documents"))


@registered("SELECT coalesce(max(CAST(p_size AS INT)), 0) AS version FROM part WHERE p_partkey % 3 = 0")
def schema_version(spark: SparkSession, d: str) -> DataFrame:
    return registry.schema_version(table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_size").cast("int").alias("version")))


@registered("""WITH o AS (SELECT s_nationkey AS source_id, count(*) AS plugins FROM supplier GROUP BY 1), c AS (SELECT DISTINCT c_nationkey AS source_id FROM customer)
SELECT coalesce(c.source_id, o.source_id) AS source_id, coalesce(plugins, 0) AS plugins,
CASE WHEN coalesce(plugins, 0) > 1 THEN 'conflict' WHEN plugins IS NULL THEN 'missing' WHEN c.source_id IS NULL THEN 'unused' ELSE 'loaded' END AS status FROM c FULL JOIN o ON c.source_id = o.source_id""")
def plugin_match(spark: SparkSession, d: str) -> DataFrame:
    configured = table(spark, d, "customer").select(F.col("c_nationkey").alias("source_id"))
    return contract.match_sources(configured, table(spark, d, "supplier").select(F.col("s_nationkey").alias("source_id")))


@registered("""WITH h AS (SELECT c_custkey, list_sort(list_filter(['a.org', 'b.org', 'c.org'], lambda x: x <> CASE c_custkey % 3 WHEN 0 THEN 'a.org' WHEN 1 THEN 'b.org' ELSE 'c.org' END)) AS asked FROM customer)
SELECT c_custkey, array_to_string(list_filter(asked, lambda x: x IN ('a.org', 'b.org')), ' ') AS hosts, least(30 + c_custkey % 50, 60) AS per_minute, greatest(100, 500, (c_custkey % 4) * 400) AS delay_ms, c_custkey % 2 = 0 AS robots, 2 AS per_host FROM h""")
def capability_grants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    every = F.array(F.lit("a.org"), F.lit("b.org"), F.lit("c.org"))
    asked = F.struct(
        F.array_remove(every, F.element_at(every, (k % 3 + 1).cast("int"))).alias("hosts"), (30 + k % 50).cast("int").alias("per_minute"), ((k % 4) * 400).cast("int").alias("delay_ms"),
        (k % 2 == 0).alias("robots"), F.lit(4).alias("per_host"),
    )
    granted = F.struct(F.array(F.lit("a.org"), F.lit("b.org")).alias("hosts"), F.lit(60).alias("per_minute"), F.lit(500).alias("delay_ms"), F.lit(False).alias("robots"), F.lit(2).alias("per_host"))
    found = policy.intersect_capabilities(asked, granted)
    return table(spark, d, "customer").select("c_custkey", F.array_join(found["hosts"], " ").alias("hosts"), *[found[c].alias(c) for c in ("per_minute", "delay_ms", "robots", "per_host")])


CONFIG = {
    "type": "object", "additionalProperties": False, "required": ["name"],
    "properties": {"name": {"type": "string", "minLength": 1}, "year": {"type": "integer", "minimum": 1990}, "kinds": {"type": "array", "items": {"enum": ["a", "b"]}}},
}


@registered("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'config.name: required' WHEN 2 THEN 'config.kinds[1]: enum; config.year: minimum' WHEN 3 THEN 'config.more: additionalProperties; config.year: type' END AS issues FROM customer""")
def config_issues(spark: SparkSession, d: str) -> DataFrame:
    made = ['{"name":"n","year":2020,"kinds":["a"]}', "{}", '{"name":"n","year":1900,"kinds":["b","c"]}', '{"name":"n","year":2000.5,"more":1}', "{"]
    body = F.element_at(F.array(*map(F.lit, made)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", schema.json_issues(body, CONFIG).alias("issues"))


@registered("""SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'public' WHEN event_type = 'purchase' THEN 'internal' END AS visibility, count(*) AS n FROM events GROUP BY 1""")
def event_catalogue(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "x.run.started").when(F.col("event_type") == "click", "document.stored").when(F.col("event_type") == "purchase", "x.plugin.loaded").otherwise("x.run.other")
    rows = table(spark, d, "events").select("event_type", contract.event_visibility(kind).alias("visibility"))
    return rows.groupBy("event_type", "visibility").agg(F.count(F.lit(1)).alias("n"))


def _source(spark: SparkSession, d: str) -> contract.PagedSource:
    """The rendered index pages as files of the shared folder, read through the paged source."""
    root = f"{application_dir(spark)}/index-{uuid.uuid4().hex}"
    made = _aside_pages(spark, d).select(F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), F.lit(True).alias("replace"))
    materialise(store.put(made, root), "index-files")
    paged.register(spark)
    return contract.PagedSource("x.index", root, base_url="http://x")


@registered("SELECT 'p' || p_partkey AS native_id, CAST(floor(p_partkey / 10) AS INT) AS page, 'http://x/doc/p' || p_partkey || '/' AS url, CAST(p_size * 1024 + 512 AS BIGINT) AS declared_bytes FROM part")
def source_discover(spark: SparkSession, d: str) -> DataFrame:
    return _source(spark, d).discover(spark).select("native_id", "page", "url", "declared_bytes")


@registered("SELECT 'p' || p_partkey AS native_id, 'GET' AS method, 'http://x/doc/p' || p_partkey || '/' AS url, '*/*' AS accept FROM part")
def source_resolve(spark: SparkSession, d: str) -> DataFrame:
    source = _source(spark, d)
    return source.resolve(source.discover(spark)).select("native_id", "method", "url", "accept")


@registered("""SELECT 'p' || p_partkey AS native_id, p_name || ' & co' AS title, '2026-07-0' || (p_partkey % 9 + 1) AS published_at, 'aside.title aside.published_at' AS locators FROM part""")
def source_describe(spark: SparkSession, d: str) -> DataFrame:
    source = _source(spark, d)
    found = source.describe(source.discover(spark))
    common = F.col("metadata.common")
    return found.select("native_id", common["title"].alias("title"), common["published_at"].alias("published_at"), F.array_join("metadata.provenance.locator", " ").alias("locators"))


@registered("SELECT 'ok' AS status, CAST(NULL AS VARCHAR) AS detail")
def source_health_report(spark: SparkSession, d: str) -> DataFrame:
    return _source(spark, d).health(spark)


@registered("SELECT 'describable' AS capability, TRUE AS held UNION ALL SELECT 'paged', TRUE UNION ALL SELECT 'incremental', TRUE UNION ALL SELECT 'health_reporting', TRUE UNION ALL SELECT 'browser_assisted', FALSE")
def source_capabilities(spark: SparkSession, d: str) -> DataFrame:
    found = contract.capabilities(contract.PagedSource("x.index", d))
    return spark.createDataFrame(list(found.items()), "capability string, held boolean")


@registered("""SELECT p_partkey AS version, CASE p_partkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' ELSE 'applied' END AS status FROM part""")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("version"), F.md5(F.col("p_name").cast("binary")).alias("checksum"))
    files = rows.filter("version % 4 != 1").withColumn("checksum", F.when(F.col("version") % 4 == 2, F.concat("checksum", F.lit("x"))).otherwise(F.col("checksum")))
    return registry.pending_scripts(rows.filter("version % 4 != 0"), files)


LINKS = ("../a/./b?x=..", "/r/../s/.", "//h/p", "?q=1", "c/../../d", "http://o/x/../y#z")


@registered("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://e.org/a/b?x=..' WHEN 1 THEN 'http://e.org/s/' WHEN 2 THEN 'http://h/p' WHEN 3 THEN 'http://e.org/one/two?q=1' WHEN 4 THEN 'http://e.org/d' ELSE 'http://o/y#z' END AS url FROM pages""")
def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    href = F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text.absolute_url(href, F.lit("http://e.org/one/two?p=2")).alias("url"))


@registered("""SELECT manifest, CASE manifest WHEN 0 THEN '' WHEN 1 THEN 'id version' ELSE 'capabilities.network.allowedHosts secrets.k' END AS problems FROM range(3) m(manifest)""")
def manifest_report(spark: SparkSession, d: str) -> DataFrame:
    good = {
        "manifestVersion": 1, "id": "x.index", "name": "Index", "version": "1.0.0", "apiVersion": "^1.0", "entry": "index.py", "capabilities": {"network": {"allowedHosts": ["x"]}},
        "configSchema": CONFIG, "integrity": {"maxDocumentBytes": 1 << 20},
    }
    all_ = [good, good | {"id": "", "version": "one"}, good | {"capabilities": {"network": {"allowedHosts": ["-"]}}, "secrets": [{"name": "k", "value": "v"}]}]
    return spark.createDataFrame([(i, " ".join(schema.manifest_problems(m))) for i, m in enumerate(all_)], "manifest long, problems string")
