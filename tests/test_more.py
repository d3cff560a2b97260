"""Content store, sources, validators, journal retention, schedules and rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusledger.functions import decisions, schema, text
from corpusledger.operators import ledger, pages, policy
from corpusledger.sources import contract, journal, paged, registry, store


def incoming(spark, rows):
    reference = "named_struct('documentId', d, 'sourceId', 's', 'nativeId', d, 'versionNo', v, 'fetchedFromUrl', concat('u', d), 'fetchedAt', '2026-01-01T00:00:00.000Z')"
    df = spark.createDataFrame(rows, "d string, v int, content binary")
    return df.select("content", F.lit("text/plain").alias("declared_mime"), F.expr(reference).alias("reference"))


def test_store_writes_once_and_merges_references(spark, tmp_path):
    root, long = str(tmp_path / "store"), b"word " * 2000
    first = store.store(incoming(spark, [("a", 1, b"x"), ("b", 1, b"x"), ("c", 1, long)]), root).collect()
    assert sorted((r.byte_size, r.compression, r.deduplicated) for r in first) == [(1, "none", False), (10_000, "zstd", False)]
    again = store.store(incoming(spark, [("a", 1, b"x"), ("d", 1, b"x"), ("e", 2, b"")]), root).collect()
    assert sorted((r.byte_size, r.deduplicated) for r in again) == [(0, False), (1, True)]
    held = {r.byteSize: sorted((x.documentId, x.versionNo) for x in r.references) for r in store.descriptors(spark, root).collect()}
    assert held == {1: [("a", 1), ("b", 1), ("d", 1)], 10_000: [("c", 1)], 0: [("e", 2)]}
    assert {r.result for r in store.verify_store(spark, root).collect()} == {"ok"}
    assert {bytes(r.content) for r in store.unpacked(store.stored_files(spark, root, True)).collect()} == {b"x", long}  # no file is listed for an empty object
    report = store.scan_report(spark, root).first()
    assert (report.objects, report.documents, report.versions, report.ok, report.missing) == (3, 5, 5, 3, [])
    assert store.store(incoming(spark, [("f", 1, b"too long")]), root, most_bytes=3).first().path is None


def test_files_of_a_first_attempt_are_not_taken_for_older_contents(spark, tmp_path):
    """A job that was lost after the bytes and before the descriptors leaves files; the next one reports their contents as new."""
    root = str(tmp_path / "store")
    rows = incoming(spark, [("a", 1, b"x"), ("b", 1, b"y")])
    store.store(rows, root).collect()
    for note in (tmp_path / "store").rglob("*.json"):
        if b"a" in note.read_bytes().split(b'"documentId":"')[1][:1]:
            note.unlink()
    again = {r.content_hash: r.deduplicated for r in store.store(rows, root).collect()}
    assert sorted(again.values()) == [False, True]
    assert {r.result for r in store.verify_store(spark, root).collect()} == {"ok"}
    assert sorted(r.references[0].documentId for r in store.descriptors(spark, root).collect()) == ["a", "b"]


def test_a_store_reads_the_descriptors_of_what_comes_in_only(spark, tmp_path):
    root = str(tmp_path / "store")
    store.store(incoming(spark, [("a", 1, b"x")]), root).collect()
    (tmp_path / "store/objects/zz").mkdir()
    (tmp_path / "store/objects/zz/broken.json").write_text("{no json")
    assert [r.deduplicated for r in store.store(incoming(spark, [("b", 1, b"y"), ("c", 1, b"x")]), root).orderBy("content_hash").collect()].count(True) == 1


ENTRY = "<aside class='doc loi'><a href='/doc/{0}/' class='doc-title'>T{0}</a><b class='semibold'>Loi</b> <b class='semibold'>5 articles</b><b class='semibold'>430 Ko</b> Publié le 0{1}.07.2026</aside>"


def test_size_is_of_the_element_that_is_one(spark):
    df = spark.createDataFrame([(ENTRY.format(1, 1),), (ENTRY.format(1, 1).replace("430 Ko", "x"),)], "html string")
    assert [r.declared_bytes for r in pages.aside_entries(df.withColumn("page", F.lit(0)), "http://h").collect()] == [440_320, None]


def test_paged_source(spark, tmp_path):
    paged.register(spark)
    for page, days in enumerate([(9, 8), (8, 7), (2, 1)]):
        (tmp_path / f"page-{page}.html").write_text("".join(ENTRY.format(f"{page}-{k}" if page else f"0-{k}", d) for k, d in enumerate(days)))
    source = contract.PagedSource("x.y", str(tmp_path))
    assert isinstance(source, contract.Source)
    assert contract.capabilities(source) == {"describable": True, "paged": True, "incremental": True, "health_reporting": True, "browser_assisted": False}
    refs = source.discover(spark)
    assert refs.count() == 6 and source.discover(spark, most=3).count() == 3
    assert source.discover(spark, "incremental", "2026-07-12").count() == 4
    first, cursor = source.discover_page(spark)
    assert first.count() == 2 and cursor == "page:1" and source.discover_page(spark, "page:2")[1] is None
    plan = source.resolve(refs).filter("native_id = '0-0'").first()
    assert (plan.method, plan.url) == ("GET", "http://localhost/doc/0-0/")
    about = source.describe(refs).filter("native_id = '0-1'").first().metadata
    assert about.raw["title"] == "T0-1" and about.common == {"title": "T0-1", "published_at": "2026-07-08"} and [p.locator for p in about.provenance] == ["aside.title", "aside.published_at"]
    assert source.health(spark).first().status == "ok"
    source.restore(source.checkpoint(2, "2026-07-09"))
    assert source.discover(spark).count() == 2
    (tmp_path / "page-0.html").write_text("<p>redesigned</p>")
    assert source.health(spark).first().status == "degraded"


def test_missing_page_is_an_error(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "page-0.html").write_text("x")
    (tmp_path / "page-2.html").write_text("y")
    with pytest.raises(Exception, match="page-1"):
        spark.read.format("paged_index").option("path", str(tmp_path)).load().collect()


SCHEMA = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^x"}}, "c": {"enum": [1, "1"]}, "d": {"const": True}}}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"a": 2, "b": ["x"], "c": "1", "d": True}, []),
        ({"b": []}, [("config.a", "required"), ("config.b", "minItems")]),
        ({"a": 1.5, "e": 0}, [("config.a", "minimum"), ("config.a", "type"), ("config.e", "additionalProperties")]),
        ({"a": True, "b": ["y", 1]}, [("config.a", "type"), ("config.b[0]", "pattern"), ("config.b[1]", "type")]),
        ({"a": 2.0, "c": True, "d": 1}, [("config.c", "enum"), ("config.d", "const")]),
        ([], [("config", "type")]),
    ],
)
def test_schema_issues(value, want):
    assert sorted(schema.issues(value, SCHEMA)) == want


def test_manifests():
    good = {
        "manifestVersion": 1, "id": "ab.x", "name": "n", "version": "1.2.3-a", "apiVersion": "^1.0", "entry": "index.py", "capabilities": {"network": {"allowedHosts": ["a.org:80"]}},
        "configSchema": {"type": "object", "additionalProperties": False}, "integrity": {"maxDocumentBytes": 5},
    }
    assert schema.manifest_problems(good) == []
    assert schema.manifest_problems(None) == ["manifest"]
    bad = good | {"id": "-", "version": "1", "entry": "../x", "capabilities": {"network": {"allowedHosts": []}}, "secrets": [{"name": "k", "value": "v"}]}
    assert schema.manifest_problems(bad) == ["id", "version", "entry", "capabilities.network.allowedHosts", "secrets.k"]
    assert "configSchema" in schema.manifest_problems(good | {"configSchema": {"type": "object", "additionalProperties": False, "oneOf": []}})
    assert len(schema.manifest_problems({})) >= 8


def test_journal_days_and_retention(spark, tmp_path):
    root = str(tmp_path / "journal")
    rows = [("1", f"e{d}", "t", "s", f"2026-0{m}-0{d}T00:00:00.000Z", None, "{}") for m in (1, 4) for d in (1, 2)]
    journal.write(spark.createDataFrame(rows, journal.EVENT), root)
    assert journal.folders(spark, root) == ["2026-01-01", "2026-01-02", "2026-04-01", "2026-04-02"]
    assert journal.read(spark, root, 1, until="2026-04-01").count() == 1
    assert journal.purge(spark, root, "2026-04-03") == ["2026-01-01", "2026-01-02"] and journal.read(spark, root, None).count() == 2


def test_robots_pieces_are_found_from_left_to_right(spark):
    df = spark.createDataFrame([("/5a5",), ("/5",), ("/x/y.pdf",), ("/x.pdf.pdf",)], "path string")
    refused = lambda rule: [not r[0] for r in df.select(policy.robots_allowed(F.col("path"), policy.parse_robots(f"User-agent: *\nDisallow: {rule}"), "x")).collect()]
    assert refused("/*5$") == [False, True, False, False]
    assert refused("/*.pdf$") == [False, False, True, False]
    assert refused("/x*") == [False, False, True, True]


def test_breaker_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(h, i * 20_000, i in (0, 1, 2, 5, 6), i) for h in ("a", "b") for i in range(12)]
        df = spark.createDataFrame(rows, "host string, at_ms long, failed boolean, id int")
        got = {h: "".join(r.state[0] for r in policy.breaker(df, "host", "at_ms", "failed", "id", 3, 60_000).filter(F.col("host") == h).orderBy("id").collect()) for h in ("a", "b")}
        assert got == {"a": "cccoohoohccc", "b": "cccoohoohccc"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_ones(spark):
    runs = spark.createDataFrame([("r", "running", datetime(2026, 1, 1), None, None)], "run_id string, status string, started_at timestamp, ended_at timestamp, error_summary string")
    done = ledger.fail_stale_runs(runs, F.lit("2026-02-01").cast("timestamp"), F.lit("2026-03-01").cast("timestamp")).first()
    assert (done.status, done.ended_at, done.error_summary) == ("failed", datetime(2026, 3, 1), ledger.STALE_REASON)
    one = spark.range(1)
    assert one.select(text.redact_json(F.lit('{"a":[{"Token":{"x":1}}],"b":"é"}'))).first()[0] == '{"a":[{"Token":"[redacted]"}],"b":"é"}'
    assert one.select(decisions.accepts_api(F.lit("^1.4"), (1, 0), (1, 9))).first()[0] and not one.select(decisions.accepts_api(F.lit("x"), (1, 0), (1, 9))).first()[0]
    assert registry.with_defaults({"a": {"b": 1}, "l": [1]}, {"a": {"b": 0, "c": 2}, "l": [2, 3], "z": 9}) == {"a": {"b": 1, "c": 2}, "l": [1], "z": 9}
    applied, files = spark.createDataFrame([(1, "x"), (2, "y"), (4, "q")], "version int, checksum string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "version int, checksum string")
    assert {r.version: r.status for r in registry.pending_scripts(applied, files).collect()} == {1: "applied", 2: "changed", 3: "pending", 4: "missing"}
    assert policy.week_minutes({"days": "sat", "from": "23:00", "to": "01:00"}) == [(10_020, 10_080), (0, 60)]
    kinds = spark.createDataFrame([("x.run.started",), ("plugin.loaded",), ("run.other",)], "k string")
    assert [r[0] for r in kinds.select(contract.event_visibility(F.col("k"))).collect()] == ["public", "internal", None]
