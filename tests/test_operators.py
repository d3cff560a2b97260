"""Folds, sweeps, pages and policies on small literal tables."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusledger.operators import integrity, ledger, pages, policy, query, sweeps, views
from corpusledger.plans import catalogue
from tests.oracle import same

T0 = datetime(2026, 8, 31)


def day(n):
    return T0 + timedelta(days=n)


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


FACTS = [
    ("a", 1, "seen", None), ("a", 2, "stored", "u1"), ("a", 3, "failed", None),
    ("b", 1, "seen", "v"), ("b", 2, "withdrawn", None), ("b", 3, "seen", None),
    ("c", 1, "seen", None), ("c", 2, "withdrawn", None), ("c", 3, "failed", None),
    ("d", 1, "seen", None), ("d", 2, "failed", None), ("e", 1, "withdrawn", None),
]
STATES = {"a": ("stored", None), "b": ("stored", None), "c": ("failed", 2), "d": ("failed", None), "e": ("withdrawn", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_document_fold_in_any_row_order(spark, seed):
    rows = FACTS[:]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, at int, kind string, url string")
    got = {r["id"]: (r["status"], r["withdrawn_at"]) for r in ledger.fold_documents(df, ["id"], "at", "kind", "url", ["at"]).collect()}
    assert got == STATES


def test_versions_only_when_content_changes(spark):
    df = spark.createDataFrame([("d", i, h) for i, h in enumerate("aabbba")], "doc string, at int, h string")
    assert [r[2:] for r in values(ledger.number_versions(df, "doc", ["at"], "h"), "at")] == [("a", 1, None), ("b", 2, 1), ("a", 3, 2)]


def test_commit_is_idempotent_and_conflicts_show(spark):
    df = spark.createDataFrame([("d", 1, "x", 1), ("d", 1, "y", 2), ("d", 2, "z", 3)], "document_id string, version_no int, content_hash string, fetched_at int")
    once = ledger.commit_versions(df)
    assert values(ledger.commit_versions(once.unionByName(once)), "version_no") == values(once, "version_no") == [("d", 1, "x", 1), ("d", 2, "z", 3)]
    assert values(ledger.version_conflicts(df), "version_no") == [("d", 1, 2)]


def test_contents_references_and_purge(spark):
    refs = spark.createDataFrame([("h", 3, "s1", 1), ("h", 3, "s2", 2), ("k", 5, "s1", 3)], "content_hash string, byte_size int, source string, at int")
    objects = ledger.content_objects(refs, "content_hash", "byte_size", ["at"])
    assert values(objects, "content_hash") == [("h", 3, "s1", 1, 2), ("k", 5, "s1", 3, 1)]
    fresh = ledger.new_objects(refs, refs.filter("content_hash = 'k'"), "content_hash", ["at"])
    assert values(fresh, "content_hash") == [("h", 3, "s1", 1)]
    stay, gone = ledger.purge(objects, spark.createDataFrame([("h", "law")], "content_hash string, reason string"))
    assert [r[0] for r in values(stay, "content_hash")] == ["k"] and [r[-1] for r in values(gone, "content_hash")] == ["law"]
    assert values(ledger.recount(objects.select("content_hash"), refs.filter("content_hash = 'h'")), "content_hash") == [("h", 2), ("k", 0)]


def test_registration_keeps_first_seen(spark):
    df = spark.createDataFrame([("s", 1, "a"), ("s", 3, "b"), ("s", 2, "c")], "id string, at int, config string")
    assert values(ledger.upsert_sources(df, "id", "at", ["config"]), "id") == [("s", "b", 1, 3)]


def test_states_runs_and_references(spark):
    df = spark.createDataFrame([("a", "quarantined", None, 1), ("b", "active", "old", 2)], "id string, state string, reason string, at int")
    assert values(ledger.source_state(df), "id") == [("a", "quarantined", "non precise", 1), ("b", "active", None, None)]
    runs = spark.createDataFrame([("s", "completed", 1, 2), ("s", "failed", 3, 4)], "source_id string, status string, started_at int, ended_at int")
    assert values(ledger.run_marks(runs), "source_id") == [("s", 3, 2)]
    refs = spark.createDataFrame([("h", "d", 1, 9), ("h", "d", 1, 5), ("h", "a", 2, 7)], "content_hash string, document_id string, version_no int, fetched_at int")
    body = ledger.attach_references(refs).first()["references"]
    assert [tuple(x) for x in body] == [("a", 2, 7), ("d", 1, 5)]


RUNS = "run_id int, source_id string, mode string, status string, started_at timestamp, ended_at timestamp, error_summary string"


def test_truncated_sweeps_do_not_count(spark):
    runs = spark.createDataFrame([(1, "s", "full", "completed", day(1), day(1), None), (2, "s", "full", "completed", day(2), day(2), "budget"), (3, "s", "incremental", "completed", day(3), day(3), None)], RUNS)
    assert values(sweeps.last_full_sweep(runs), "source_id") == [("s", day(1))]


def test_three_complete_sweeps_withdraw(spark):
    runs = spark.createDataFrame([(i, "s", "full", "completed", day(i), day(i), None) for i in (1, 2, 3)], RUNS)
    docs = spark.createDataFrame([("d0", "s", day(0)), ("d1", "s", day(1))], "document_id string, source_id string, last_seen timestamp")
    got = sweeps.withdraw_unseen(docs, runs.filter(sweeps.is_full_sweep()))
    assert [r["document_id"] for r in got.collect()] == ["d0"]


def test_streaks_ratio_promotion_and_silence(spark):
    runs = spark.createDataFrame([(i, "s", n) for i, n in enumerate([5, 0, 0])] + [(9, "t", 0)], "run_id int, source_id string, found int")
    assert values(sweeps.empty_streak(runs, "found", ["run_id"]), "source_id") == [("s", 2), ("t", 1)]
    outcomes = spark.createDataFrame([(i, i % 4 != 0) for i in range(101)], "i int, bad boolean")
    got = sweeps.failure_ratio(outcomes, None, ["i"], F.col("bad")).filter("alarm").collect()
    assert [r["i"] for r in got] == [99, 100]
    sources = spark.createDataFrame([("s",), ("t",)], "source_id string")
    swept = spark.createDataFrame([("s", day(0))], "source_id string, ended_at timestamp")
    assert [r[-1] for r in values(sweeps.promote(sources, swept, F.lit(day(29))), "source_id")] == ["incremental", "full"]
    done = spark.createDataFrame([("s", "completed", day(0))], "source_id string, status string, started_at timestamp")
    assert [r[0] for r in values(sweeps.silent_sources(sources, done, F.lit(day(1)), 48), "source_id")] == ["t"]


def test_quarantine_reasons(spark):
    errors = spark.createDataFrame([("a", "source"), ("b", "document")], "source_id string, scope string")
    ratios = spark.createDataFrame([("c", True)], "source_id string, alarm boolean")
    streaks = spark.createDataFrame([("d", 3), ("e", 3), ("f", 2)], "source_id string, streak int")
    docs = spark.createDataFrame([("d",), ("f",)], "source_id string")
    assert values(sweeps.quarantine(errors, ratios, streaks, docs), "source_id") == [("a", "error"), ("c", "failure_ratio"), ("d", "empty_sweeps")]


def test_verify_compares_size_first(spark):
    df = spark.createDataFrame(
        [(True, False, False, 0, "x"), (False, False, True, 1, "h"), (False, True, False, 1, "h"), (False, True, True, 2, "x"), (False, True, True, 1, "x"), (False, True, True, 1, "h")],
        "tomb boolean, present boolean, readable boolean, size int, digest string",
    )
    got = [r[0] for r in df.select(integrity.verify(F.col("tomb"), F.col("present"), F.col("readable"), F.col("size"), F.lit(1), F.col("digest"), F.lit("h"))).collect()]
    assert got == ["ok", "missing_file", "unreadable", "size_mismatch", "hash_mismatch", "ok"]
    counts = integrity.result_counts(spark.createDataFrame([(x,) for x in got], "result string")).first().asDict()
    assert counts == {"ok": 2, "hash_mismatch": 1, "size_mismatch": 1, "unreadable": 1, "missing_file": 1}


def test_current_documents_and_growth(spark):
    docs = spark.createDataFrame([("d", 2)], "document_id string, current_version int")
    versions = spark.createDataFrame([("d", 1, "h", day(0)), ("d", 2, "k", day(0)), ("e", 1, "k", day(1))], "document_id string, version_no int, content_hash string, fetched_at timestamp")
    contents = spark.createDataFrame([("h", 3), ("k", 5)], "content_hash string, byte_size int")
    assert views.current_documents(docs, versions, contents).first()["content_hash"] == "k"
    assert values(views.daily_growth(versions, contents), "day") == [("2026-08-31", 2, 8), ("2026-09-01", 1, 5)]


def test_pages_of_documents(spark):
    df = spark.createDataFrame([(f"{i:03}", "s", day(i)) for i in range(25)], "document_id string, source_id string, fetched_at timestamp")
    seen, cursor = [], None
    while True:
        rows, cursor = query.DocumentQuery(limit=10, cursor=cursor).page(df)
        seen += [r["document_id"] for r in rows]
        if cursor is None:
            break
    assert seen == [f"{i:03}" for i in range(25)]
    assert [r[0] for r in query.DocumentQuery(changed_since=day(23)).page(df)[0]] == ["024"]
    assert query.DocumentQuery(limit=0).size == 1 and query.DocumentQuery(limit=5000).size == 1000


def test_event_patterns(spark):
    df = spark.createDataFrame([("corpus.document.stored",), ("corpus.run.started",)], "type string")
    count = lambda p: df.filter(query.type_matches(F.col("type"), p)).count()
    assert [count(p) for p in ("*", "corpus.document.*", "corpus.run.started", "corpus")] == [2, 1, 1, 0]


ASIDE = (
    "<html><aside class='doc x'><a href='/doc/loi-2026-14/' class='doc-title'>Loi N° 2026-14 du 14 juil. 2026 &amp; co</a><b class='num a'>2026-14</b><b class='cat b'>loi</b>"
    "<p>Publié le 27.07.2026</p><b class='semibold'>430 Ko</b><p class='x doc-desc y'>Un <i>texte</i></p></aside></html>"
)
ARTICLE = '<article class="doc-entry" id=1><a class=x href="/documents/2024-118">v</a><h3> Acte <b>un</b></h3><time datetime="2024-05-01"></time></article><a rel="next">'


def test_page_parsers(spark):
    df = spark.createDataFrame([(0, "http://h/documents?page=0", ASIDE), (1, "http://h/documents?page=1", ARTICLE), (2, "u", "no-results"), (3, "u", "aucun résultat")], "page int, url string, html string")
    a = pages.aside_entries(df, "https://x/").first().asDict()
    assert a == {"page": 0, "pos": 0, "native_id": "loi-2026-14", "url": "https://x/doc/loi-2026-14/", "title": "Loi N° 2026-14 du 14 juil. 2026 & co", "published_at": "2026-07-27", "declared_bytes": 440320, "number": "2026-14", "label": "loi", "description": "Un texte"}
    b = pages.article_entries(df).first().asDict()
    assert b == {"page": 1, "pos": 0, "native_id": "2024-118", "url": "http://h/documents/2024-118", "title": "Acte un", "published_at": "2024-05-01"}
    assert [r.page for r in pages.structure_changed(df, "article").collect()] == [0, 3]
    assert [r.page for r in pages.structure_changed(df, "aside").collect()] == [1, 2]


def test_enumeration_stops(spark):
    schema = "page int, found int, fresh int, repeated boolean"
    kept = lambda rows, **k: sorted(r.page for r in pages.enumeration(spark.createDataFrame(rows, schema), "page", "found", "fresh", "repeated", **k).collect())
    assert kept([(0, 3, 3, False), (1, 0, 0, False), (2, 3, 1, False), (3, 0, 0, False), (4, 0, 0, False), (5, 9, 9, False)]) == [0, 1, 2, 3]
    assert kept([(0, 3, 3, False), (1, 3, 0, True), (2, 3, 3, False)]) == [0]
    assert kept([(i, 2, 0, False) for i in range(5)], stale=3) == [0, 1]
    capped = pages.enumeration(spark.createDataFrame([(i, 2, 2, False) for i in range(5)], schema), "page", "found", "fresh", "repeated", most=3)
    assert [(r.page, r.truncated) for r in capped.orderBy("page").collect()] == [(0, True), (1, True), (2, True)]


ROBOTS = "User-agent: *\nDisallow: /docs/\nAllow: /docs/public/\n"


def test_robots(spark):
    df = spark.createDataFrame([("/docs/prive.pdf",), ("/docs/public/acte.pdf",), ("/autre.pdf",)], "path string")
    allowed = lambda text, agent="x": [r[0] for r in df.select(policy.robots_allowed(F.col("path"), policy.parse_robots(text), agent)).collect()]
    assert allowed(ROBOTS) == [False, True, True]
    assert allowed("User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:", "a bot") == [False] * 3
    assert allowed("User-agent: *\nDisallow:") == [True] * 3 == allowed("")
    assert allowed("User-agent: *\nDisallow: /*.pdf$\nAllow: /autre.pdf") == [False, False, True]


def test_robots_piece_before_the_end_is_sought_at_the_end(spark):
    df = spark.createDataFrame([("/fr/8515",), ("/fr/85",), ("/fr/8",), ("/fr/85x",), ("/fr/8x5y55",)], "path string")
    matches = lambda pattern: [r[0] for r in df.select(F.col("path").rlike(policy.path_pattern(pattern, to_end=True))).collect()]
    assert matches("/fr/8*5$") == [True, True, False, False, True]
    assert matches("/fr/8*5*5$") == [True, False, False, False, True]
    assert matches("/fr/8*$") == [True] * 5 and matches("/fr/8$") == [False, False, True, False, False]


def test_robots_decision_matches_its_sql_where_the_last_piece_repeats(spark, tmp_path):
    paths = ["/fr/8515#top", "/fr/85", "/fr/8", "/fr/82455", "/en/65", "/fr/8515?ref=5"]
    spark.createDataFrame([(i, f"http://e.org{x}") for i, x in enumerate(paths)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(catalogue.robots_decision(spark, str(tmp_path)), db, catalogue.ORACLES["robots_decision"])


def at(days, hour, minute=0):
    return T0 + timedelta(days=days, hours=hour, minutes=minute)  # T0 is a Monday


@pytest.mark.parametrize(
    ("window", "inside", "outside"),
    [
        ({"days": "mon-fri", "from": "08:00", "to": "18:00"}, [at(0, 10), at(4, 17, 59)], [at(0, 18), at(5, 10)]),
        ({"days": "*", "from": "22:00", "to": "06:00"}, [at(0, 23), at(1, 2)], [at(1, 7)]),
        ({"days": "fri-mon", "from": "00:00", "to": "23:59"}, [at(4, 5), at(6, 5)], [at(2, 5)]),
        ({"days": "*", "from": "8h", "to": "9h"}, [], [at(0, 8)]),
    ],
)
def test_blackout(spark, window, inside, outside):
    df = spark.createDataFrame([(t,) for t in inside + outside], "t timestamp")
    got = [r[0] for r in df.select(policy.in_blackout(F.col("t"), [window])).collect()]
    assert got == [True] * len(inside) + [False] * len(outside)
    assert bool(policy.unreadable_windows([window])) == ("h" in window["from"])


def test_cron(spark):
    due = lambda e, t: spark.createDataFrame([(t,)], "t timestamp").select(policy.cron_matches(F.col("t"), e)).first()[0]
    assert due("*/15 6-20 1,15 * 1-5", at(0, 6, 15)) and not due("*/15 6-20 1,15 * *", at(0, 6, 15))
    assert policy.next_due("0 3 * * 0", T0) == datetime(2026, 9, 6, 3)
    assert policy.next_due("0 0 30 2 *", T0) is None
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            policy.parse_cron(bad)


def test_slowdown_follows_the_recurrence(spark):
    xs = [100, 110, 90, 100, 105, 400, 500, 600]
    df = spark.createDataFrame([("h", i, float(x)) for i, x in enumerate(xs)], "host string, i int, ms double")
    fast = base = float(xs[0])
    for x in xs[1:]:
        fast = 0.3 * x + 0.7 * fast
        alpha = 0.3 if x < base else 0.01
        base = alpha * x + (1 - alpha) * base
    got = policy.slowdown(df, "host", ["i"], "ms").first()
    assert got["fast"] == pytest.approx(fast) and got["baseline"] == pytest.approx(base) and got["factor"] == pytest.approx(min(fast / base, 8))


def test_breaker_against_a_loop(spark):
    rows = [("h", i * 20_000, i in (0, 1, 2, 5, 6), i) for i in range(12)]
    df = spark.createDataFrame(rows, "host string, at_ms long, failed boolean, id int")
    got = [(r.state, r.allowed) for r in policy.breaker(df, "host", "at_ms", "failed", "id", 3, 60_000).orderBy("id").collect()]
    closed, opened = ("closed", True), ("open", False)
    assert got == [closed, closed, closed, opened, opened, ("half-open", True), opened, opened, ("half-open", True), closed, closed, closed]


def test_quota_budget_and_capabilities(spark):
    df = spark.createDataFrame([("h", i, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 30, 59, 61])], "host string, i int, t timestamp")
    got = [(r.in_minute, r.over_quota, r.wait_ms) for r in policy.request_pressure(df, "host", "t", "i", 2, 40_000).orderBy("i").collect()]
    assert got == [(1, False, 0), (2, False, 10_000), (3, True, 11_000), (3, True, 38_000)]
    steps = spark.createDataFrame([("r", i, 10) for i in range(9)], "run string, i int, size int")
    assert policy.within_budget(steps, "run", ["i"], "size", requests=5).count() == 5
    assert policy.within_budget(steps, "run", ["i"], "size", most_bytes=35).count() == 3
    got = policy.intersect_capability({"hosts": ["a", "b"], "delay_ms": 5, "robots": False}, {"hosts": ["b"], "per_minute": 20, "per_host": 99})
    assert got == {"hosts": ["b"], "per_minute": 20, "delay_ms": 1000, "robots": True, "per_host": 2}
