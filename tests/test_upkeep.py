"""Expectations, retention and monotone ids against plain Python."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from corpusledger.functions.identity import CROCKFORD
from corpusledger.operators import expectations, retention, ulids

TODAY = date(2024, 3, 31)
FACTS = "source string, day date, size long, failed boolean"
EXPECTED = "source_id string, runs_every_days int, least_found int, most_found int, least_bytes long, most_bytes long"


def facts_of(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def days_of(spark, rows, k=expectations.SKETCH_K):
    return expectations.daily(facts_of(spark, rows), "source", "day", "size", F.col("failed"), k)


def test_medians_of_merged_days_are_exact_up_to_k_and_near_beyond(spark):
    draw = random.Random(3)
    rows = [("few", TODAY - timedelta(i % 30), draw.randrange(10**6), None) for i in range(501)]
    rows += [("many", TODAY - timedelta(i % 30), draw.randrange(10**6), False) for i in range(20_000)]
    got = {r["source_id"]: r["recent_median"] for r in expectations.window_medians(days_of(spark, rows), F.lit(TODAY)).collect()}
    of = {name: sorted(r[2] for r in rows if r[0] == name) for name in ("few", "many")}
    assert got["few"] == of["few"][250]
    rank = sum(x <= got["many"] for x in of["many"]) / 20_000
    assert abs(rank - 0.5) < 0.02


def test_each_expectation_alone(spark):
    def steady(name, size=100, n=10):
        return [(name, TODAY - timedelta(d), size, False) for d in range(60) for _ in range(n)]

    rows = [*steady("good"), *[r for r in steady("silent") if r[1] < TODAY - timedelta(2)]]
    rows += [r for r in steady("sterile") if r[1] < TODAY - timedelta(9)] + [("sterile", TODAY - timedelta(d), None, True) for d in range(10)]
    rows += [*steady("flood"), *[("flood", TODAY, 100, False)] * 100]
    rows += [*steady("failing"), *[("failing", TODAY, None, True)] * 3]
    # Error pages in place of documents: large before, small for the last 30 days.
    rows += [r if r[1] <= TODAY - timedelta(30) else (*r[:2], 10, False) for r in steady("shrunk")]
    rows += [("good", None, 1, True), (None, TODAY, 1, True)]
    names = ["good", "silent", "sterile", "flood", "failing", "shrunk", "never"]
    expected = spark.createDataFrame([(n, 1, 5, 20, 50, 200) for n in names], EXPECTED)
    found = expectations.alerts(expected, days_of(spark, rows), F.lit(TODAY)).collect()
    got = {(r["source_id"], r["alert"]): r["measured"] for r in found}
    assert got == {
        ("silent", "silent"): 3, ("sterile", "sterile"): 10, ("sterile", "volume"): 0, ("sterile", "failures"): 1, ("flood", "volume"): 110,
        ("failing", "failures"): pytest.approx(3 / 13), ("shrunk", "median_size"): 10, ("shrunk", "size_collapse"): 10, ("never", "silent"): -1, ("never", "sterile"): -1,
    }


def test_nothing_expected_and_no_facts(spark):
    expected = spark.createDataFrame([("a", None, None, None, None, None)], EXPECTED)
    assert [(r["alert"], r["measured"]) for r in expectations.alerts(expected, days_of(spark, []), F.lit(TODAY)).collect()] == [("sterile", -1)]
    only_failed = expectations.alerts(expected, days_of(spark, [("a", TODAY, None, True)]), F.lit(TODAY)).collect()
    assert {r["alert"] for r in only_failed} == {"sterile", "failures"}
    assert expectations.alerts(expected.limit(0), days_of(spark, []), F.lit(TODAY)).count() == 0


def test_kept_versions_against_plain_python(spark):
    draw = random.Random(5)
    rows = [(d, n, date(2018 + draw.randrange(6), 1, 1), f"h{draw.randrange(40)}") for d in range(12) for n in range(draw.randrange(1, 25))]
    rows += [(99, 1, None, "x"), (99, 2, None, "y"), (99, 3, None, "z"), (None, 1, TODAY, "n"), (7, None, TODAY, "n")]
    versions = spark.createDataFrame(rows, "document_id long, version_no long, at date, content_hash string")
    for per_year in (True, False):
        by = defaultdict(list)
        for d, n, at, _ in rows:
            if d is not None and n is not None:
                by[d].append((n, at and at.year))
        gone = set()
        for d, held in by.items():
            stay = {min(held)[0], max(n for n, _ in held)}
            for year in {y for _, y in held} if per_year else ():
                stay.add(max(n for n, y in held if y == year))
            gone |= {(d, n) for n, _ in held} - {(d, n) for n in stay}
        got = retention.prunable(versions, per_year=per_year).select("document_id", "version_no").collect()
        assert len(got) == len(gone) and {tuple(r) for r in got} == gone


def test_collectable_recounts_and_waits(spark):
    objects = [("used", date(2020, 1, 1), 0), ("orphan", date(2024, 3, 1), 5), ("young", date(2024, 3, 2), 0), ("unknown", None, 0)]
    frame = spark.createDataFrame(objects, "content_hash string, stored_at date, ref_count int")
    versions = spark.createDataFrame([("used",), (None,)], "content_hash string")
    got = retention.collectable(frame, versions, F.lit(TODAY)).collect()
    assert [(r["content_hash"], r["ref_count"]) for r in got] == [("orphan", 5)]
    assert retention.collectable(frame.limit(0), versions, F.lit(TODAY)).count() == 0


def number(ulid):
    return sum(CROCKFORD.index(c) * 32**i for i, c in enumerate(reversed(ulid)))


def test_ulids_equal_a_sequential_generator(spark):
    draw = random.Random(9)
    # One millisecond holds more than a third of all rows and spans several ranges.
    rows = [(i, 1000 if draw.random() < 0.4 else 1000 + draw.randrange(-40, 40)) for i in range(4000)]
    draw.shuffle(rows)
    frame = spark.createDataFrame([*rows, (9_999_999, None)], "id long, ms long")
    frame = frame.withColumns({"part": F.lit("mine"), "rank": F.lit(7)})
    made = ulids.monotone_ulids(frame, "ms", "id", parts=16).collect()
    assert {(r["part"], r["rank"]) for r in made} == {("mine", 7)}
    got = {r["id"]: r["ulid"] for r in made}
    assert got.pop(9_999_999) is None
    ordered = [got[i] for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert ordered == sorted(set(ordered)) and all(len(u) == 26 for u in ordered)
    before = {}
    for i, ms in sorted(rows, key=lambda r: (r[1], r[0])):
        assert number(got[i][:10]) == ms
        if ms in before:
            assert number(got[i]) == before[ms] + 1
        before[ms] = number(got[i])
    again = {r["id"]: r["ulid"] for r in ulids.monotone_ulids(frame, "ms", "id", parts=3).collect()}
    assert {k: v for k, v in again.items() if v} == got


def test_carry_into_the_high_half(spark):
    top = (1 << ulids.HALF) - 1
    high, low = ulids.plus(F.lit(5).cast("long"), F.lit(top).cast("long"), F.col("id"))
    got = [tuple(r) for r in spark.range(3).select(high, low).collect()]
    assert got == [(5, top), (6, 0), (6, 1)]
    assert math.log2(32) * 8 == ulids.HALF
