import math
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest

from corpusledger.operators import policy, query, search


def brute(docs, queries, k):
    texts = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs if i is not None}
    size = {i: sum(c.values()) for i, c in texts.items()}
    mean = sum(size.values()) / len(size)
    out = []
    for name, text in queries:
        scores = Counter()
        for term in set(re.findall("[a-z0-9]+", text.lower())):
            held = sum(term in c for c in texts.values())
            for i, c in texts.items():
                if term in c:
                    idf = math.log(1 + (len(texts) - held + 0.5) / (held + 0.5))
                    scores[i] += idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * size[i] / mean))
        best = sorted(((round(s, 6), -i) for i, s in scores.items()), reverse=True)[:k]
        out += [(name, place, -i, score) for place, (score, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("per_block", [1, 4, 1024])
def test_search_equals_scoring_all(spark, per_block):
    rng = random.Random(per_block)
    words = [f"w{i}" for i in range(60)]
    docs = [(i * 3 - 50, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(900, None), (901, ""), (None, "w1 w2"), (902, "W1, w2; w3! " * 50)]
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for q in range(12)] + [(99, "nothing here"), (98, "")]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"), per_block=per_block)
    found = search.search(index, spark.createDataFrame(queries, "query_id long, text string"), 5)
    assert [tuple(r) for r in found.orderBy("query_id", "place").collect()] == [
        (q, p, d, pytest.approx(s, abs=2e-6)) for q, p, d, s in sorted(brute(docs, queries, 5))
    ]


def test_empty_corpus(spark):
    index = search.build(spark.createDataFrame([], "doc_id long, text string"))
    assert search.search(index, spark.createDataFrame([(1, "a b")], "query_id long, text string")).count() == 0


def test_cron_bits_equal_the_parser(spark):
    rng = random.Random(7)
    made = []
    for low, high in policy.CRON_FIELDS:
        for _ in range(60):
            a, b = sorted(rng.choices(range(low, high + 2), k=2))
            made.append((",".join(rng.choice(["*", f"{a}", f"{a}-{b}", f"*/{rng.randint(0, 7)}", f"{a}/{rng.randint(1, 9)}", f"{a}-{b}/2", "x", "", "1-", "-1"]) for _ in range(rng.randint(1, 2))), low, high))
    for low, high in policy.CRON_FIELDS:
        part = [m for m in made if m[1:] == (low, high)]
        at = policy.CRON_FIELDS.index((low, high))
        found = spark.createDataFrame([(m[0],) for m in part], "f string").select("f", policy.cron_bits(policy.F.col("f"), low, high).alias("bits"))
        for field, bits in found.collect():
            fields = ["*"] * 5
            fields[at] = field if field else "?"
            try:
                wanted = policy.parse_cron(" ".join(fields))[at]
            except ValueError:
                wanted = None
            assert bits == wanted, field


@pytest.mark.parametrize("zone", [None, "Asia/Kathmandu", "Europe/Paris"])
def test_ticks_equal_the_minute_scan(spark, zone):
    first, last = datetime(2026, 3, 28, 22, 7), datetime(2026, 3, 30, 5, 53)
    crons = ["*/7 * * * *", "30 2 * * *", "0 0 1 1 *", "15 1-3 29 * 1", "59 23 * * 6", "bad", "61 * * * *", "* * * *", "5,10 */6 * 3 0", None]
    rows = [(i, c) for i, c in enumerate(crons)]
    made = policy.schedule_ticks(spark.createDataFrame(rows, "source_id long, cron string"), first, last, zone=zone)
    grid = spark.createDataFrame([(first + timedelta(minutes=m),) for m in range(int((last - first).total_seconds() // 60))], "tick timestamp_ntz")
    local = policy.F.convert_timezone(policy.F.lit("UTC"), policy.F.lit(zone), policy.F.col("tick")) if zone else policy.F.col("tick")
    wanted = set()
    for i, c in rows:
        try:
            policy.parse_cron(c or "")
        except ValueError:
            continue
        wanted |= {(i, r[0]) for r in grid.filter(policy.cron_matches(local, c)).collect()}
    assert {tuple(r) for r in made.collect()} == wanted and made.count() == len(wanted)


def test_next_due_equals_the_day_scan(spark):
    rng = random.Random(11)

    def field(low, high):
        a, b = sorted(rng.choices(range(low, high + 1), k=2))
        return rng.choice(["*", "*", str(a), f"{a}-{b}", f"*/{rng.randint(1, 7)}", f"{a},{b}", f"{a}/{rng.randint(1, 9)}"])

    begin = datetime(2019, 12, 30)
    rows = [(" ".join(field(*f) for f in policy.CRON_FIELDS), begin + timedelta(seconds=rng.randrange(9 * 366 * 86_400))) for _ in range(3000)]
    leap = "0 0 29 2 *"
    rows += [(leap, datetime(2020, 2, 28, 23, 59, 59)), (leap, datetime(2020, 2, 29)), (leap, datetime(2096, 3, 1)), ("0 0 30 2 *", begin), ("* * * * *", datetime(2023, 12, 31, 23, 59))]
    rows += [("0 0 31 12 *", datetime(2023, 12, 31, 0, 0)), ("59 23 * * 0", datetime(2024, 2, 29, 23, 59)), ("bad", begin), ("61 * * * *", begin), ("* * * *", begin), ("", begin), (None, begin), ("* * * * *", None)]
    made = spark.createDataFrame(rows, "cron string, at timestamp_ntz").select("cron", "at", policy.next_due_at(policy.F.col("cron"), policy.F.col("at")).alias("due"))
    for cron, at, due in made.collect():
        try:
            wanted = policy.next_due(cron or "", at) if at else None
        except ValueError:
            wanted = None
        assert due == wanted, (cron, at)


def test_twenty_thousand_expressions_are_one_plan(spark):
    rows = spark.range(20_000).selectExpr("id AS source_id", "concat(id % 60, ' ', id % 24, ' ', id % 28 + 1, ' * ', id % 7) AS cron")
    began = time.time()
    made = policy.schedule_ticks(rows, datetime(2026, 8, 25), datetime(2026, 8, 26))
    assert time.time() - began < 5
    made.count()
    assert time.time() - began < 60


def test_all_sources_in_order(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 500)
    found = query.sources_in_order(spark.createDataFrame([(i,) for i in ids], "source_id long").repartition(7)).collect()
    assert sorted((r.place, r.source_id) for r in found) == list(enumerate(sorted(ids), 1))
