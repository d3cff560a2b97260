"""Stages of the pipeline on ids that repeat with different texts, on null ids, empty tables and clashing columns."""

import itertools
import random
from collections import Counter

import pytest

from corpusledger.llm import exact_dedup, mixing
from tests.llm.cases import SCHEMA, documents, frame


def row(doc_id, text, source="s"):
    return (doc_id, text, None, source, *[None] * 7)


def test_no_unique_text_is_lost_in_any_order(spark):
    rows = [row(3, "copy"), row(5, "copy"), row(5, "unique A"), row(5, "unique C")]
    for order in itertools.islice(itertools.permutations(rows), 0, 24, 7):
        got = exact_dedup.drop_copies(spark.createDataFrame(order, SCHEMA))
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, "copy"), (5, "unique A"), (5, "unique C")]


def test_longest_of_the_texts_of_one_id_stays(spark):
    rows = [row(1, "a b"), row(1, "a  b "), row(1, "ab"), row(2, "ab"), row(1, "c")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, "a  b "), (1, "c")]


def test_exact_copies_of_random_repeated_ids(spark):
    rng = random.Random(2)
    rows = [row(rng.randrange(12), rng.choice("abcdefgh") * rng.randint(1, 2)) for _ in range(60)]
    got = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = {}
    for r in rows:
        want[r[1]] = min(want.get(r[1], r[0]), r[0])
    assert Counter(got) == Counter((d, t) for t, d in want.items())


@pytest.mark.parametrize("cut", [True, False])
def test_every_text_of_an_id_is_mixed_by_itself(spark, cut):
    rng = random.Random(6)
    rows = [row(rng.choice([None, 1, 2, 3]), "w " * rng.randint(0, 9), rng.choice(["a", "b", None])) for _ in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.take(docs).collect())
    have = Counter((r[0], r[1], r[3]) for r in rows)
    made = mixing.mix(docs, cut_last=False).collect()
    assert sum(n * len(k[1].split()) for k, n in got.items()) == sum(r.copies * r.size for r in made)
    assert set(got) <= set(have) and all(n <= 2 * have[k] for k, n in got.items())
    if cut:
        taken = mixing.mix(docs).collect()
        for source in ("a", "b", None):
            size = sum(len(r[1].split()) for r in rows if r[3] == source)
            mine = [r for r in taken if r.source_size == size]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1


def test_take_carries_columns_and_empty_tables(spark):
    docs = frame(spark)
    got = mixing.take(docs)
    assert got.columns == docs.columns and got.count() == sum(r.copies for r in mixing.mix(docs, cut_last=False).collect())
    assert mixing.take(frame(spark, [])).count() == 0 == mixing.mix(frame(spark, [])).count()
    assert {r[0] for r in documents()} >= {r.doc_id for r in got.collect()}


def test_near_copies_of_one_id_are_judged_by_fingerprint(spark):
    from corpusledger.llm import simhash

    rows = [row(3, "copy"), row(5, "copy"), row(5, "unique A"), row(5, "unique C")]
    for order in (rows, rows[::-1]):
        got = simhash.drop_near_copies(spark.createDataFrame(order, SCHEMA))
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, "copy"), (5, "unique A"), (5, "unique C")]


def test_a_pair_is_found_only_through_a_boundary_query(spark):
    import numpy as np

    from corpusledger.llm import simhash

    rng = random.Random(9)
    pool = [rng.getrandbits(63) for _ in range(64)]
    forest = simhash.Forest(pool, 2, 3, 3)
    assert forest.rho == 1
    found = 0
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(32, 64))
        both = np.array([a, b], np.uint64)
        met = {"home": False, "query": False}
        for tree in range(2):
            rows, leaves, home = forest.route(both, tree)
            assert len(rows) > 2 and home.sum() == 2 and len(rows) <= 2 * (3**3 + 1) // 2
            own = [{int(x): bool(h) for x, h in zip(leaves[rows == k], home[rows == k], strict=True)} for k in (0, 1)]
            for leaf in set(own[0]) & set(own[1]):
                if own[0][leaf] and own[1][leaf]:
                    met["home"] = True
                elif own[0][leaf] or own[1][leaf]:
                    met["query"] = True
        assert met["home"] or met["query"]
        found += met["query"] and not met["home"]
    assert found > 20
