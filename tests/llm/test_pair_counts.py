"""How many pairs the joins compare and hold, beside what they find."""

import inspect

import numpy as np

from corpusledger.llm import line_dedup, near_dedup, simhash
from corpusledger.llm.common import components


def test_a_tree_gets_a_row_a_fingerprint_and_compares_few_pairs():
    rng = np.random.default_rng(5)
    fps, blocks = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 50_000, dtype=np.uint64), inspect.signature(simhash.near_duplicates).parameters["blocks"].default
    depth = getattr(simhash, "FULL_DEPTH", 2)  # two levels were used for so many
    forest = simhash.Forest(fps[:1024].view(np.int64).tolist(), blocks, 3, depth)
    pairs = 0
    for tree in range(blocks):
        rows, leaves, home = forest.route(fps, tree)
        assert len(rows) == len(fps) and home.all()
        pairs += (np.unique(leaves, return_counts=True)[1].astype(np.int64) ** 2).sum() // 2
    assert pairs < len(fps) ** 2 / 2 / 1000


def test_candidates_of_one_group_are_a_forest(spark):
    """A thousand lines that all match: each is linked, and no task holds or sends all their pairs."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} own{i}") for i in range(1000)], "doc_id long, text string")
    rows = line_dedup._texts(docs, "doc_id", "text").coalesce(1)
    reader = lambda: line_dedup.Reader()
    made = line_dedup.candidates(line_dedup.postings(rows, reader, 4096))
    found = components(made, "forest")
    assert found.count() == 1000 and found.select("component").distinct().count() == 1


def test_the_trees_of_the_near_stage_find_candidates(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "nothing of the kind"), (4, "none at all of it here")]
    docs = spark.createDataFrame([(d, t.encode()) for d, t in rows], "doc_id long, text binary")
    seen = near_dedup.survey(docs, 0).filter("kind = -1").toDF("kind", "doc_id", "set", "check", "key", "n", "fp", "counts")
    fps = {r.doc_id: r.fp for r in seen.collect()}
    assert {d: f & (1 << 64) - 1 for d, f in fps.items()} == {d: simhash.simhash(t.encode()) for d, t in rows}
    near = {frozenset((a, b)) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3}
    by_set = {r.set: r.doc_id for r in seen.collect()}
    got = {frozenset((by_set[r.u], by_set[r.v])) for r in near_dedup.similar(seen).collect()}
    assert got == near == {frozenset((1, 2))}


def test_a_posting_is_sorted_by_one_number(spark):
    """Spark sorts a single number by its digits; the shuffled rows carry five numbers, and lone classes stay out of the last join."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h i{i} j") for i in range(9)], "doc_id long, text string")
    posted = line_dedup.postings(line_dedup._texts(docs, "doc_id", "text"), lambda: line_dedup.Reader(), 4096)
    assert posted.columns == ["group", "set", "place", "s1", "s2"]
    plan = line_dedup.candidates(posted)._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in plan.splitlines() if "Sort [" in x]
    assert len(sorts) == 1 and sorts[0].count(" ASC ") == 1


def test_rows_of_a_group_stand_by_length_however_large_the_numbers():
    rng = np.random.default_rng(3)
    for most, groups in ((60_000, 50), (1 << 20, 50), (60_000, 1 << 25)):
        group = np.sort(rng.integers(0, groups, 2000))
        n, sets = rng.integers(4, most, 2000), rng.integers(-(2**63), 2**63 - 1, 2000)
        order = line_dedup._in_groups(group, n << 32 | 5, sets)
        both = list(zip(group[order].tolist(), n[order].tolist(), strict=True))
        assert both == sorted(both) and sorted(order.tolist()) == list(range(2000))
