"""Duplicates of all kinds against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusledger.llm import common, exact_dedup, line_dedup, simhash
from tests.llm.cases import documents, frame

SPACE = re.compile(r"[\x20\x09-\x0D]")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, text or ""))
    out = Counter()
    for content, members in groups.items():
        best = max(members, key=lambda m: (len(m[1]), m[0] is not None, -(m[0] or 0)))
        for doc_id, n in Counter(m[0] for m in members).items():
            for k in range(n):
                out[(doc_id, best[0], len(members), doc_id == best[0] and k == 0, hashlib.sha256(content.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(frame(spark), digest=digest, salts=3)
    assert Counter(tuple(r) for r in got.collect()) == exact_by_hand([r[:2] for r in documents()])


def test_exact_copies_leave_with_their_columns(spark):
    docs = frame(spark)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [SPACE.sub("", r.text or "") for r in got.collect() if r.doc_id is not None]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", r[1] or "") for r in documents()})


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 == exact_dedup.drop_copies(none).count()
    assert simhash.near_duplicates(none).count() == 0 == simhash.drop_near_copies(none).count()
    assert line_dedup.match_lines(none).count() == 0 == line_dedup.drop_lines(none).count()


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps: dict, radius=3):
    """Smallest id reachable for each id."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius):
            a, b = find(i), find(ids[k + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_documents(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame(spark)).collect()}
    fps = {r[0]: fingerprint_by_hand(r[1]) for r in documents() if r[0] is not None}
    want = groups_by_hand(fps)
    assert {k[0]: v for k, v in got.items() if k[0] is not None} == want
    assert all(f == f"{fps[i]:016x}" for i, f in got if i is not None)
    third = fingerprint_by_hand(documents()[3][1])
    assert got[(None, f"{third:016x}")] == want[documents()[3][0]]


@pytest.mark.parametrize(("blocks", "tile"), [(4, 4096), (4, 5), (2, 4096), (1, 7)])
def test_trees_lose_no_link(spark, blocks, tile):
    rng = random.Random(blocks)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0]
    fps = {}
    for i in range(400):
        fp = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 9])):
            fp ^= 1 << rng.randrange(64)
        fps[i] = fp
    distinct = {}
    for i, fp in fps.items():
        distinct.setdefault(fp, i)
    df = spark.createDataFrame([(int(np.uint64(fp).view(np.int64)), i) for fp, i in distinct.items()], "fp long, rep long")
    found = {(r.node): r.component for r in common.components(simhash.links(df, blocks=blocks, depth=4, tile=tile), "t").collect()}
    want = groups_by_hand({i: fp for fp, i in distinct.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_near_copies_leave_one_of_each_group(spark):
    docs = frame(spark)
    got = simhash.drop_near_copies(docs)
    want = groups_by_hand({r[0]: fingerprint_by_hand(r[1]) for r in documents() if r[0] is not None})
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect() if r.doc_id is not None} == set(want.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long"), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_join_groups_with_and_without_hot_groups(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else str(i)) for i in range(50)] + [(99, None)], "i int, k string")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted((i, k, 25 if k == "a" else 1) for i, k in ((i, "a" if i % 2 else str(i)) for i in range(50)))
    for hot in (1, 10, 10**6):
        got = common.join_groups(rows, groups, "k", "n", hot_rows=hot, most_hot=3).collect()
        assert sorted(tuple(r) for r in got if r.k) == want and [r.n for r in got if not r.k] == [None]


def lines_by_hand(rows):
    lines = [(d, k, frozenset(line.encode().split())) for d, text in rows for k, line in enumerate((text or "").split("\n"))]
    place = lambda d, k: (d is None, d or 0, k)
    first, members = {}, Counter(s for _, _, s in lines)
    for d, k, s in lines:
        first[s] = min(first.get(s, (d, k)), (d, k), key=lambda x: place(*x))
    sets = [s for s in first if s]
    linked = defaultdict(list)
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                linked[a].append(b)
                linked[b].append(a)
    out = Counter()
    for d, k, s in lines:
        if not s:
            out[(d, k, 0, None, None, 1, 0, True)] += 1
            continue
        earlier = any(place(*first[o]) < place(*first[s]) for o in linked[s])
        out[(d, k, len(s), *first[s], members[s], len(linked[s]), (d, k) == first[s] and not earlier)] += 1
    return out


def line_cases():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)] + ["the", "of", "and", "a"] * 30
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.choice([1, 4, 5, 12, 40]))) for _ in range(4)), None, None, *[None] * 7) for i in range(40)]
    family = rng.choices(words, k=30)
    for i in range(60):  # one line in many variants
        variant = family[:]
        for _ in range(rng.randint(0, 4)):
            variant[rng.randrange(30)] = rng.choice(words)
        rows.append((100 + i, " ".join(variant) + "\n\n" + rows[i % 20][1], None, None, *[None] * 7))
    return rows + [(None, "the of and a x\n" + " ".join(family), None, None, *[None] * 7), (500, None, None, None, *[None] * 7)]


@pytest.mark.parametrize(("ranked", "tile"), [(200_000, 1024), (10, 6), (0, 1024)])
def test_lines(spark, ranked, tile):
    rows = line_cases()
    got = line_dedup.match_lines(frame(spark, rows), ranked=ranked, tile=tile)
    assert Counter(tuple(r) for r in got.collect()) == lines_by_hand([r[:2] for r in rows])


def test_awkward_lines(spark):
    got = line_dedup.match_lines(frame(spark))
    assert Counter(tuple(r) for r in got.collect()) == lines_by_hand([r[:2] for r in documents()])


def test_lines_leave_the_documents(spark):
    rows = line_cases()
    want = lines_by_hand([r[:2] for r in rows])
    gone = {(k[0], k[1]) for k in want if not k[-1]}
    docs = frame(spark, rows)
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if text is None or r.doc_id is None:
            assert r.text == text
        else:
            assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if (r.doc_id, k) not in gone)
