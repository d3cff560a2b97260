"""Postings travel as numbers beside each other, and small groups are verified at once."""

import random

import numpy as np

from corpusledger.llm import line_dedup, words


def test_a_task_sends_a_row_a_range_and_loses_no_posting(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for i in range(2000)], "doc_id long, text string")
    reader = line_dedup.Reader()
    lines = [reader.read([r.text.encode()])[3] for r in docs.collect()]
    wanted = sum(len(x) - (4 * len(x) + 4) // 5 + 1 for x in lines)
    posted = line_dedup.postings(line_dedup._texts(docs, "doc_id", "text").coalesce(1), lambda: line_dedup.Reader(), 4096)
    batches = posted.toArrow().to_batches()
    assert sum(b.num_rows for b in batches) <= 1 << 12 < wanted  # a row for each posting before
    kinds, group, sets, place, s1, s2 = (np.concatenate(x) for x in zip(*map(line_dedup._unpacked, batches), strict=True))
    assert len(kinds) == len(group) == len(sets) == len(place) == len(s1) == len(s2) == wanted
    assert (group >> np.uint64(52) == kinds.astype(np.uint64)).all() and len(np.unique(sets)) == 2000
    # Of each set, the postings have the positions from the first on, and one sketch.
    order = np.lexsort((place, sets))
    fresh = np.r_[True, np.diff(sets[order]) != 0]
    position = (place[order] & 0xFFFFFFFF) >> 2
    assert (position[fresh] == 0).all() and (np.diff(position)[~fresh[1:]] == 1).all()
    assert (np.diff(s1[order])[~fresh[1:]] == 0).all() and (np.diff(s2[order])[~fresh[1:]] == 0).all()


def test_packed_rows_are_read_from_any_slice():
    rng = np.random.default_rng(1)
    made = [tuple(rng.integers(0, 2**64 - 1, 9000, np.uint64) for _ in range(5)) for _ in range(3)]
    made = [(a, b, c.view(np.int64), d, e) for a, b, c, d, e in made]
    want = {g: rest for columns in made for g, *rest in zip(*(c.view(np.int64).tolist() for c in columns), strict=True)}
    seen = 0
    for batch in line_dedup._packed(made, ["group", "set", "place", "s1", "s2"]):
        for at in range(0, batch.num_rows, 700):
            _, group, *rest = line_dedup._unpacked(batch.slice(at, 700))
            assert all(want[g] == [*x] for g, *x in zip(group.view(np.int64).tolist(), *(c.tolist() for c in rest), strict=True))
            seen += len(group)
    assert seen == 27_000


def test_small_groups_at_once_against_brute_force(monkeypatch):
    rng = random.Random(4)
    texts, group = [], []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(rng.randrange(4, 30))]
        for _ in range(rng.randrange(1, 9)):
            own = [w if rng.random() > 0.08 else f"x{rng.randrange(9)}" for w in base]
            texts.append(" ".join(own))
            group.append(g)
    texts, group = [*texts, texts[-1]], np.array([*group, group[-1]])
    m = len(texts)
    reader = line_dedup.Reader()
    _, _, line, number = reader.read([t.encode() for t in texts])
    sets, check = (x.view(np.int64) for x in reader.set_hashes(m, line, number))
    doc, place, key = (np.array([rng.randrange(n) for _ in range(m)]) for n in (5, 7, 1 << 40))
    got = line_dedup.small_groups([sets, check, doc, place, key], group, line, number)
    want = []
    for i, t in enumerate(texts):
        a = set(t.split())
        near = [j for j, u in enumerate(texts) if group[j] == group[i] and a != set(u.split()) and 5 * len(a & set(u.split())) >= 4 * len(a | set(u.split()))]
        if near:
            want.append((sets[i], check[i], len(near), *min((doc[j], place[j], key[j]) for j in near)))
    assert len(want) > 50 and sorted(zip(*(c.tolist() for c in got), strict=True)) == sorted(want)
    monkeypatch.setattr(line_dedup, "HOLDS", 10)
    assert line_dedup.small_groups([sets, check, doc, place, key], group, line, number) is None


def test_words_are_hashed_to_their_last_byte():
    """Words of 1 to 65 bytes that differ in one byte, or in zeros at the end, have hashes of their own, wherever they stand."""
    made = {bytes([97]) * n for n in range(1, 66)} | {b"a" * k + b"b" + b"a" * (n - k - 1) for n in range(1, 66) for k in range(n)} | {b"a" + b"\0" * k for k in range(1, 30)}
    made = sorted(made)
    one, two = words.Words([b" ".join(made)], 0).hash, words.Words([b"z\n" + b"\t\n".join(made[::-1])], 0).hash[1:][::-1]
    assert (one == two).all() and len(np.unique(one)) == len(made)
