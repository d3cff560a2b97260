"""Rows that share an id, or have none, with different texts: each is judged by itself."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpusledger.llm import line_dedup, words
from tests.llm.cases import documents, frame


def row(doc_id, text):
    return (doc_id, text, None, "s", *[None] * 7)


def key(text):
    return int(np.uint64(42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))


def lines_by_hand(rows):
    """As the operator says, each line with the hash of its text."""
    lines = [(d, k, key(text), frozenset(line.encode().split())) for d, text in rows for k, line in enumerate((text or "").split("\n"))]
    place = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    members, first = Counter(s for *_, s in lines), {}
    for *at, s in lines:
        first[s] = min(first.get(s, at), at, key=place)
    linked = defaultdict(list)
    sets = [s for s in first if s]
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                linked[a].append(b)
                linked[b].append(a)
    out = Counter()
    for *at, s in lines:
        earlier = any(place(first[o]) < place(first[s]) for o in linked[s])
        known = (len(s), *first[s][:2], members[s], len(linked[s]), at == first[s] and not earlier) if s else (0, None, None, 1, 0, True)
        out[(*at, *known)] += 1
    return out


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("doc_id", [None, 5])
def test_two_texts_of_one_id_keep_their_link(spark, doc_id, order):
    rows = [row(doc_id, "x\ny\na b c d e f g h i j"), row(doc_id, "a b c d e f g h i k"), row(9, "a b c d e f g h i j"), row(doc_id, "z")][::order]
    got = line_dedup.judged_lines(spark.createDataFrame(rows, frame(spark, []).schema))
    assert Counter(tuple(got_) for got_ in got.select("doc_id", "line_no", "key", "n_words", "class_doc_id", "class_line_no", "members", "links", "kept").collect()) == lines_by_hand(
        [r[:2] for r in rows]
    )


def test_random_repeated_ids(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [rng.sample(vocabulary, 12) for _ in range(8)]
    rows = []
    for _ in range(80):
        text = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(12)] = rng.choice(vocabulary)
            text.append(" ".join(line))
        rows.append(row(rng.choice([None, 1, 2, 3]), "\n".join(text)))
    rows += rows[:5]
    want = lines_by_hand([r[:2] for r in rows])
    got = line_dedup.judged_lines(frame(spark, rows), tile=16, verify_tile=8).collect()
    assert Counter((r.doc_id, r.line_no, r.key, r.n_words, r.class_doc_id, r.class_line_no, r.members, r.links, r.kept) for r in got) == want
    gone = {(r.doc_id, r.line_no, r.key) for r in got if not r.kept and r.doc_id is not None}
    left = Counter((d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k, key(t)) not in gone)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.text) for r in line_dedup.drop_lines(frame(spark, rows)).collect()) == left


def test_words_of_many_texts_at_once():
    texts = [None if r[1] is None else r[1].encode() for r in documents()]
    texts += [b"", b"\n", b" \t\x0b\x0c\r\n x", b"q" * 70 + b" " + b"q" * 64 + b"\n" + b"long " * 200_000, b"y" * 600_000, b"no end\n"]
    found = words.Words(texts, 7)
    want = [(d, k, w) for d, t in enumerate(texts) for k, line in enumerate((t or b"").split(b"\n")) for w in line.split()]
    assert [(d, k) for d, k, _ in want] == list(zip(found.document[found.line].tolist(), found.place[found.line].tolist(), strict=True))
    by_word = defaultdict(set)
    for (_, _, w), h in zip(want, found.hash.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({h for s in by_word.values() for h in s}) == len(by_word)
    one = words.Words([b"abc"], 7).hash[0]
    assert one == words.Words([b"  x abc"], 7).hash[1] == words.Words([b"ABC"], 7, lower=True).hash[0] != words.Words([b"abc"], 8).hash[0]


def test_thousands_of_variants_of_a_long_line(spark):
    rng = random.Random(5)
    line = ["w%d" % i for i in range(3000)]
    rows = []
    for i in range(400):
        own = list(line)
        own[rng.randrange(3000)] = f"v{i}"
        rows.append(row(i, " ".join(own)))
    got = line_dedup.match_lines(frame(spark, rows)).collect()
    assert all(r.links == 399 for r in got) and [r.doc_id for r in got if r.kept] == [0]
