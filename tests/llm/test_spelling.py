"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpusledger.llm import spelling
from tests.llm.cases import documents, frame


def near(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, every, shortest, least, ratio):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items())


def variants_of(rng: random.Random, word: str) -> str:
    at, letter = rng.randrange(len(word)), rng.choice("abcéÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word + letter])


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(5, 12))) for _ in range(30)]
    family = ["prefixed" + "".join(rng.choices("ab", k=4)) for _ in range(16)] + ["".join(rng.choices("ab", k=4)) + "suffixed" for _ in range(16)]
    words = base + [variants_of(rng, w) for w in base for _ in range(4)] + family + [variants_of(rng, variants_of(rng, w)) for w in base]
    weights = [rng.choice([1, 2, 12, 60, 400]) for _ in words]
    rows = []
    for i in range(200):
        rows.append((i * 3, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=60)) + "."))
    return rows + [(None, "prefixedabab " * 9), (7, None), (8, ""), (9, "123 !!"), (10, "É" * 400 + " " + "é" * 300)] + [(11, "repeated ÉREPEATED")] * 6


@pytest.mark.parametrize("most", [2, 5, 64])
@pytest.mark.parametrize("every", [3, 199])
def test_variants_equal_all_pairs(spark, most, every):
    rows = corpus(4)
    made = spelling.variants(frame(spark, [(*r, *[None] * 9) for r in rows]), every=every, most=most)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = brute(rows, every, 6, 5, 5)
    assert sum(r[1] is not None for r in wanted) > 20 and len(wanted) > 100
    assert sorted(map(tuple, made.collect())) == wanted


def test_short_words_and_chains(spark):
    """With a low ratio, forms make chains; words of one letter have halves of none."""
    rows = [(1, " ".join(["a"] * 2 + ["ab"] * 4 + ["abc"] * 8 + ["abcd"] * 16 + ["abcde"] * 32 + ["bcde"] * 64 + ["b"] * 3 + ["xyz"] * 2))]
    made = spelling.variants(frame(spark, [(*r, *[None] * 9) for r in rows]), every=10**9, shortest=1, least=1, ratio=2, most=2)
    assert sorted(map(tuple, made.collect())) == brute(rows, 10**9, 1, 1, 2)


def test_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in documents()]
    made = spelling.variants(frame(spark), least=2)
    assert sorted(map(tuple, made.collect())) == brute(rows, 199, 6, 2, 5)


def test_empty_table(spark):
    assert spelling.variants(frame(spark, [])).count() == 0


def test_a_task_that_hands_on_early(spark):
    rows = frame(spark, [(*r, *[None] * 9) for r in corpus(2)])
    one, other = (spelling.count_words(rows, "doc_id", "text", 199, 6, 5, held) for held in (3, 10**6))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_one_edit():
    rng = random.Random(0)
    for _ in range(3000):
        u, v = sorted(("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(2)), key=len)
        assert (spelling.one_edit(u, v) is not None) == near(u, v)
