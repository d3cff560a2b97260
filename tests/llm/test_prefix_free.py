"""Repeated passages against a table of all windows."""

import hashlib
import random

import pytest

from corpusledger.llm import prefix_free
from tests.llm.cases import documents, frame, prose


def brute(rows: list[tuple], length: int) -> list[tuple]:
    """Each document, in order of id, against every window before; rows that agree in id and text are one document."""
    out, seen = {}, {}
    named = sorted({(r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows}, key=lambda r: r[:2])
    for at, (lost, doc_id, text) in enumerate(named):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen[window] = at
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[lost, doc_id, text] = (None if lost else doc_id, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return [out[r[0] is None, r[0] or 0, (r[1] or "").encode()] for r in rows]


def key(row):
    return row[0] is None, row[0] or 0, *row[1:]


def check(spark, rows, length, **more):
    made = prefix_free.remove_repeats(frame(spark, [(*r, *[None] * (11 - len(r))) for r in rows]), length=length, **more)
    assert made.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(brute(rows, length), key=key)


def test_awkward_documents(spark):
    rows = [r for r in documents() if r[0] is not None or r[1] is None]
    check(spark, rows, 100)


def passages(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [prose(rng, lang, 60) for lang in ("en", "de", "fr")] + ["ab" * 200, "z" * 400, "a line that everyone writes at the foot of the page, word by word, without thinking, every single day.\n"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, max(0, len(p) - 130))
            parts.append(rng.choice([p, p[a : a + rng.choice([99, 100, 101, 150])], prose(rng, "en", rng.randint(1, 40))]))
        rows.append((rng.randint(-5, 10**6), rng.choice(["", " ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("more", [{}, {"bits": 13}, {"most": 0}, {"gram": 100}, {"gram": 7}])
def test_passages(spark, more):
    check(spark, passages(3), 100, **more)


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabet(spark, seed):
    """Nearly every trigger is shared by different phrases, many of them with ties."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 120)))) for i in range(120)] + [(500, "a" * 300), (501, "b" * 40)]
    check(spark, rows, 12, gram=5)


def test_tasks_that_hand_on_early_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "HELD", 50)
    monkeypatch.setattr(prefix_free, "STEP", 300)
    check(spark, passages(5), 100)


def test_one_id_on_many_rows(spark):
    """Equal ids with different texts are documents that follow each other: together they keep one copy."""
    text = prose(random.Random(1), "en", 80)
    rows = [(7, text + tail) for tail in ("", " one", " two")] + [(7, text)]
    found = prefix_free.remove_repeats(frame(spark, [(*r, *[None] * 9) for r in rows]), texts=True).collect()
    whole = [r for r in found if r.n_removed == 0]
    assert len({bytes(r.kept) for r in whole}) == 1 and len(whole) in (1, 2)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in found)


def test_empty_table(spark):
    assert prefix_free.remove_repeats(frame(spark, [])).count() == 0


def test_triggers_do_not_hang_on_the_surroundings():
    parser, rng = prefix_free.Parser(100, 48), random.Random(2)
    text = rng.randbytes(400)
    within = set()
    for _, start, n, trigger in parser.phrases([text]):
        within |= {(text[i : i + 100], int(t)) for s, k, t in zip(start, n, trigger) for i in range(s, s + k)}
    assert len(within) == 301
    for before, after in ((0, 7), (31, 90), (200, 0)):
        other = rng.randbytes(before) + text + rng.randbytes(after)
        found = set()
        for _, start, n, trigger in parser.phrases([b"x" * 50, other]):
            found |= {(other[i : i + 100], int(t)) for s, k, t in zip(start, n, trigger) for i in range(s, s + k)}
        assert within <= found
