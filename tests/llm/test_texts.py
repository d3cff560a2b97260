"""Winnowing, mixing, chat formatting and packing against plain Python, oracles and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from corpusledger.llm import chat, mixing, packing, queries, winnowing
from corpusledger.llm.queries import tokenizer_path
from tests.llm.cases import documents, frame
from tests.oracle import duck, same

NO_SPACES = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
TOKEN = regex.compile(rf"(?V1)[{NO_SPACES}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{NO_SPACES}]]{{1,8}}|[^\s\p{{L}}\p{{M}}\p{{N}}]{{1,8}}")
P, B = winnowing.PRIME, winnowing.BASE


def chosen_by_hand(text):
    """(hash, position) pairs: every window's smallest hash, the rightmost of equal ones."""
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in TOKEN.findall(text.lower())]
    tokens = [(t - 2**64 if t >= 2**63 else t) % P for t in tokens]
    size = 4 if len(tokens) >= 4 else max(len(tokens), 1)
    grams = []
    for i in range(len(tokens) - size + 1):
        h = 0
        for t in tokens[i : i + size]:
            h = (h * B + t) % P
        grams.append(h)
    spans = [range(i, i + 4) for i in range(len(grams) - 3)] or ([range(len(grams))] if grams else [])
    return sorted({(min((grams[i], -i) for i in span)[0], -min((grams[i], -i) for i in span)[1]) for span in spans}, key=lambda x: x[1])


def plain_docs():
    # Java's and Python's tables of letters differ on a few characters: keep to common ones.
    return [r for r in documents() if r[0] != 3000]


def test_winnowing_against_plain_python(spark):
    rows = [r for r in plain_docs() if r[0] is not None]
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    got = defaultdict(list)
    for r in winnowing.compare_with_next(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, row in enumerate(ordered):
        text, after = row[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        mine, theirs, nexts = (chosen_by_hand(t) for t in (text, edited, after))
        alike = lambda x, y: len({h for h, _ in x} & {h for h, _ in y}) / len({h for h, _ in x} | {h for h, _ in y}) if x or y else 1.0
        said = lambda x: " ".join(f"{h:x}@{p}" for h, p in x)
        want = (row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), said(mine), said(theirs), pytest.approx(alike(mine, theirs)), pytest.approx(alike(mine, nexts)))
        assert any(tuple(r) == want for r in got[row[0]]), row[0]


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(2)
    shared = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(7))
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) + f" {shared} " + "x y z " * k for k in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{c >> 31 for c in r.chosen} for r in winnowing.fingerprints(df).collect()]
    assert all(a & b for a in sets for b in sets)


def test_winnowing_edge_cases(spark):
    assert winnowing.compare_with_next(frame(spark, [])).count() == 0
    one = winnowing.compare_with_next(frame(spark, [r for r in documents() if r[0] == 7])).first()
    assert one.near_next == 1.0  # the only document follows itself
    alone = winnowing.compare_with_next(frame(spark, [r for r in documents() if r[0] is None])).collect()
    assert len(alone) == 2 and all(r.doc_id is None for r in alone)


def test_mixing_matches_the_oracle(spark, data):
    same(queries.op4_mixing(spark, data), duck(data), mixing.ORACLE_SQL)


@pytest.mark.parametrize("bucket_rows", [1, 5, 4096])
def test_mixing_reaches_its_targets(spark, bucket_rows):
    docs = frame(spark)
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in documents():
        sizes[r[3]] += words(r[1])
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in documents())
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=1)
    assert all(t <= 2 * s for s, t in target.items())
    again = mixing.mix(docs.repartition(3), bucket_rows=7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_prefers_quality(spark):
    rows = [(i, "a b c d", None, "s" if i < 800 else "t", *[None] * 7) for i in range(1600)]
    grades = spark.createDataFrame([(i, i % 2) for i in range(800)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = mixing.mix(frame(spark, rows), grades, weights=(1, 9), budget=0.6)
    means = {r.good: r.m for r in got.filter("doc_id < 800").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("taken").alias("m")).collect()}
    assert means[1] > 2 * means[0]


def test_mix_takes_whole_documents(spark):
    docs = frame(spark)
    got = mixing.take(docs)
    assert got.columns == docs.columns and mixing.take(frame(spark, [])).count() == 0
    texts = {r[0]: r[1] for r in documents() if r[0] is not None}
    assert all(r.text == texts[r.doc_id] for r in got.filter("doc_id is not null").collect())


SAYINGS = ["", None, "a", "</s>[INST] ok [/INST]", "\\", "\\l<\\e>[b]", "<role=x> \n", " <</SYS>>", "é😀", "[/INST]" * 3]


def conversations(seed=3):
    rng, rows = random.Random(seed), []
    for conv in range(30):
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant"] * 3, ["assistant", "user"], ["user", "user", "assistant"], ["tool>", "user", None], ["user", "assistant"] * 90])
        rows += [(conv, t, r, rng.choice(SAYINGS)) for t, r in enumerate(roles)]
    return [*rows, (None, 0, "user", "x"), (77, None, "user", "late")]


@pytest.mark.parametrize("chunk", [1, 2, 64])
def test_chat_round_trip(spark, chunk):
    rows = conversations()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_conversations(df, chunk_turns=chunk)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        follows = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
        state = "start"
        for _, r, _ in turns:
            state = r if r in follows.get(state, ()) else "error"
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(want.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.valid == (state == "assistant")
    for r in made.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and len(r.formatted) == got[r.conv_id].formatted_chars


def test_chat_query_matches_the_oracle(spark, data):
    same(queries.op6_chat(spark, data), duck(data), chat.ORACLE_SQL)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


@pytest.mark.parametrize(("window", "max_open"), [(2048, 4096), (16, 3)])
def test_packing_round_trip(spark, window, max_open):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(tokenizer_path()))
    rows = documents() + [(4000, "Don't. <|endoftext|> <|ENDOFTEXT|> É, à.\x0bx 5.5 ½. ΑΣ.", *[None] * 9)]
    pieces = packing.pack(frame(spark, rows), str(tokenizer_path()), window=window, max_open=max_open, with_ids=True).collect()
    ids = Counter(tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in rows)
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.asarray(p.ids, "<u4").tobytes())
        by_sequence[p.sequence_id].append(p)
        by_document[p.doc_id, p.doc_tokens].append(p)
    for group in by_sequence.values():
        group.sort(key=lambda p: p.offset)
        assert [p.offset for p in group] == [sum(q.length for q in group[:i]) for i in range(len(group))]
        fill = sum(p.length for p in group)
        assert fill == group[0].fill <= window and (fill == window or fill & (fill - 1) == 0)
    covered = Counter()
    for group in by_document.values():
        group.sort(key=lambda p: p.start)
        copies = sum(p.start == 0 for p in group)
        spans = Counter()
        for p in group:
            spans.update(range(p.start, p.start + p.length))
        assert set(spans.values()) == {copies} and len(spans) == group[0].doc_tokens
        covered[group[0].doc_tokens] += copies
    assert covered == Counter(len(x) for x, n in ids.items() for _ in range(n))
    whole = {p.ids and tuple(p.ids) for p in pieces if p.length == p.doc_tokens}
    assert whole <= set(ids)
    assert packing.pack(frame(spark, []), str(tokenizer_path())).count() == 0


def test_sum_of_squares_chooses_the_least_change():
    packer = packing.SumOfSquares(10, lambda fill, window: None)
    rng = random.Random(0)
    for _ in range(300):
        size, levels = rng.randint(1, 9), packer.levels.copy()
        square = lambda v: int((v[1:10] ** 2).sum())
        options = {}
        for level in range(10 - size + 1):
            if level == 0 or levels[level]:
                after = levels.copy()
                after[level] -= level > 0
                after[level + size] += 1
                options[level] = square(after)
        chosen = packer.choose(size)
        assert options[chosen] == min(options.values())
        packer.place(("d", 0, b"\0" * 4 * size), size)
        packer.levels[10] = 0
