"""Trained operators, the pipeline and sparse ids against plain versions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusledger.llm import html, language, toxicity, winnowing
from tests.llm.cases import SCHEMA, documents, frame, prose
from tests.llm.test_models import toxic_rows
from tests.llm.test_near import left_by_hand


def classify_by_hand(net, text):
    """Position by position, unit by unit."""
    body = text.encode("utf-8", "replace")
    width, hid = language.WIDTH, net.hidden
    windows, counted = [], []
    for at in range(0, len(body), width):
        part = body[at : at + width]
        if len(part) == width or len(body) < width:
            windows.append(part.rjust(width, b" "))
        else:
            windows.append(body[-width:])
        counted.append(len(part))
    sig = lambda v: 1 / (1 + math.exp(-v))
    sums = np.zeros(len(net.labels))
    for window, n in zip(windows, counted, strict=True):
        states = {}
        for way in "fb":
            table, rec, h = net.params[f"in_{way}"].astype(float), net.params[f"rec_{way}"].astype(float), [0.0] * hid
            for t in range(width) if way == "f" else range(width - 1, -1, -1):
                g = [sum(rec[r, k] * h[k] for k in range(hid)) for r in range(3 * hid)]
                x = table[:, window[t]]
                new = []
                for k in range(hid):
                    z, r = sig(x[k] + g[k]), sig(x[hid + k] + g[hid + k])
                    c = math.tanh(x[2 * hid + k] + r * g[2 * hid + k])
                    new.append((1 - z) * c + z * h[k])
                h = new
                states[way, t] = h
        for t in range(width - n, width):
            both = np.array(states["f", t] + states["b", t])
            logits = net.params["out"].astype(float) @ both + net.params["bias"][:, 0]
            e = np.exp(logits - logits.max())
            sums += e / e.sum()
    return sums / sums.sum()


def test_language_equals_a_plain_forward_pass():
    net = language.Network(["a", "b", "c"], 4, 3)
    rng = random.Random(1)
    texts = ["x", "ab cd", "y" * 63, "z" * 64, prose(rng, "en", 12)[:65], prose(rng, "fr", 40), "é" * 70, prose(rng, "de", 30)[:128]]
    for text, (label, score) in zip(texts, language.classify(net, texts), strict=True):
        want = classify_by_hand(net, text)
        assert label == net.labels[int(np.argmax(want))] and score == pytest.approx(want.max(), abs=2e-4)


def test_every_labelled_language_is_learnt(spark):
    """More languages than any fixed number of outputs; rare ones too."""
    rows = []
    for k in range(70):
        mark = chr(0x4E00 + 40 * k)
        rows += [(1000 * k + i, mark * (20 + i), f"l{k:02}", None, *[None] * 7) for i in range(3)]
    labels, data, target = language.training_windows(frame(spark, rows), F.lit(True), "doc_id", "text", "lang", 300, 2, 20_000)
    assert len(labels) == 70 and set(target.tolist()) == set(range(70)) and len(data) == len(target)
    few = language.training_windows(frame(spark, rows), F.lit(True), "doc_id", "text", "lang", 300, 1, 140)
    assert len(few[0]) == 70 and len(few[1]) == 140


def test_noisy_or_gradient():
    rng = np.random.default_rng(2)
    compact = rng.integers(0, 6, (9, 4))
    token, sentence = rng.integers(0, 9, 40), np.sort(rng.integers(0, 12, 40))
    document = np.sort(rng.integers(0, 5, 12))
    document[:5], y = np.arange(5), np.array([1.0, 0.0, 1.0, 1.0, 0.0])
    document.sort()
    starts = np.searchsorted(document, np.arange(5))
    w, bias = rng.normal(0.2, 0.3, 6), -2.0
    loss, g = toxicity.noisy_or(w, bias, compact, token, sentence, document, starts, 12, y)
    assert loss > 0
    for k in range(7):
        sides = []
        for step in (1e-5, -1e-5):
            v, b = w.copy(), bias
            if k < 6:
                v[k] += step
            else:
                b += step
            sides.append(toxicity.noisy_or(v, b, compact, token, sentence, document, starts, 12, y)[0])
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[k], rel=1e-3, abs=1e-7)


def test_trained_toxicity_on_awkward_documents(spark):
    rows, labels = toxic_rows()
    rows = [(10_000 + i, t, *rest) for i, t, *rest in rows]
    marks = spark.createDataFrame([(10_000 + i, y) for i, y in labels], "doc_id long, toxic int")
    run = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏" * 4
    more = [row(7001, "fine words here " * 40_000 + "grmblox krazzod zuffwiten"), row(7002, run + "grmblox" + run), row(7003, run + run), row(7004, "a\x00grmblox\x00krazzod b"), row(7005, None)]
    more += [more[0], more[0]]
    found = toxicity.toxicity(frame(spark, rows + documents() + more), marks).collect()
    assert len(found) == len(rows) + len(documents()) + len(more)
    got = {r.doc_id: r for r in found}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert got[7001].predicted == 1 and len({r.score for r in found if r.doc_id == 7001}) == 1
    assert got[7002].score > got[7003].score and got[7005].predicted == 0
    clean = [r for r in found if r.doc_id is None or r.doc_id < 7001 or r.doc_id == 2**62]
    assert len(clean) == len(documents()) and all(r.predicted == 0 for r in clean)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, *[None] * 7)


def test_sparse_and_repeated_ids_lie_in_even_blocks(spark):
    rng = random.Random(4)
    texts = [prose(rng, "en", rng.choice([1, 3, 12])) for _ in range(300)]
    rows = [row(rng.getrandbits(63) * rng.choice([1, -1]), t) for t in texts[:200]] + [row(i, t) for i, t in enumerate(texts[200:])] + [row(7, "same id " + t) for t in texts[:5]]
    docs = frame(spark, rows)
    table = winnowing.cuts(docs.select("doc_id"), 8, 1000)
    sizes = [r["count"] for r in docs.groupBy(winnowing.block_of(F.col("doc_id"), table).alias("b")).count().collect()]
    assert len(sizes) > 25 and max(sizes) <= 40
    flat = sorted(x for part in table for x in part)
    at = {r.doc_id: r.b for r in docs.select("doc_id", winnowing.block_of(F.col("doc_id"), table).alias("b")).collect()}
    assert all(b == sum(x <= d for x in flat) for d, b in at.items())
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    want = sorted((r[0], len(r[1]), r[1][: len(r[1]) - len(r[1]) // 3] + ordered[(i + 1) % len(ordered)][1][: len(r[1]) // 3]) for i, r in enumerate(ordered))
    import hashlib

    got = winnowing.compare_with_next(docs, per_block=8).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted((d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in want)


def test_pipeline_against_plain_stages(spark, data):
    """On awkward documents with null and repeated ids: what each stage keeps, by hand."""
    docs = frame(spark, [*documents(), row(77, documents()[2][1]), row(77, "an own text that nothing else resembles in any way")])
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["exact_dedup"](spark, docs, data)
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    exact = texts(kept)
    space = lambda t: "".join((t or "").split())
    held = {space(r[1]) for r in docs.select("doc_id", "text").collect()}
    assert {space(t) for _, t in exact} == held and len([d for d, _ in exact if d is not None]) == len({space(t) for d, t in exact if d is not None})
    near = texts(stages["near_dedup"](spark, kept, data))
    assert {x for x in near if x[0] is not None} == left_by_hand([x for x in exact if x[0] is not None])
    assert sum(d is None for d, _ in near) == sum(d is None for d, _ in exact)


def test_pipeline_stages_on_empty_tables_and_extra_columns(spark, data):
    none = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, data)
        assert out.count() == 0
        assert name == "packing" or out.columns == none.columns == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p title=5">Hello there</p><p>next</p>', "Hello there next"),
        ("<p data-x=it's>one</p><p>don't two</p>", "one don't two"),
        ("<p title='a > b' id=x>in</p>", "in"),
        ('<p title="never closed>shown</p><p>more</p>', "shown more"),
        ("<p>Formula <math><mi>x</mi> = 1</math> holds</p>", "Formula x = 1 holds"),
        ("<p>a <noscript>b</noscript> c</p>", "a b c"),
    ],
)
def test_quotes_and_formulas(page, want):
    tree = html.Tree(page)
    assert tree.text(np.ones(len(tree.tags), bool)) == want


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</span>" * 100_000, "<svg><g>" * 30_000 + "</x>" * 60_000, "<b>" * 60_000 + "<p>x" * 1000, '<a b="' * 50_000])
def test_deep_pages_are_read_in_linear_time(page):
    began = time.process_time()
    html.Tree(page)
    assert time.process_time() - began < 3
