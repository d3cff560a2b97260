"""Trained operators: gradients, exact inference by enumeration, held-out accuracy, defined cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusledger.llm import html, html_pages, language, toxicity
from tests.llm.cases import documents, frame, prose


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], 4, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data, target = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, grad = net.gradient(data, target)
    for name, value in net.params.items():
        at = (value.shape[0] // 2, int(data[0, 3]) if name.startswith("in_") else value.shape[1] // 2)
        kept, sides = value[at], []
        for step in (1e-2, -1e-2):
            value[at] = kept + step
            sides.append(net.gradient(data, target)[0])
        value[at] = kept
        assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(grad[name][at], rel=0.02, abs=1e-6)


def test_windows_cover_each_byte_once():
    for n in (1, 63, 64, 65, 128, 200):
        text = bytes(range(33, 33 + n % 90)) + b"a" * (n - n % 90)
        rows, skip = language.cut(text[:n])
        counted = b"".join(r.tobytes() for r in rows[:-1]) + rows[-1].tobytes()[skip:]
        assert counted == text[:n]


def test_language_held_out(spark):
    rng = random.Random(5)
    rows = [(5000 + i, prose(rng, lang, 60), lang, None, *[None] * 7) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    got = language.identify(frame(spark, rows + documents())).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (2000, 2001, 2002, 2003):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert len(got) == len(rows) + len(documents())


def test_language_without_labels_and_rows(spark):
    docs = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


def toxic_rows(n=240, seed=6):
    rng, rows, labels = random.Random(seed), [], []
    bad = ["grmblox", "zuffwit", "krazzod"]
    for i in range(n):
        text = prose(rng, "en", 60)
        toxic = i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "en", "ly"]))
            text = " ".join(words)
        rows.append((i, text, None, None, *[None] * 7))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_located(spark):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows + [(900, None, *[None] * 9), (901, "", *[None] * 9)]), marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    right = [got[i].predicted == labels[i][1] for i in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    for i, y in labels:
        r = got[i]
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if y and r.predicted:
            assert any(w in r.worst_sentence for w in ("grmblox", "zuffwit", "krazzod"))
            assert rows[i][1].lower().encode()[r.worst_start : r.worst_end].decode() == r.worst_sentence
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score


def test_noisy_or_of_sentences():
    model = toxicity.Model(np.random.default_rng(0).normal(0, 0.3, toxicity.BUCKETS), -1.0)
    texts = ["one two. three! four\nfive", "", None, "... 12", "Ünë déux"]
    scores, tops, _ = model.score(texts)
    for text, score, top in zip(texts, scores, tops, strict=True):
        parts = [model.score([p])[0][0] for p in toxicity.SENTENCE_END.split((text or "").encode()) if p for p in [p.decode()]] or [model.score([""])[0][0]]
        assert score == pytest.approx(1 - np.prod([1 - p for p in parts]), abs=1e-5)
        assert top == pytest.approx(max(parts), abs=1e-5)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_marginals_equal_enumeration():
    rng, model = np.random.default_rng(1), html.Model()
    model.pairs = rng.normal(0, 1, model.pairs.shape)
    parent, kinds, unary = [-1, 0, 0, 1, 1, 3], [0, 1, 2, 0, 3, 1], rng.normal(0, 1.5, 6)
    total, one, pair = 0.0, np.zeros(6), np.zeros((6, 2, 2))
    for state in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(unary[i] * state[i] for i in range(6)) + sum(model.pairs[kinds[i], state[parent[i]], state[i]] for i in range(1, 6)))
        total += w
        one += w * np.array(state)
        for i in range(1, 6):
            pair[i, state[parent[i]], state[i]] += w
    belief, pairs = model.marginals(parent, kinds, unary)
    assert belief == pytest.approx(one / total) and pairs[1:] == pytest.approx(pair[1:] / total)


@pytest.fixture(scope="module")
def page_model():
    return html.fit()


def test_pages_held_out(page_model):
    right = 0
    for seed in range(50_000, 50_200):
        tree, label = html.labelled(seed)
        right += tree.text(page_model.keep(tree)) == tree.text(label.astype(bool))
    assert right >= 175


def test_corpus_pages(spark, data, page_model):
    """The article of each page, told by its tag: what the pages' generator wrapped around it must go."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r.html)[1]
        want[r.page_id] = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages, page_model).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_page_cases(spark, page_model):
    rows = [
        (1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b>\n three<br>four &eacute;<p>Five<!-- no --> six and more words here.</article><footer>c</footer>", "x"),
        (4, "u", "<article><h1>Cut off", "x"), (5, "u", "</div></p>", "x"), (None, "u", "<p>" * 3000 + "x", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df, page_model).collect()}
    assert got[1].text == got[2].text == got[5].text == "" and got[1].n_chars == 0
    assert got[3].text == "A & B Onetwo three four é Five six and more words here."
    assert html.extract(df.filter("page_id = 99"), page_model).count() == 0


def test_training_pages_are_stable():
    assert html_pages.page(7) == html_pages.page(7)
