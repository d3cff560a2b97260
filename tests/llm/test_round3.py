"""Cases that an earlier review found: meeting hashes, repeated ids in training, long harmless texts, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusledger.llm import exact_dedup, language, mixing, near_dedup, toxicity
from tests.llm.cases import documents, frame, prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("set_bits", [3, 6])
def test_sets_whose_first_hash_meets(spark, set_bits):
    """With so few bits most sets share their hash; the components stay those of brute force."""
    rng, rows = random.Random(5), []
    for i in range(25):
        base = prose(rng, "en", 60)
        rows += [(10 * i, base), (10 * i + 1, base + " end"), (10 * i + 2, prose(rng, "de", 40))]
    made = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, [(*r, *[None] * 9) for r in rows]), set_bits=set_bits).collect()}
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert made == {i: find(i) for i in sets}


@pytest.mark.parametrize("doc_id", [None, 1, 2, 7, 8])
def test_one_id_on_all_rows_of_a_language(spark, doc_id):
    rng = random.Random(1)
    rows = [(doc_id, prose(rng, "de", 30), "de") for _ in range(900)] + [(1000 + i, prose(rng, "en", 30), "en") for i in range(100)] + [(5, "même texte", "fr")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels, data, target = language.training_windows(docs, F.lit(True), "doc_id", "text", "lang", 50, 4, 20_000)
    assert labels == ["de", "en", "fr"]
    counts = np.bincount(target)
    assert (counts > 0).all() and (counts <= 50 * 4).all()


def test_harmless_sentences_do_not_add_up():
    weights = np.zeros(toxicity.BUCKETS + 1)
    model = toxicity.Model(weights, -9.0)
    once, often = (model.score(["A harmless sentence. " * n])[0][0] for n in (1, 20_000))
    assert once == pytest.approx(often) and often < 0.1
    assert toxicity.Model(weights, -3.0).score(["One. Two. Three."])[0][0] == pytest.approx(1 - (1 / (1 + np.exp(-3.0))) ** 3)


CLASHES = "_cl_key string, _cl_id string, _cl_fp string, _cl_gone string, _cl_kept string, _cl_many string, _cl_stays string, _mx_size string, _mx_id string, _mx_key string, _mx_copies string, _key string, c0 string"


def test_columns_with_our_names_keep_their_values(spark):
    rows = [r for r in documents() if r[0] is not None]
    names = [c.split()[0] for c in CLASHES.split(", ")]
    docs = frame(spark, rows).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    quality = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for stage in (near_dedup.drop_near_copies, exact_dedup.drop_copies, lambda d: mixing.take(d, quality)):
        made = stage(docs)
        assert made.columns == docs.columns
        found = made.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
