"""Toxicity reads words to their end."""

import numpy as np
import pytest

from corpusledger.llm import toxicity


@pytest.mark.parametrize("length", [24, 25, 46, 47, 200, 5001])
def test_pieces_have_every_inner_gram_once(length):
    word = bytes(np.random.default_rng(length).integers(0x80, 0x100, length, np.uint8))
    ids = toxicity.features(toxicity.pieces(word))
    got = ids[:, 6:][ids[:, 6:] >= 0]
    grams = [word[i : i + 4] for i in range(length - 3)]
    assert sorted(got.tolist()) == sorted(toxicity.features(grams)[:, 6].tolist())
    first = toxicity.features([word[:6]])[0, :4]
    assert ids[0, :4].tolist() == first.tolist() and ids[0, 4] == toxicity.features([word[-4:]])[0, 4]
    assert (ids[:, 5] >= 0).sum() == 1


def test_the_end_of_a_long_word_is_scored():
    head, bad = "这是一个很长的句子没有任何空格或标点符号直到最后", "混蛋废物"
    weights = np.zeros(toxicity.BUCKETS)
    seen = toxicity.features([bad.encode()])[0, 6:]
    weights[seen[seen >= 0]] = 3.0
    model = toxicity.Model(weights, -5.0)
    clean, toxic = model.score([head, head + bad])[0]
    assert clean < 0.1 and toxic > 0.9


def test_ideographic_full_stops_end_sentences():
    text = "第一句。第二句！第三句？四"
    assert [text.encode()[a:b].decode() for a, b in toxicity.split(text)] == ["第一句", "第二句", "第三句", "四"]
