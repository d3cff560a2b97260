"""Cross-tokenizer alignment against both tokenizers run over whole texts and a sweep over byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from corpusledger.llm import alignment
from corpusledger.llm.queries import tokenizer_path
from tests.llm.cases import documents, frame

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
WHITE = alignment.WHITE


@pytest.fixture(scope="module")
def plain():
    return alignment.Pair(*PATHS, spans=False)


def brute(pair: alignment.Pair, texts: list[str | None]) -> list[tuple]:
    """Byte offsets of all tokens; groups where ends meet, links where ranges overlap."""
    first, second = pair.transducer.bytes
    made, documents_with = [], Counter()
    for text in texts:
        a = pair.first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.second.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(first[i] for i in a) != raw or b"".join(second[i] for i in b) != raw:
            made.append(None)
            continue

        def places(ids, table):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i])))
                at = out[-1][1]
            return out

        pa, pb = places(a, first), places(b, second)
        cuts = sorted({e for _, e in pa} & {e for _, e in pb})
        groups, links, j0 = [], [], 0
        rest = [list(zip(a, pa))[::-1], list(zip(b, pb))[::-1]]
        for cut in cuts:
            part = []
            for side in rest:
                held = []
                while side and side[-1][1][1] <= cut:
                    held.append(str(side.pop()[0]))
                part.append(",".join(held))
            groups.append("|".join(part))
        for i, (s, e) in zip(a, pa):
            while j0 < len(pb) and pb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(pb) and pb[j][0] < e:
                links.append((i, b[j]))
                j += 1
        documents_with.update(set(links))
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in documents_with.items():
        most[i] = max(most[i], n)
    out = []
    for x in made:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            counts = [documents_with[link] for link in x[3]]
            out.append((x[0], x[1], x[2], len(x[3]), sum(n == most[i] for n, (i, _) in zip(counts, x[3])), sum(counts), x[4]))
    return out


def strange(seed: int) -> str:
    rng = random.Random(seed)
    pieces = [" ", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "the", "Ing", "don't", "'s", "é", "日本", "\U0001f600", "<s>", "</s>", "<0x41>", "<|endoftext|>", "12", "345", "!!", ".", "​", "\x00", "ﬁ", "ß"]
    return "".join(rng.choices(pieces, k=rng.randint(1, 40)))


def test_spans_change_no_token(plain):
    spans = alignment.Pair(*PATHS)
    assert spans.spans
    texts = [t for t in (strange(i) for i in range(3000)) if t] + [r[1] for r in documents() if r[1]]
    texts += ["a" * 5000, " " * 300, "\n" * 7, "x▁y", " lead", "trail ", "a\n b", "a \nb", "a \n", "Mr. A", "so, it. Is.\nNow,it.. Go., x don't. é. A. b"]
    one, other = list(plain(texts)), list(spans(texts))
    for text, x, y in zip(texts, one, other):
        assert (x is None) == (y is None), repr(text)
        if x is not None:
            assert x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all(), repr(text)


@pytest.mark.parametrize("hot", [0, 50, 1 << 17])
def test_alignment_equals_a_sweep(spark, plain, hot):
    rows = documents(40) + [(5000 + i, strange(i), None, None, 0, "s", "k", 1, 5, "z", "no") for i in range(60)] + [(6000, "x▁y", *[None] * 9)]
    made = alignment.align(frame(spark, rows), *PATHS, hot=hot)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted = [(r[0], *x) for r, x in zip(rows, brute(plain, [r[1] for r in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, made.collect()), key=key) == sorted(wanted, key=key)


def test_a_task_that_hands_on_early(spark):
    rows = frame(spark).select("doc_id", "text").selectExpr("doc_id", "cast(text as binary) text")
    links = alignment.alignments(rows, *PATHS).select("links").cache()
    whole = {tuple(r) for r in alignment.pair_counts(links, "I").collect()}
    assert whole == {tuple(r) for r in alignment.pair_counts(links, "I", held=20).collect()}


def test_empty_table(spark):
    assert alignment.align(frame(spark, []), *PATHS).count() == 0


def test_transducer_refuses_other_bytes():
    made = alignment.Transducer([b"ab", b"c", b""], [b"a", b"bc", b"x"])
    assert made.align([0, 1], [0, 1]) == ([(2, 2)], [(0, 0), (0, 1), (1, 1)])
    assert made.align([0, 1], [0, 2]) is None
    assert made.align([0], [0, 1]) is None
    assert made.align([0, 1], [0]) is None


def test_spans_are_remembered_between_batches():
    """Reading a batch by the operator's own loop leaves its short spans known, so that the next one encodes nothing."""
    pair = alignment.Pair(*PATHS)
    batch = pa.record_batch([pa.array([1, 2]), pa.array([b"some words of a text", None])], ["doc_id", "text"])
    once = list(alignment._read(pair, batch, 1))
    assert len(pair.known) == 5
    pair.read = None
    again = list(alignment._read(pair, batch, 1))
    assert once[1] is again[1] is None and once[0][:4] == again[0][:4]
