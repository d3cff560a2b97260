"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. The transducer reads both token sequences at once; its state is the side that
leads and the bytes by which it leads, the dangling suffix. It takes the next token of the side that is behind,
strikes off what agrees, and what is left of the longer becomes the new suffix. An empty suffix closes a
group. Transitions are remembered by state and token, so the bytes of a pair are compared once. Every token taken
while a suffix dangles overlaps the token that the suffix is of: that is a link, and there are no others.

Both tokenizers cut before a single space between words and around a single newline, so texts are read in
spans between such places; what the transducer makes of a span, from empty suffix to empty suffix, is
remembered too, by a Python worker for all its tasks. :meth:`Pair.spans_hold` checks on the vocabularies that this is exact; where it is not,
whole texts go through the transducer.

Texts are read once; a document's distinct links are written to the shared folder beside its row. How many documents hold an id
pair linked is counted from there: a task adds its documents up, and the sums are shuffled, a row per pair and task. Then each
document's links meet the counts: the ``hot`` most frequent pairs, a table of that size at most, go to the tasks; all other pairs are written as rows,
joined by pair and added up by document. Beyond the ``hot`` most frequent, a pair holds at most one
``hot``-th of all rows, so no pair is large. The highest count of each id of the first tokenizer goes along; the vocabulary bounds it.

Defined cases: a null or empty text, and one whose tokens do not spell a space and the text, has no tokens: all
numbers 0, no digest. Rows with a null id, and rows that repeat, are documents of their own. An empty
table gives an empty result. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusledger.llm.common import in_small_batches, kept
from corpusledger.runtime import materialise

#: White space as the first tokenizer's splitting pattern knows it (the Unicode property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of several kinds or several characters with what follows it: no place to cut.
_WIDE = f"(?:(?![ \n][^{WHITE}])[{WHITE}]+[^{WHITE}]*)*"
#: A word with the single space or newline before it and, at the beginning, any other white space.
SPAN = re.compile(f"[ \n][^{WHITE}]+{_WIDE}|[{WHITE}]+[^{WHITE}]*{_WIDE}")
#: Where a text has white space other than single spaces and newlines between words.
OTHER = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]|[ \n][ \n]|^[ \n]|[ \n]\\Z")

PLAIN = re.compile(r" [A-Za-z]+[.,]?\Z")

#: How the pieces of the second tokenizer write a space.
SPACE = "\u2581"

#: Distinct pairs, or spans, that a task holds before it hands them on or forgets them.
HELD, REMEMBERED = 1 << 20, 700_000


class Transducer:
    """Aligns two token sequences over the same bytes. States are numbered: 0 is the empty suffix, above it A leads, below it B leads."""

    def __init__(self, first: list[bytes], second: list[bytes], most: int = 1 << 20):
        self.bytes, self.most = (first, second), most
        self.forget()

    def forget(self) -> None:
        self.known, self.number, self.suffix = 0, {}, [b""]
        self.moves: tuple[list[dict], list[dict]] = ([{}], [{}])
        self.enter: dict[int, int] = {}

    def state(self, side: int, suffix: bytes) -> int:
        if not suffix:
            return 0
        at = self.number.get(suffix)
        if at is None:
            at = self.number[suffix] = len(self.suffix)
            self.suffix.append(suffix)
            self.moves[0].append({})
            self.moves[1].append({})
        return -at if side else at

    def move(self, state: int, token: int) -> int | None:
        """The state after the side that is behind has taken ``token``; None if the bytes differ."""
        side = int(state < 0)
        suffix, taken = self.suffix[abs(state)], self.bytes[1 - side][token]
        if suffix.startswith(taken):
            after = self.state(side, suffix[len(taken) :])
        elif taken.startswith(suffix):
            after = self.state(1 - side, taken[len(suffix) :])
        else:
            after = None
        self.moves[side][abs(state)][token] = after
        self.known += 1
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The places where groups end, as numbers of tokens taken of either side, and the links as pairs of ids; None if the bytes differ."""
        if self.known > self.most:
            self.forget()
        ahead, behind = self.moves
        ends, links, i, j, n, m = [], [], 0, 0, len(a), len(b)
        while i < n:
            x = a[i]
            i += 1
            state = self.enter.get(x)
            if state is None:
                state = self.enter[x] = self.state(0, self.bytes[0][x])
            while state:
                if state > 0:
                    if j == m:
                        return None
                    y = b[j]
                    j += 1
                    after = ahead[state].get(y)
                    if after is None:
                        after = self.move(state, y)
                else:
                    if i == n:
                        return None
                    x = a[i]
                    i += 1
                    after = behind[-state].get(x)
                    if after is None:
                        after = self.move(state, x)
                if after is None:
                    return None
                links.append((x, y))
                state = after
            ends.append((i, j))
        return (ends, links) if j == m else None


class Pair:
    """Two tokenizers, their token bytes, and the remembered spans."""

    def __init__(self, first: str, second: str, spans: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.first.encode_special_tokens = True
        self.pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.width = len(self.pieces)
        vocabulary = self.first.get_vocab()
        made = [b""] * (max(vocabulary.values()) + 1)
        letters = {letter: byte for byte, letter in self.byte_letters().items()}
        for word, i in vocabulary.items():
            made[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        one = re.compile(r"<0x([0-9A-F]{2})>\Z")
        other = [bytes([int(m[1], 16)]) if (m := one.match(p)) else p.replace(SPACE, " ").encode() for p in self.pieces]
        self.transducer = Transducer(made, other)
        #: Of either side's ids: whether the token begins with a space, and the id as text.
        self.opens = [[x[:1] == b" " for x in table] for table in (made, other)]
        self.digits = list(map(str, range(max(len(made), len(other)))))
        #: Numbers of pairs fit 32 bits for vocabularies of usual size.
        self.kind = "I" if len(made) * self.width < 1 << 32 else "Q"
        self.spans = self.spans_hold() if spans is None else spans
        self.known: dict[str, tuple] = {}

    @classmethod
    def of(cls, first: str, second: str) -> Pair:
        """The pair of this Python worker, kept from task to task."""
        return kept(f"alignment {first} {second}", lambda: cls(first, second))

    @staticmethod
    def byte_letters() -> dict[int, str]:
        """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def spans_hold(self) -> bool:
        """Whether cutting at spans changes no token: no piece holds a newline or goes on past the end of a word, and the pre-tokenizer is the byte-level one."""
        import json

        asked = json.loads(self.first.to_str())
        splits = asked["pre_tokenizer"] or {}
        plain = asked["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        words = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        newline = self.second.encode("\n") == [self.second.piece_to_id(SPACE), self.second.piece_to_id("<0x0A>")]
        return bool(plain and words and newline)

    def encode(self, spans: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of spans of ``space + text``. The second tokenizer adds the space, a token of its own before a newline.

        Plain words are encoded many at a time, and their tokens told apart by the space that only a first token has.
        """
        if not self.spans:
            return [x.ids for x in self.first.encode_batch_fast(spans, add_special_tokens=False)], self.second.encode([s[1:] for s in spans], num_threads=1)
        plain = [s for s in spans if PLAIN.match(s)]
        made: dict[str, tuple[list[int], list[int]]] = {}
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            text = "".join(part)
            a, b = self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.second.encode(text[1:], num_threads=1)
            cuts = [[i for i, x in enumerate(ids) if opens[x]] + [len(ids)] for ids, opens in zip((a, b), self.opens, strict=True)]
            if len(cuts[0]) == len(cuts[1]) == len(part) + 1:
                made.update((s, (a[i:j], b[k:m])) for s, i, j, k, m in zip(part, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False))
        rest = [s for s in spans if s not in made]
        a = [x.ids for x in self.first.encode_batch_fast(rest, add_special_tokens=False)]
        b = self.second.encode([s[1:] if s[0] == " " else s for s in rest], num_threads=1)
        made.update((s, (x, y if s[0] == " " else y[1:])) for s, x, y in zip(rest, a, b, strict=True))
        return [made[s][0] for s in spans], [made[s][1] for s in spans]

    def cut(self, text: str) -> list[str]:
        """The spans of ``space + text``, of which plain words go without their space."""
        if not self.spans:
            return [" " + text]
        if not OTHER.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " and len(s) > 1 and s[1] not in WHITE else s for s in SPAN.findall(" " + text)]

    def read(self, spans: list[str]) -> list[tuple | None]:
        """Tokens of either side, groups, the groups as text and the links as packed numbers, of each span; None if the bytes differ."""
        out, flat, first, align, width, digits = [], [], self.transducer.bytes[0], self.transducer.align, self.width, self.digits
        for span, a, b in zip(spans, *self.encode(spans), strict=True):
            # That the second side spells the same bytes as the first is what the transducer finds out.
            made = align(a, b) if b"".join([first[i] for i in a]) == span.encode() else None
            if made is None:
                out.append(None)
                continue
            ends, links = made
            n, m = [digits[x] for x in a], [digits[y] for y in b]
            if len(ends) == 1:
                text = f"{','.join(n)}|{','.join(m)}"
            else:
                parts, i, j = [], 0, 0
                for to, upto in ends:
                    # Most groups are of one token a side.
                    parts.append(f"{n[i]}|{m[j]}" if to - i == upto - j == 1 else f"{','.join(n[i:to])}|{','.join(m[j:upto])}")
                    i, j = to, upto
                text = ";".join(parts)
            begin = len(flat)
            flat += [x * width + y for x, y in links]
            out.append((len(n), len(m), len(ends), text, begin, len(flat)))
        packed, size = array(self.kind, flat).tobytes(), array(self.kind).itemsize
        return [x and (*x[:4], packed[x[4] * size : x[5] * size]) for x in out]

    def __call__(self, texts: list[str]) -> list[tuple | None]:
        """For each text its counts, digest, distinct links and how often it holds each; None for a text without tokens."""
        found, known, out = [self.cut(t) for t in texts], self.known, []
        parts_of = [list(map(known.get, spans)) for spans in found]
        fresh = list({s for spans, parts in zip(found, parts_of, strict=True) if None in parts for s, x in zip(spans, parts, strict=True) if x is None})
        made = dict(zip(fresh, self.read([s if s[0] in " \n" else " " + s for s in fresh]), strict=True)) if fresh else {}
        for spans, parts in zip(found, parts_of, strict=True):
            if None in parts:
                parts = [made[s] if x is None else x for s, x in zip(spans, parts, strict=True)]
            if None in parts:
                out.append(None)
                continue
            a, b, groups, text, packed = zip(*parts, strict=True)
            links, times = np.unique(np.frombuffer(b"".join(packed), self.kind), return_counts=True)
            out.append((sum(a), sum(b), sum(groups), hashlib.sha256(";".join(text).encode()).hexdigest(), links, times))
        if len(self.known) + len(made) <= REMEMBERED:
            self.known.update((s, x) for s, x in made.items() if x is not None and len(s) <= 32)
        return out


def _read(pair: Pair, batch: pa.RecordBatch, place: int) -> Iterator[tuple | None]:
    """The alignment of each row's text. Bytes that are no UTF-8 cannot be spelt and have no tokens."""
    texts = []
    for raw in batch.column(place).to_pylist():
        try:
            texts.append((raw or b"").decode())
        except UnicodeDecodeError:
            texts.append("")
    for at in range(0, len(texts), 64):
        part = [t for t in texts[at : at + 64] if t]
        made = iter(pair(part))
        yield from [next(made) if t else None for t in texts[at : at + 64]]


def alignments(rows: DataFrame, first: str, second: str) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links and times of each row of (doc_id, text); links and how often each occurs are packed."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = Pair.of(first, second), TaskContext.get().partitionId() << 33
        for batch in batches:
            out, rest = [], []
            for doc_id, made in zip(batch.column(0).to_pylist(), _read(pair, batch, 1), strict=True):
                row += 1
                n_a, n_b, groups, digest, links, times = made or (0, 0, 0, "", np.empty(0, pair.kind), np.empty(0, np.int64))
                out.append((row, doc_id, n_a, n_b, groups, int(times.sum())))
                rest.append((digest, links.tobytes(), times.astype("I").tobytes()))
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))]
            columns += [pa.array([r[i] for r in rest], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "groups_sha256", "links", "times"])

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", groups_sha256 string, links binary, times binary")


def pair_counts(links: DataFrame, kind: str, held: int = HELD) -> DataFrame:
    """pair, n: how many documents hold the pair linked. A pair is ``id of A * pieces of B + id of B``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, size = np.empty(0, kind), np.empty(0, np.int64), [], 0

        def merge() -> None:
            nonlocal keys, sums, size
            new, counts = np.unique(np.frombuffer(b"".join(waiting), kind), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, sums, size = both, np.bincount(place, np.concatenate([sums, counts]), len(both)).astype(np.int64), 0
            waiting.clear()

        def settle() -> pa.RecordBatch:
            nonlocal keys, sums
            made = pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], ["pair", "n"])
            keys, sums = keys[:0], sums[:0]
            return made

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                waiting.append(packed)
                size += len(packed)
                if size > 8 * held:
                    merge()
                if len(keys) > held:
                    yield settle()
        merge()
        yield settle()

    return links.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 1 << 17) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pair = Pair(first, second, False)
    width, kind = pair.width, pair.kind
    read = materialise(alignments(rows, first, second), "align-rows")
    counts = materialise(pair_counts(read.select("links"), kind), "align-counts")
    # At most as many rows as the first vocabulary has ids.
    highest = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    judged = counts.join(F.broadcast(highest), F.expr(f"pair div {width}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    table = judged.orderBy(F.desc("n"), "pair").limit(hot).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((table["pair"].to_numpy().astype(kind), table["n"].to_numpy().astype(np.int64), table["best"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number, best = sent.value
        for batch in batches:
            sums, rare, often = [], [], []
            for links, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                links, times = np.frombuffer(links, kind), np.frombuffer(times, "I").astype(np.int64)
                at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
                known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                at, seen = at[known], times[known]
                sums.append((int((seen * best[at]).sum()), int((seen * number[at]).sum())))
                rare.append(links[~known].astype(np.int64))
                often.append(times[~known])
            columns = [batch.column(0), *(pa.array([s[i] for s in sums], pa.int64()) for i in range(2))]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, often)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["row", "n_best", "count_sum", "rare", "often"])

    met = materialise(read.select("row", "links", "times").mapInArrow(run, "row long, n_best long, count_sum long, rare array<long>, often array<long>"), "align-met")
    loose = met.filter("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "often")).alias("at"))
    loose = loose.select("row", F.col("at.rare").alias("pair"), F.col("at.often").alias("often"))
    # What was handed to the tasks is the head of the same order, so these pairs are of the rest.
    rest = loose.join(judged.withColumnRenamed("n", "held"), "pair")
    rest = rest.select("row", (F.col("often") * F.col("best").cast("long")).alias("n_best"), (F.col("often") * F.col("held")).alias("count_sum"))
    added = met.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return read.drop("links", "times").join(added, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
