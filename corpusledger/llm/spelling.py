"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Two words of lengths m and m or m + 1 that are one inserted, deleted or replaced code point apart agree before the
edit and behind it. Let e be the length of their common prefix, the place of the edit. If e is in the second half of
the word, the first half is intact and both lie in one block of the dictionary sorted forward; if it is in the
first, the second half is intact and both lie in one block of the dictionary of reversed words. A block is a
range of places [lo, hi): its words share the ``lo`` code points before it and the ``m - hi`` behind it. A pair is
in exactly one block, that whose range holds its e, so nothing is found twice.

A block of more than ``most`` words is cut: the edit lies in one half of its range, the other half is
intact and makes both its blocks smaller. Cutting goes on until a block is small or its range is a single
place, where the alphabet bounds it. Sizes come from an aggregation with a partial side, so no block is held
anywhere before it is small. Small blocks are sorted, range-scanned as they stream by, and every pair is verified.

A word's form is its near word of the largest count, if that is at least ``ratio`` times its own; roots follow the
forms by pointer doubling. Counts rise at each step, so chains are short and have no circle.

Defined cases: a null text has no words; a null id is written as the empty text in the drawn deletions; an empty table
gives an empty result; rows that repeat count each for itself. Words of any length are compared whole. Other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusledger.llm.common import in_small_batches, join_groups
from corpusledger.runtime import drop_table, materialise

LETTERS = re.compile("[A-Za-z\u00c0-\u00ff]+")
HELD = 300_000


def runs(text: bytes | None) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased. Bytes that are no UTF-8 are no letters."""
    return LETTERS.findall((text or b"").lower().decode("utf-8", "replace"))


def misspell(doc_id: int | None, run: str, every: int) -> str:
    """The run, of which one in ``every`` loses a code point, drawn by the hash of document and run."""
    drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if drawn % every:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str, every: int, shortest: int, least: int, held: int = HELD) -> DataFrame:
    """word, n: words of at least ``shortest`` code points that occur ``least`` times. A task adds up what it reads; it holds ``held`` words at most."""
    rows = in_small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def settle() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(runs(text)).items():
                    # A deletion takes one code point, so shorter runs make no word.
                    if len(word) >= shortest and len(word := misspell(doc_id, word, every)) >= shortest:
                        seen[word] += n
                if len(seen) > held:
                    yield settle()
        yield settle()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(u: str, v: str) -> int | None:
    """The place of the edit, their common prefix's length, if ``v``, no shorter than ``u``, is exactly one edit from it."""
    m, longer = len(u), len(v) - len(u)
    if longer > 1 or u == v:
        return None
    e = next((k for k in range(m) if u[k] != v[k]), m)
    return e if u[e + 1 - longer :] == v[e + 1 :] else None


def _blocks(dictionary: DataFrame) -> DataFrame:
    """Two blocks for pairs with words of the same length or longer by one, and two for pairs with words shorter by one."""
    size = F.char_length("word").cast("int")
    made = dictionary.withColumn("m", F.explode(F.array(size, size - 1)))
    half = F.expr("m div 2").cast("int")
    reversed_, forward = F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi"))
    return _keyed(made.withColumn("at", F.explode(F.array(forward, reversed_))))


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of (word, n, m, at). A hash of 128 bits stands for it until it is small; then blocks are told apart by their letters."""
    rows = rows.select("word", "n", "m", "at.lo", "at.hi").filter("lo < hi")
    return rows.withColumn("block", F.struct(F.xxhash64("m", "lo", "hi", *_intact()), F.xxhash64(*_intact()[::-1], "hi", "lo", "m")))


def _intact() -> list[Column]:
    """What all words of a block share: the letters before its range, and those behind it from the end of the word on."""
    behind = F.right("word", F.greatest(F.col("m") - F.col("hi"), F.lit(0)))
    return [F.substring("word", F.lit(1), F.col("lo")), F.reverse(behind)]


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.expr("(lo + hi) div 2").cast("int")
    cut = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(rows.select("word", "n", "m", F.explode(cut).alias("at")))


def small_blocks(dictionary: DataFrame, most: int) -> list[DataFrame]:
    """Tables of blocks, each with at most ``most`` words or a single place for the edit. Blocks without a pair are left out."""
    waiting, done = _blocks(dictionary), []
    while True:
        waiting = materialise(waiting, "spell-blocks")
        shorter = F.count_if(F.char_length("word") == F.col("m"))
        sizes = waiting.groupBy("block").agg(F.count(F.lit(1)).alias("size"), shorter.alias("shorter"), F.max(F.col("hi") - F.col("lo")).alias("places"))
        sizes = materialise(sizes.filter("size > 1 and shorter > 0"), "spell-sizes")
        judged = join_groups(waiting, sizes, "block", "size").filter("size is not null")
        judged = materialise(judged.withColumn("large", (F.col("size") > most) & (F.col("places") > 1)).drop("size", "shorter", "places"), "spell-judged")
        drop_table(waiting)
        drop_table(sizes)
        done.append(judged.filter("not large").drop("large"))
        large = judged.filter("large").drop("large", "block")
        if large.isEmpty():
            return done
        waiting = _halves(large)


def near_words(blocks: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word of each block its near words there, how many and the most frequent of them."""
    before, behind = _intact()
    order = ["m", "lo", "hi", "before", "behind"]
    dealt = blocks.repartition("block").select("m", "lo", "hi", before.alias("before"), behind.alias("behind"), "word", "n").sortWithinPartitions(*order, "word")

    def scan(words: list[tuple[str, int]], m: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
        """All pairs of a block: what a word is without the place of the edit leads to its partners, which are then verified."""
        open_, found = {}, {}
        for word, n in words:
            if len(word) == m:
                for e in range(lo, min(hi, m)):
                    open_.setdefault((e, word[:e], word[e + 1 :]), []).append((word, n))
        for held in open_.values():
            for i, (u, n) in enumerate(held):
                for v, k in held[i + 1 :]:
                    found[u, v] = n, k
        short = {word: n for word, n in words if len(word) == m}
        for word, n in words:
            if len(word) == m + 1:
                for e in range(lo, min(hi, m + 1)):
                    u = word[:e] + word[e + 1 :]
                    if u in short:
                        found[u, word] = short[u], n
        for (u, v), (n, k) in found.items():
            e = one_edit(u, v)
            if e is not None and lo <= e < hi:
                yield u, 1, k, v
                yield v, 1, n, u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for (m, lo, hi, *_), block in groupby(rows(), lambda r: r[:5]):
            out += scan([r[5:] for r in block], m, lo, hi)
            if len(out) > 10_000:
                yield _table(out)
                out = []
        yield _table(out)

    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last. Each round doubles the reach."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        beyond = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        on = at.join(beyond, F.col("root") == F.col("_w"), "left")
        moved = materialise(on.select("word", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("moved")), "spell-roots")
        drop_table(at)
        at = moved
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, most: int = 64
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    dictionary = materialise(count_words(docs, id_col, text_col, every, shortest, least), "spell-words")
    tables = small_blocks(dictionary, most)
    blocks = tables[0]
    for table in tables[1:]:
        blocks = blocks.unionByName(table)
    # Strings compare by their bytes, which for UTF-8 is the order of code points.
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("b")
    near = near_words(blocks).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = dictionary.join(near, "word", "left")
    taken = F.col("n") * ratio <= -F.col("b.k")
    judged = joined.select(
        "word", F.when(taken, F.col("b.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("b.k")).alias("form_n")
    )
    judged = materialise(judged, "spell-forms")
    last = roots(judged.filter("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
