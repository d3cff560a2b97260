"""Repeated passages by prefix-free parsing: every byte under a string of ``length`` bytes that also starts earlier goes.

A rolling hash runs over all texts. Of the ``length - gram + 1`` grams of a window of ``length`` bytes the one with the smallest hash
(rightmost of equals) is its trigger, so equal windows have their trigger at the same place and texts are cut alike wherever they
agree. A phrase is what the windows of one trigger cover: from the first of them to ``length - 1`` bytes past
the start of the last, where the usual phrase reaches over the next trigger only. So no window is left over between phrases, none is a prefix of
another's, and the order of the parse behind a phrase never has to be looked up beyond the ``length`` bytes that decide.

* The *dictionary* is the set of distinct phrases. In repetitive text it is small. Of equal phrases the first stays; in all others
  every window starts earlier as well.
* The *suffixes* of the dictionary are the windows within its phrases. Two of them can only be equal if their phrases share
  the trigger, so those alone are sorted, of phrases whose trigger two different phrases have; of equal ones the first stays.
* A phrase whose trigger occurs once in the corpus repeats nowhere and never leaves its task.

"First" is by document, then place. Every sort has two steps: a task sorts what it has read and keeps the first of equals, so
that no group of equals has more rows than there are tasks, then those are sorted by content over the whole corpus.
Which triggers occur twice, and which belong to two different phrases, is told to the tasks by bit maps of ``2^bits`` slots by
hash, put together slot range by slot range. They are a fixed size and only ever let through too much: as they fill, more
phrases are sorted and nothing is lost. Equality is that of 128-bit hashes of the whole phrase or window.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing. A null id comes after all others. Rows that agree in
id and text are one document and take nothing from each other; rows that agree in the id alone follow each other by a
hash of the text. An empty table gives an empty result. Texts of any length are read whole, in pieces that overlap. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusledger.llm.common import forget_shuffles, in_small_batches, join_by_id
from corpusledger.llm.words import M1, M2, mix
from corpusledger.runtime import materialise

LENGTH, GRAM = 100, 48
STEP = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
HELD = 1 << 20
RANGES = 1024
ORDER = ["lost", "doc_id", "key", "start"]


class Parser:
    """Cuts texts into phrases."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = 0):
        drawn = np.random.default_rng(seed + 0xF0).integers(0, 2**63, 257, np.uint64)
        self.length, self.gram, self.numbers, self.base = length, gram, drawn[:256] * np.uint64(2) + np.uint64(1), int(drawn[256]) | 1

    def rolling(self, buffer: np.ndarray) -> np.ndarray:
        """The hash of the gram at each place: polynomials of a power of two of bytes, joined."""
        part, size, made, have = self.numbers[buffer], 1, None, 0
        while True:
            if self.gram & size:
                made = part if made is None else part[: len(part) - have] * np.uint64(pow(self.base, have, 2**64)) + made[size:]
                have += size
            if size * 2 > self.gram:
                return mix(mix(made, M1), M2)
            part = part[:-size] * np.uint64(pow(self.base, size, 2**64)) + part[size:]
            size *= 2

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """The minimum of the grams of each window."""
        width, size = self.length - self.gram + 1, 1
        while size * 2 <= width:
            values = np.minimum(values[:-size], values[size:])
            size *= 2
        return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values

    def phrases(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, first window, number of windows and hash of the trigger of each phrase."""
        waiting, size = [], 0
        for number, text in enumerate(texts):
            for start in range(0, len(text) - self.length + 1, STEP):
                piece = text[start : start + STEP + self.length - 1]
                waiting.append((number, start, piece))
                size += len(piece)
                if size >= STEP:
                    yield self._scan(waiting)
                    waiting, size = [], 0
        if waiting:
            yield self._scan(waiting)

    def _scan(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buffer = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        hashed = self.rolling(buffer)
        # The place, reversed, in the lower bits: of equal hashes the rightmost is the smallest.
        least = self.smallest((hashed & ~PLACE) | (PLACE - np.arange(len(hashed), dtype=np.uint64)))
        trigger = (PLACE - (least & PLACE)).astype(np.int64)
        # No window reaches over the end of a piece.
        across = np.zeros(len(buffer) + 1, np.int64)
        across[ends - self.length + 1] += 1
        across[ends] -= 1
        windows = np.flatnonzero(np.cumsum(across)[: len(trigger)] == 0)
        trigger = trigger[windows]
        heads = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        first = windows[heads]
        piece = np.searchsorted(ends, first, "right")
        number, start = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        begins = ends - np.array([len(p[2]) for p in pieces])
        # Triggers are the small hashes; mixed again, they spread over all slots and ranges.
        return number[piece], first - begins[piece] + start[piece], np.diff(np.r_[heads, len(windows)]), mix(hashed[trigger[heads]], M2)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """lost, doc_id, key, texts and the rest, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            numbers = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)]
            yield *numbers, [t or b"" for t in part.column(3).to_pylist()], part


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """Slots of hashes that two rows of (hash, many) have or one row marks: ``2^bits`` bits, sorted and set range by range."""
    low, slots = np.uint64(64 - bits), (1 << bits) // RANGES
    top = F.shiftrightunsigned("hash", 54).cast("int")
    dealt = hashes.select(top.alias("range"), "hash", "many").repartition("range").sortWithinPartitions("range", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, marked, last = None, np.zeros(slots, bool), None

        def settle() -> pa.RecordBatch:
            made = [np.packbits(marked).tobytes()] if at is not None else []
            return pa.RecordBatch.from_arrays([pa.array([at] * len(made), pa.int32()), pa.array(made, pa.binary())], ["range", "marks"])

        for batch in batches:
            ranges, found = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            many = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True]) if len(ranges) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if ranges[a] != at:
                    yield settle()
                    at, last = int(ranges[a]), None
                    marked[:] = False
                part = found[a:b]
                twice = np.r_[last is not None and part[0] == last, part[1:] == part[:-1]]
                marked[((part[twice | many[a:b]] >> low) & np.uint64(slots - 1)).astype(np.int64)] = True
                last = part[-1]
        yield settle()

    out = np.zeros((RANGES, slots // 8), np.uint8)
    for row in dealt.mapInArrow(run, "range int, marks binary").collect():
        out[row["range"]] = np.frombuffer(row["marks"], np.uint8)
    return out.ravel()


def marked(marks: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def triggers(rows: DataFrame, parser: Parser) -> DataFrame:
    """hash, many: the distinct triggers that a task has read, and whether it read them at two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settle() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n > 1)], ["hash", "many"])

        for *_, texts, _ in _texts(batches):
            for *_, found in parser.phrases(texts):
                held.append(found)
                size += len(found)
            if size > HELD:
                yield settle()
                size = 0
        yield settle()

    return rows.mapInArrow(run, "hash long, many boolean")


NAMES = ["one", "two", *ORDER, "n", "trigger", "gone"]
SCHEMA = ", ".join(f"{x} {'boolean' if x == 'gone' else 'long'}" for x in NAMES)


class Sorter:
    """Sorts what a task has read by content. Of equals the first is handed on; the others are gone, and neighbours among them are one row."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, digests: list[bytes], *columns: np.ndarray) -> None:
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        self.held.append((both[:, 0], both[:, 1], *columns))
        self.size += len(digests)

    def settle(self) -> pa.RecordBatch:
        if not self.held:
            return pa.RecordBatch.from_arrays([pa.array([], pa.bool_() if x == "gone" else pa.int64()) for x in NAMES], NAMES)
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.lexsort([columns[i] for i in (5, 4, 3, 2, 1, 0)])
        columns = [c[order] for c in columns]
        differs = lambda cs: np.r_[True, np.any([c[1:] != c[:-1] for c in cs], axis=0)]
        first = differs(columns[:2])
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = ~first & np.any([c != c[head] for c in columns[2:6]], axis=0)
        kept, gone = [c[first] for c in columns], [c[again] for c in columns[2:7]]
        order = np.lexsort([gone[i] for i in (3, 2, 1, 0)])
        *named, start, n = (c[order] for c in gone)
        stop = start + n
        if len(start):
            cut = differs(named) | np.r_[True, start[1:] != stop[:-1]]
            heads, ends = np.flatnonzero(cut), np.r_[np.flatnonzero(cut)[1:], len(cut)] - 1
            named, start, n = [c[heads] for c in named], start[heads], stop[ends] - start[heads]
        # No group: these are known to be gone, and are spread by a hash of document and place.
        spread = mix(mix(named[2].view(np.uint64) ^ start.view(np.uint64) * M2, M1), M2).view(np.int64)
        lost = [spread, start, *named, start, n, np.zeros(len(start), np.int64)]
        self.held, self.size = [], 0
        made = [pa.array(np.concatenate([a, b])) for a, b in zip(kept, lost, strict=True)]
        return pa.RecordBatch.from_arrays([*made, pa.array(np.arange(len(first[first]) + len(start)) >= first.sum())], NAMES)


def dictionary(rows: DataFrame, parser: Parser, marks, bits: int) -> DataFrame:
    """The phrases whose trigger is marked, sorted within tasks: NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sorter, extra = Sorter(), parser.length - 1
        for lost, ids, keys, texts, _ in _texts(batches):
            for number, start, n, trigger in parser.phrases(texts):
                on = marked(marks.value, bits, trigger)
                number, start, n, trigger = number[on], start[on], n[on], trigger[on]
                digests = [xxhash.xxh3_128_digest(texts[d][a:b]) for d, a, b in zip(number.tolist(), start.tolist(), (start + n + extra).tolist(), strict=True)]
                sorter.add(digests, lost[number], ids[number], keys[number], start, n, trigger.view(np.int64))
            if sorter.size > HELD:
                yield sorter.settle()
        yield sorter.settle()

    return rows.mapInArrow(run, SCHEMA)


def suffixes(wanted: DataFrame, length: int) -> DataFrame:
    """The windows of wanted phrases, ``spans`` of texts, sorted within tasks: NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sorter = Sorter()
        for lost, ids, keys, texts, part in _texts(batches):
            for d, spans in enumerate(part.column(4).to_pylist()):
                text = texts[d]
                for span in spans:
                    start = np.arange(span["start"], span["stop"])
                    sorter.add([xxhash.xxh3_128_digest(text[i : i + length]) for i in start.tolist()], *(np.full(len(start), x[d]) for x in (lost, ids, keys)), start, np.ones_like(start), np.zeros_like(start))
                if sorter.size > HELD:
                    yield sorter.settle()
        yield sorter.settle()

    return wanted.mapInArrow(run, SCHEMA)


def judged(sorted_: DataFrame) -> DataFrame:
    """Marks the first of equals over the whole corpus; a group has at most a row for each time that a task handed its rows on."""
    place = F.rank().over(Window.partitionBy("one", "two").orderBy(*ORDER))
    return sorted_.withColumn("first", (place == 1) & ~F.col("gone"))


def spans(rows: DataFrame) -> DataFrame:
    """For each document its (start, n) as sorted spans, neighbours joined, under ``_cl_id``; ``weight``: their bytes."""
    found = rows.groupBy("lost", "doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("all"))
    heads = F.filter("all", lambda x, i: (i == 0) | (F.try_element_at("all", F.when(i > 0, i).otherwise(1))["stop"] != x["start"]))
    tails = F.filter("all", lambda x, i: (i + 1 == F.size("all")) | (F.try_element_at("all", i + 2)["start"] != x["stop"]))
    joined = F.transform(F.arrays_zip(heads.alias("h"), tails.alias("t")), lambda z: F.struct(z["h"]["start"].alias("start"), z["t"]["stop"].alias("stop")))
    return found.select(F.struct("lost", "doc_id", "key").alias("_cl_id"), joined.alias("spans"), (F.lit(64) + 16 * F.size(joined)).cast("long").alias("weight"))


def _with_spans(rows: DataFrame, found: DataFrame, most: int) -> DataFrame:
    keyed = rows.withColumn("at", F.struct("lost", "doc_id", "key"))
    return join_by_id(keyed, found, "at", most, "weight").select("lost", "doc_id", "key", "text", "spans")


def cut(text: bytes, spans: list[dict] | None, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left, for spans of windows."""
    kept, at, removed, runs, reached = [], 0, 0, 0, -1
    for span in spans or []:
        start, stop = span["start"], span["stop"] + length - 1
        if start > reached:
            runs += 1
            kept.append(text[at:start])
        removed += stop - max(start, at) if at > start else stop - start
        at = reached = stop
    kept.append(text[at:])
    return removed, runs, b"".join(kept)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bits: int = 28, most: int = 32 << 20, texts: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` also ``kept``, of every row.

    ``most``: the spans of all documents, in bytes, up to which they are broadcast; beyond, texts are shuffled to them.
    """
    spark, parser = docs.sparkSession, Parser(length, gram)
    text, number = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), F.col(id_col).cast("long")
    rows = in_small_batches(docs).select(F.isnull(number).cast("long").alias("lost"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    # The hash of the text only tells documents with one id apart. Where no id has two texts it is not carried along.
    among = rows.groupBy("lost", "doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    if among.filter("low != high").isEmpty():
        rows = rows.withColumn("key", F.lit(0).cast("long"))

    twice = spark.sparkContext.broadcast(bit_map(triggers(rows, parser), bits))
    phrases = materialise(judged(dictionary(rows, parser, twice, bits)), "repeat-phrases")
    forget_shuffles(spark)

    extremes: list[Column] = [f(c).alias(f"{name}_{c}") for c in ("one", "two") for name, f in (("low", F.min), ("high", F.max))]
    shared = phrases.filter("first").groupBy("trigger").agg(*extremes).filter("low_one != high_one or low_two != high_two")
    several = spark.sparkContext.broadcast(bit_map(shared.select(F.col("trigger").alias("hash"), F.lit(True).alias("many")), bits))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = marked(several.value, bits, batch.column(5).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(on)).select(range(5))

    names = [*ORDER, "n"]
    wanted = phrases.filter("first").select(*names, "trigger").mapInArrow(shares, ", ".join(f"{x} long" for x in names))
    windows = _with_spans(rows, spans(wanted), most).filter("spans is not null")
    windows = materialise(judged(suffixes(windows, length)).filter("not first").select(*names), "repeat-windows")
    forget_shuffles(spark)

    gone = phrases.filter("not first").select(*names).unionByName(windows)
    met = _with_spans(rows, spans(gone), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lost, ids, _, read, part in _texts(batches):
            made = [cut(t, s, length) for t, s in zip(read, part.column(4).to_pylist(), strict=True)]
            out = [pa.array(ids, mask=lost == 1), pa.array([len(t) for t in read], pa.int64()), *(pa.array([m[i] for m in made], pa.int64()) for i in range(2))]
            out.append(pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()))
            kept = [pa.array([m[2] for m in made], pa.binary())] if texts else []
            yield pa.RecordBatch.from_arrays([*out, *kept], columns)

    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
