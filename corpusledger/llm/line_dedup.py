"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words (runs of anything but ASCII white space). Two lines match when the
Jaccard of their sets is at least ``4/5``; a line goes when an earlier one, by document id and line number,
matches it.

Words are ordered by rarity: document frequency is counted over all lines, at most ``ranked`` of the
most frequent words are broadcast with their rank (a bounded table), and all others, rarer than
those, come before them by hash. Any order that all lines share keeps the filters exact. Then

* prefix filter: sets with Jaccard t share one of the first n - ceil(t n) + 1 words of each, so a line is posted under those words only;
* shared words: a word that one set alone has makes no pair; a bitmap of ``2^bits`` bits of the words of two sets or more keeps most others from being posted;
* length filter: sizes may differ by the factor t at most;
* positional filter: what can still be shared after the two positions must suffice;
* bitmap filter: a 128-bit parity sketch differs in at most as many bits as the sets differ in words.

What passes is linked, as a spanning forest for each task, never as all pairs. The connected groups of
these candidates fetch their words, and in pairs of tiles of ``tile / 2`` sets every pair is verified by exact
intersection counts; only per-set counts and minima leave a tile. Words of which more than ``tile``
lines hold one are tiled too.

A row is known by its id and a hash of its text, so that rows without an id, and texts that share one, are
judged apart. Sets are known by two 64-bit hashes, 128 bits; candidates are grouped by the first alone, where
a meeting of two sets only adds a pair to verify.

Defined cases: a null text is one empty line. Lines without words match nothing and stay. Lines with equal
sets are one class: the first stays unless an earlier class matches it, the others go. Rows that
repeat a document's id and text stay or go alike; of different texts with one id, that with the smaller
hash is the earlier. A null id comes after all others. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusledger.llm.common import components, in_small_batches, join_by_id, join_groups, row_key
from corpusledger.llm.words import M1, M2, Words, by_line, distinct, mix
from corpusledger.runtime import materialise

#: Jaccard threshold as a fraction.
UP, DOWN = 4, 5
LEAST_WORDS = 4  # smaller sets match only equal ones at 4/5
FREQUENT, RANK = np.uint64(1 << 63), np.uint64(40)
LAST = 2**63 - 1
TEXT_SEED = 42  # of Spark's xxhash64
#: Tiles of one word's lines, and words of the sets that meet in one pair of tiles.
MOST_TILES, TILE_WORDS = 1 << 12, 1 << 23
#: Lines that are read together where their groups are verified.
READ = 512
#: Sets of a group that is verified with others at once, and cells of their table of words.
SMALL, HOLDS = 32, 1 << 24
#: Ranges of words that are counted apart.
RANGE_BITS = 10
RANGES = 1 << RANGE_BITS
#: Ranges of groups that are dealt out, each as a whole, and postings that a task collects before it sends them.
DEALT_BITS, COLLECTED = 12, 1 << 18


class Reader:
    """Texts to the distinct words of their lines, as numbers in the common order."""

    def __init__(self, top: np.ndarray | None = None, frequency: np.ndarray | None = None, shared: np.ndarray | None = None, seed: int = 0):
        """``top``: hashes of the frequent words, rarest first; found by a table over the low bits of a hash. ``shared``: bitmap of words that two sets have."""
        self.top = np.empty(0, np.uint64) if top is None else top
        self.frequency, self.shared, self.seed = frequency, shared, seed
        self.by_hash = np.argsort(self.top)
        self.ordered = self.top[self.by_hash]
        self.low = np.uint64((1 << max(1, (8 * len(self.top)).bit_length())) - 1)
        slot = (self.top & self.low).astype(np.int64)
        self.slots = np.zeros(int(self.low) + 1, np.int32)
        self.slots[slot] = np.arange(len(self.top))
        self.crowded = np.bincount(slot, minlength=int(self.low) + 1) > 1

    def rank(self, plain: np.ndarray) -> np.ndarray:
        """Hashes of words to their place in the order: frequent words after all others, by rank."""
        if not len(self.top) or not len(plain):
            return plain
        slot = (plain & self.low).astype(np.int64)
        at = self.slots[slot]
        hit = self.top[at] == plain
        if len(again := np.flatnonzero(self.crowded[slot] & ~hit)):
            found = np.minimum(np.searchsorted(self.ordered, plain[again]), len(self.ordered) - 1)
            hit[again] = self.ordered[found] == plain[again]
            at = at.copy()
            at[again] = self.by_hash[found]
        return np.where(hit, FREQUENT | at.astype(np.uint64) << RANK, plain)

    def tiles(self, number: np.ndarray, tile: int) -> np.ndarray:
        """Into how many tiles the lines of each word are cut."""
        if not len(self.top):
            return np.ones(len(number), np.int64)
        frequent = number >= FREQUENT
        most = np.minimum(-(-self.frequency // tile), MOST_TILES).astype(np.int64)
        return np.where(frequent, most[np.where(frequent, (number ^ FREQUENT) >> RANK, 0).astype(np.int64)], 1)

    def is_shared(self, number: np.ndarray) -> np.ndarray:
        """False only for words that no second set has."""
        if self.shared is None:
            return np.ones(len(number), bool)
        bit = number & np.uint64(64 * len(self.shared) - 1)
        held = self.shared[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
        return (number >= FREQUENT) | (held == 1)  # a frequent word's number is its rank

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, line number) of each line; (line, hash) of each distinct word, sorted by both."""
        found = Words(texts, self.seed)
        return found.document, found.place, *distinct(found.line, found.hash >> np.uint64(1))

    def set_hashes(self, lines: int, line: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line's set that do not hang on an order."""
        one, two = np.zeros(lines, np.uint64), np.zeros(lines, np.uint64)
        if len(line):
            starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            one[line[starts]] = np.add.reduceat(mix(plain, M1), starts)
            two[line[starts]] = np.bitwise_xor.reduceat(mix(plain, M2), starts) ^ np.add.reduceat(plain, starts)
        return mix(one, M2), two


def text_key(text: bytes | None) -> int:
    """Spark's xxhash64 of a text, unsigned."""
    from xxhash import xxh64_intdigest

    return TEXT_SEED if text is None else xxh64_intdigest(text, TEXT_SEED)


def _batches(batches: Iterator[pa.RecordBatch], size: int = 256, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list]]:
    """Ids and texts, at most ``size`` rows and about ``most`` bytes at a time; a longer text comes alone."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        bytes_ = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + size, int(np.searchsorted(bytes_, bytes_[at] + most, "right")) - 1))
            yield ids[at:to], batch.column(1).slice(at, to - at).to_pylist()
            at = to


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _merged(words: np.ndarray, n: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal words added up; ``only`` is the set that all occurrences are in, 0 if there are two."""
    order = np.argsort(words)
    words, n, only = words[order], n[order], only[order]
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    if not len(starts):
        return words, n, only
    one = np.minimum.reduceat(only, starts)
    return words[starts], np.add.reduceat(n, starts), np.where(one == np.maximum.reduceat(only, starts), one, np.uint64(0))


def survey(rows: DataFrame, seed: int, bits: int) -> DataFrame:
    """One pass: a row per line (kind -1: doc_id, line_no, set, check, words, key of the text), and what a task has counted, a row per range of words (kind, counts)."""
    names = ["kind", "a", "b", "c", "d", "n", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, fresh, size, held, kept = Reader(seed=seed), [], 0, [], 0

        def pack() -> None:
            """What was counted last, merged: most words of a task come again."""
            nonlocal size, kept
            words, n, only = _merged(*(np.concatenate(x) for x in zip(*fresh, strict=True)))  # by range
            held.append((words, n.astype(np.uint32), only))
            fresh.clear()
            size, kept = 0, kept + len(words)

        def counts() -> Iterator[pa.RecordBatch]:
            """A slice of the ranges after the other, so that little is held twice. Words are held with their ``bits`` lower bits first, and so lie by range."""
            nonlocal kept
            edges = [np.searchsorted(words, np.arange(16, dtype=np.uint64) << np.uint64(60)).tolist() + [len(words)] for words, _, _ in held]
            for k in range(16):
                words, n, only = _merged(*(np.concatenate([x[e[k] : e[k + 1]] for x, e in zip(column, edges, strict=True)]) for column in zip(*held, strict=True)))
                n = n.astype(np.uint32)
                kinds, starts = np.unique((words >> np.uint64(64 - RANGE_BITS)).astype(np.int64), return_index=True)
                words = words >> np.uint64(64 - bits) | words << np.uint64(bits)
                zero = np.zeros(len(kinds), np.int64)
                blobs = [x.tobytes() + y.tobytes() + z.tobytes() for x, y, z in zip(*(np.split(c, starts[1:]) for c in (words, only, n)), strict=True)] if len(kinds) else []
                yield _rows(names, kinds, zero, zero, zero, zero, zero, zero).append_column("counts", pa.array(blobs, pa.binary()))
            held.clear()
            kept = 0

        for ids, texts in _batches(batches):
            document, place, line, plain = reader.read(texts)
            one, two = reader.set_hashes(len(document), line, plain)
            n = np.bincount(line, minlength=len(document)).astype(np.int64)
            keys = np.array([text_key(t) for t in texts], np.uint64)[document]
            made = _rows(names, np.full(len(document), -1), ids[document].astype(np.int64), place.astype(np.int64), one, two, n, keys)
            yield made.append_column("counts", pa.nulls(len(document), pa.binary()))
            fresh.append((plain << np.uint64(64 - bits) | plain >> np.uint64(bits), np.ones(len(plain), np.uint32), (one ^ two)[line] | np.uint64(1)))
            size += len(plain)
            if size > 500_000:
                pack()
            if kept > 3_000_000:
                yield from counts()
        if size:
            pack()
        if held:
            yield from counts()

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names) + ", counts binary")


def word_counts(seen: DataFrame, bits: int) -> DataFrame:
    """Range by range: a row for every word of two sets or more (word, lines it is on), and one with the range's stretch of the bitmap (word: the range, df 0, stretch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, []

        def settle() -> pa.RecordBatch:
            words, n, only = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bit = (words[only == 0] & np.uint64((1 << bits - RANGE_BITS) - 1)).astype(np.int64)
            flags = np.zeros(1 << bits - RANGE_BITS, bool)
            flags[bit] = True
            often = only == 0
            found = [pa.array(np.r_[words[often].view(np.int64), kind]), pa.array(np.r_[n[often], 0].astype(np.int64))]
            stretch = pa.array([None] * int(often.sum()) + [np.packbits(flags, bitorder="little").tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([*found, stretch], ["a", "df", "stretch"])

        for batch in batches:
            for this, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if this != kind and held:
                    yield settle()
                    held = []
                kind, n = this, len(blob) // 20
                held.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 16 * n).astype(np.int64), np.frombuffer(blob, np.uint64, n, 8 * n)))
        if held:
            yield settle()

    dealt = seen.filter("kind >= 0").select("kind", "counts").repartition("kind").sortWithinPartitions("kind")
    return dealt.mapInArrow(run, "a long, df long, stretch binary")


def _packed(columns: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings (group, set, place, s1, s2) as a row for each range of groups, in which every column is the bytes of its numbers; a set has its group before it."""
    made = [np.concatenate(x) for x in zip(*columns, strict=True)]
    for at in range(0, len(made[0]), 4 * COLLECTED):
        group, sets, *rest = (x[at : at + 4 * COLLECTED] for x in made)
        part = (group >> np.uint64(64 - DEALT_BITS)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        n = np.bincount(part)
        kinds = np.flatnonzero(n)
        ends = np.r_[0, np.cumsum(n[kinds])]
        blobs = []
        for column, width in ((np.stack([group[order], sets[order]], 1), 16), *((x[order], 8) for x in rest)):
            blobs.append(pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(column)]))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *blobs], names)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """range, group, set, place, s1, s2 of every posting."""
    columns = []
    for column in batch.columns[1:]:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        columns.append(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64))
        n = np.diff(offsets) // 8  # of the last column, with one number a posting
    groups, rest = columns[0].reshape(-1, 2), columns[1:]
    return [np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n), groups[:, 0].view(np.uint64), groups[:, 1], *rest]


def postings(rows: DataFrame, made: Callable[[], Reader], tile: int) -> DataFrame:
    """group, set, place, s1, s2; each task makes its reader.

    A group is a word and a pair of its tiles, as one hash: two that share it only add pairs to verify. ``place`` is words << 32 | position << 2, and
    in its last bits whether the pair is of two tiles, and on the side of which. They are sent as numbers beside each other, a row for the postings of
    a task in one of ``2^DEALT_BITS`` ranges of groups: ``group`` is the range, and the others are read by :func:`_unpacked`.
    """
    names = ["group", "set", "place", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen, held, size = made(), set(), [], 0
        for _, texts in _batches(batches):
            document, _, line, plain = reader.read(texts)
            sets, checks = reader.set_hashes(len(document), line, plain)
            # A set that this task has posted is not posted again.
            both = zip(sets.tolist(), checks.tolist(), strict=True)
            fresh = np.array([s not in seen and (len(seen) > 500_000 or not seen.add(s)) for s in both], bool)
            fresh &= np.bincount(line, minlength=len(document)) >= LEAST_WORDS
            chosen = fresh[line]
            line, plain = line[chosen], plain[chosen]
            number = reader.rank(plain)
            line, number = by_line(line, number)
            count = np.bincount(line, minlength=len(document))
            starts = np.r_[0, np.cumsum(count)[:-1]]
            position = np.arange(len(line)) - starts[line]
            bit = mix(number, M2) >> np.uint64(57)
            flag = np.uint64(1) << (bit & np.uint64(63))
            firsts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
            s1, s2 = np.zeros(len(document), np.uint64), np.zeros(len(document), np.uint64)
            if len(line):
                s1[line[firsts]] = np.bitwise_xor.reduceat(np.where(bit < 64, flag, np.uint64(0)), firsts)
                s2[line[firsts]] = np.bitwise_xor.reduceat(np.where(bit >= 64, flag, np.uint64(0)), firsts)
            n = count[line]
            keep = (position < n + (-UP * n // DOWN) + 1) & reader.is_shared(number)
            line, number, position, n = line[keep], number[keep], position[keep], n[keep]
            tiles = reader.tiles(number, tile)
            own = (sets[line] % tiles.astype(np.uint64)).astype(np.int64)
            # A row goes to every pair of tiles that its own is in.
            row = np.repeat(np.arange(len(line)), tiles)
            other = np.arange(len(row)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            own, line = own[row], line[row]
            pair = np.minimum(own, other) * MOST_TILES + np.maximum(own, other)
            place = (n << 32 | position << 2).astype(np.int64)[row] | (own != other) << 1 | (own > other)
            held.append((mix(number[row] ^ mix(pair.astype(np.uint64), M1), M2), sets[line], place, s1[line], s2[line]))
            size += len(row)
            if size > COLLECTED:
                yield from _packed(held, names)
                held, size = [], 0
        if size:
            yield from _packed(held, names)

    return rows.mapInArrow(run, "group long, set binary, place binary, s1 binary, s2 binary")


def _passes(n1, p1, n2, p2, differ) -> np.ndarray:
    """Length, positional and bitmap filters of two postings of one word."""
    least = -(-UP * (n1 + n2) // (UP + DOWN))  # words that must be shared
    shared = 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (DOWN * np.minimum(n1, n2) >= UP * np.maximum(n1, n2)) & (shared >= least) & (differ <= n1 + n2 - 2 * least)


def _in_groups(group: np.ndarray, place: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The order by group and number of words, copies of a set beside each other. One sort while the numbers are small; copies may lie apart then where sets agree in 24 bits."""
    n = place >> 32
    if not len(group) or (group[-1] < 1 << 24 and n.max() < 1 << 16):
        return np.argsort(group.astype(np.uint64) << np.uint64(40) | n.astype(np.uint64) << np.uint64(24) | sets.view(np.uint64) >> np.uint64(40))
    return np.lexsort((sets, place, group))


def candidates(posted: DataFrame) -> DataFrame:
    """Edges (u, v) of sets that pass the filters: a spanning forest of what each task meets."""
    dealt = posted.repartition("group").sortWithinPartitions("group")  # ranges, which hold whole groups; their postings are sorted below

    def near(group, sets, place, s1, s2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that pass, in whole groups, sorted; rows are compared with the s-th after them until lengths part, a step at a time: at most a pair a row is held."""
        n, p, split, side = place >> 32, (place & 0xFFFFFFFF) >> 2, place >> 1 & 1, place & 1
        _, own = np.unique(sets, return_inverse=True)
        root = np.arange(int(own.max()) + 1 if len(own) else 0)
        at, s = np.arange(len(group)), 0
        while len(at):
            s += 1
            at = at[at + s < len(group)]
            to = at + s
            on = (group[at] == group[to]) & (UP * n[to] <= DOWN * n[at])
            at, to = at[on], to[on]
            apart = root[own[at]] != root[own[to]]  # what is linked already needs no other edge
            heads, tails = at[apart], to[apart]
            differ = (np.bitwise_count(s1[heads] ^ s1[tails]).astype(np.int64) + np.bitwise_count(s2[heads] ^ s2[tails])).astype(np.int64)
            ok = _passes(n[heads], p[heads], n[tails], p[tails], differ) & ((split[heads] == 0) | (side[heads] != side[tails]))
            heads, tails = heads[ok], tails[ok]
            if len(heads):
                yield heads, tails
                # Labels only shrink to smaller ones of the same group: a link that they miss costs an edge, no pair is lost.
                low = np.minimum(root[own[heads]], root[own[tails]])
                np.minimum.at(root, root[own[heads]], low)
                np.minimum.at(root, root[own[tails]], low)
                while (root[root] != root).any():
                    root = root[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parent = [], {}
        for batch in batches:
            cols = _unpacked(batch)
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last or held and held[-1][0][-1] != cols[0][0]:
                yield settle([*held, [x[:last] for x in cols]], parent)
                held = []
            held.append([x[last:].copy() for x in cols])
        if held:
            yield settle(held, parent)

    def settle(parts: list[list[np.ndarray]], parent: dict[int, int]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)][1:]
        order = np.argsort(cols[0])
        same = cols[0][order[1:]] == cols[0][order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order  # most groups are of one row
        cols = [c[order] for c in cols]
        group = np.cumsum(np.r_[True, cols[0][1:] != cols[0][:-1]]) - 1 if len(order) else cols[0].view(np.int64)
        order = _in_groups(group, cols[2], cols[1])
        group, sets, place, s1, s2 = group[order], *(c[order] for c in cols[1:])
        again = np.r_[False, (group[1:] == group[:-1]) & (sets[1:] == sets[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])][: len(group)]
        keep = ~again & (np.bincount(group, ~again)[group] > 1) if len(group) else again
        sets = sets[keep]
        steps = near(group[keep], sets, place[keep], s1[keep].view(np.uint64), s2[keep].view(np.uint64))
        if len(parent) > 500_000:
            parent.clear()  # only costs edges

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        kept = []
        for heads, tails in steps:
            for edge in zip(sets[heads].tolist(), sets[tails].tolist(), strict=True):
                x, y = find(edge[0]), find(edge[1])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append(edge)
        ends = np.array(kept, np.int64).reshape(-1, 2)
        return _rows(["u", "v"], ends[:, 0], ends[:, 1])

    return dealt.mapInArrow(run, "u long, v long")


def fetch(rows: DataFrame, sets: DataFrame, seed: int, most: int = 400_000) -> DataFrame:
    """The first line of each set: tiles, component, set, check, doc_id, line_no, key, text.

    ``sets``: set, check, doc_id, line_no and key of the first line, component, tiles. They are broadcast while there are
    at most ``most`` of them, some 60 bytes each, and shuffled beyond.
    """
    columns = ["line_no", "set", "check", "component", "tiles"]
    wanted = sets.groupBy(F.struct("doc_id", "key").alias("_cl_id")).agg(F.collect_list(F.struct(*columns)).alias("wanted"), F.count(F.lit(1)).alias("_cl_n"))
    keyed = rows.withColumn("_cl_key", F.struct("doc_id", F.xxhash64("text").alias("key")))
    met = join_by_id(keyed, wanted, "_cl_key", most, "_cl_n").filter("wanted is not null").select("_cl_key.*", "text", *[f"wanted.{c}" for c in columns])
    schema = "component long, tiles long, set long, check long, doc_id long, line_no long, key long, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(seed=seed), ["component", "tiles", "set", "check", "doc_id", "line_no", "key", "text"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                place, sets, checks, component, tiles = (c.flatten().to_numpy(zero_copy_only=False) for c in part.columns[3:])
                held = part.column(3).value_lengths().to_numpy()
                document = np.repeat(np.arange(part.num_rows), held)
                split = [(t or b"").split(b"\n") for t in part.column(2).to_pylist()]
                lines = [split[d][i] if i < len(split[d]) else b"" for d, i in zip(document.tolist(), place.tolist(), strict=True)]
                _, _, line, plain = reader.read(lines)
                one, two = reader.set_hashes(len(lines), line, plain)
                # Should two texts of one id share a hash, each is asked for the lines of both.
                real = np.flatnonzero((one.view(np.int64) == sets) & (two.view(np.int64) == checks))
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False)[document] for c in (0, 1))
                known = [component, tiles, sets, checks, ids, place, keys]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[real], pa.int64()) for x in known], pa.array([lines[i] for i in real], pa.binary())], names)

    return met.mapInArrow(run, schema)


def shared_counts(line: np.ndarray, word: np.ndarray, m: int, a: np.ndarray, b: np.ndarray, span: int = 4096) -> np.ndarray:
    """How many words each set of ``a`` shares with each of ``b``: exact products over ``span`` words at a time."""
    _, word, often = np.unique(word, return_inverse=True, return_counts=True)
    common = often[word] > 1  # a word of one set alone is shared by no pair
    _, word = np.unique(word[common], return_inverse=True)
    line = line[common]
    order = np.argsort(word, kind="stable")
    line, word = line[order], word[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(word[-1]) + 1 if len(word) else 0, span):
        low, high = np.searchsorted(word, (first, first + span))
        holds = np.zeros((m, span), np.float32)
        holds[line[low:high], word[low:high] - first] = 1
        out += holds[a] @ holds[b].T
    return out


def small_groups(cols: list[np.ndarray], group: np.ndarray, line: np.ndarray, number: np.ndarray) -> list[np.ndarray] | None:
    """What :func:`verify` says of groups of a few sets, all at once: each set is held against the s-th after it, a step at a time. None if the table of who holds which word would be large."""
    sets, check, doc, place, key = cols
    m, n = len(sets), np.bincount(line, minlength=len(sets))
    _, word, often = np.unique(number, return_inverse=True, return_counts=True)
    common = often[word] > 1
    _, word = np.unique(word[common], return_inverse=True)
    line, width = line[common], int(word.max()) + 1 if len(word) else 1
    if m * width > HOLDS:
        return None
    at, holds = line * width + word, np.zeros(m * width, bool)
    holds[at] = True
    rank = np.empty(m, np.int64)
    by_rank = np.lexsort((key, place, doc))
    rank[by_rank] = np.arange(m)
    links, best = np.zeros(m, np.int64), np.full(m, m)
    x, s = np.arange(m), 0
    while True:
        s += 1
        x = x[x + s < m]
        x = x[group[x] == group[x + s]]
        if not len(x):
            break
        on = np.zeros(m, bool)
        on[x] = True
        at, line = at[on[line]], line[on[line]]
        shared = np.bincount(line[holds[at + s * width]], minlength=m)[x]
        ok = (DOWN * shared >= UP * (n[x] + n[x + s] - shared)) & ((sets[x] != sets[x + s]) | (check[x] != check[x + s]))
        for a, b in ((x[ok], x[ok] + s), (x[ok] + s, x[ok])):
            links[a] += 1
            best[a] = np.minimum(best[a], rank[b])
    found = np.flatnonzero(links)
    first = by_rank[best[found]]
    return [sets[found], check[found], links[found], doc[first], place[first], key[first]]


def verify(rows: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """set, check, links, before (struct doc_id, line_no, key of the earliest match) of every set that matches another; ``sets`` as in :func:`fetch`."""
    lines = fetch(rows, sets, seed)
    own = F.pmod(F.xxhash64("set"), "tiles")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = lines.withColumn("own", own).withColumn("other", other).select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set", "check", "doc_id", "line_no", "key", "text"
    )
    dealt = dealt.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "set", "check")
    names = ["set", "check", "links", "before_doc", "before_line", "before_key"]

    def pairs(cols: list[np.ndarray], line: np.ndarray, number: np.ndarray) -> list[tuple]:
        _, low, high, own, sets, check, doc, place, key = cols
        out, m = [], len(sets)
        n = np.bincount(line, minlength=m)
        # Sets of other tiles wait for the pair of tiles that brings both together.
        mine = np.ones(m, bool) if low[0] == high[0] else own == low[0]
        rows_, cols_ = np.flatnonzero(mine), np.arange(m) if low[0] == high[0] else np.flatnonzero(~mine)
        if not len(rows_) or not len(cols_):
            return out
        shared = shared_counts(line, number, m, rows_, cols_)
        ok = DOWN * shared >= UP * (n[rows_][:, None] + n[cols_][None] - shared)
        ok &= (sets[rows_][:, None] != sets[cols_][None]) | (check[rows_][:, None] != check[cols_][None])
        rank = np.empty(m, np.int64)
        rank[np.lexsort((key, place, doc))] = np.arange(m)
        by_rank = np.argsort(rank)
        for a, b, hit in ((rows_, cols_, ok), (cols_, rows_, ok.T))[: 1 + (low[0] != high[0])]:
            links, best = hit.sum(1), np.where(hit, rank[b][None], m).min(1)
            for i in np.flatnonzero(links):
                j = by_rank[best[i]]
                out.append((int(sets[a[i]]), int(check[a[i]]), int(links[i]), int(doc[j]), int(place[j]), int(key[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rest = Reader(seed=seed), None

        def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
            once = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in (*cols[:3], *cols[4:6])])]  # a repeated row brings its lines twice
            cols = [c[once] for c in cols]
            cuts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]]), True])
            found, columns = [], []
            size = np.diff(cuts)
            small = (size <= SMALL) & (cols[1][cuts[:-1]] == cols[2][cuts[:-1]])
            at, last = 0, len(cuts) - 1
            while at < last:  # groups are read together, as many as make about a tile
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + READ, "right")) - 1)
                first = cuts[at]
                _, _, line, number = reader.read([t.replace(b"\n", b" ") for t in cols[9][first : cuts[to]]])
                few = np.repeat(small[at:to], size[at:to])
                mine = few[line]
                own = [c[first : cuts[to]][few] for c in cols[4:9]]
                made = small_groups(own, np.repeat(np.arange(at, to), size[at:to])[few], (np.cumsum(few) - 1)[line[mine]], number[mine]) if mine.any() else None
                if made:
                    columns.append(made)
                ends = np.searchsorted(line, cuts[at : to + 1] - first)
                for k in range(at, to) if not made else at + np.flatnonzero(~small[at:to]):
                    a, b, low, high = cuts[k], cuts[k + 1], *ends[k - at : k - at + 2]
                    if b - a > 1:
                        found += pairs([c[a:b] for c in cols[:9]], line[low:high] - (a - first), number[low:high])
                at = to
            columns.append([np.array([r[i] for r in found], np.int64) for i in range(len(names))])
            return _rows(names, *[np.concatenate(x) for x in zip(*columns, strict=True)])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in rest[:3]]))
            if len(last):
                yield settle([x[: last[-1] + 1] for x in rest])
                rest = [x[last[-1] + 1 :] for x in rest]
        if rest is not None and len(rest[0]):
            yield settle(rest)

    found = dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    before = F.min(F.struct(F.col("before_doc").alias("doc_id"), F.col("before_line").alias("line_no"), F.col("before_key").alias("key"))).alias("before")
    return found.groupBy("set", "check").agg(F.sum("links").alias("links"), before)


def frequent_words(counts: DataFrame, ranked: int) -> list:
    """Of ``counts`` (a, df), all words above the document frequency that leaves at most ``ranked`` of them, rarest first.

    The frequency is found on the histogram of frequencies, so no task sends or sorts more than it keeps.
    """
    left, least = ranked, None
    for row in counts.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).limit(1 << 20).toLocalIterator():
        if row["n"] > left:
            break
        left, least = left - row["n"], row["df"]
    if least is None:
        return []
    return sorted(counts.filter(F.col("df") >= least).collect(), key=lambda r: (r["df"], r["a"]))


def word_table(seen: DataFrame, ranked: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and frequencies of the frequent words, and the bitmap of words that two different sets have: 2^(bits - 3) bytes, whatever the corpus."""
    counts = materialise(word_counts(seen, bits), "lines-words")
    words = frequent_words(counts.filter("df > 0").select("a", "df"), ranked)
    shared = np.zeros((RANGES, 1 << bits - RANGE_BITS - 3), np.uint8)
    for row in counts.filter("df = 0").select("a", "stretch").toLocalIterator():
        shared[row["a"]] = np.frombuffer(row["stretch"], np.uint8)
    return np.array([w["a"] for w in words], np.int64).view(np.uint64), np.array([w["df"] for w in words], np.int64), shared.ravel().view(np.uint64)


def match_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, line_no, n_words, class_doc_id, class_line_no, members, links, kept for every line.

    The class is named by its first line; ``links`` counts the other classes that match it. ``options`` as in :func:`judged_lines`.
    """
    return judged_lines(docs, id_col, text_col, **options).drop("key")


def judged_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranked: int = 200_000, bits: int = 26, tile: int = 1024, verify_tile: int = 512, seed: int = 0
) -> DataFrame:
    """What :func:`match_lines` says, with ``key`` (xxhash64 of the text), which tells rows with one id apart."""
    rows = _texts(in_small_batches(docs), id_col, text_col)
    seen = materialise(survey(rows, seed, bits), "lines-survey")
    lines = seen.filter("kind = -1").select(F.col("a").alias("doc_id"), F.col("b").alias("line_no"), F.col("c").alias("set"), F.col("d").alias("check"), "n", "key")
    top, frequency, shared = word_table(seen, ranked, bits)

    classes = lines.filter("n > 0").groupBy("set", "check").agg(
        F.min(F.struct("doc_id", "line_no", "key")).alias("first"), F.count(F.lit(1)).alias("members"), F.max("n").alias("n")
    )
    classes = materialise(classes, "lines-classes")

    linked = components(candidates(postings(rows, lambda: Reader(top, frequency, shared, seed), tile)), "lines").withColumnRenamed("node", "set")
    sets = materialise(linked.join(classes, "set").select("set", "check", "first.*", "component", "members", "n"), "lines-sets")
    held = sets.groupBy("component").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("words"))
    held = held.select("component", "held", F.greatest(F.ceil(2 * F.col("held") / verify_tile), F.ceil(2 * F.col("words") / TILE_WORDS)).cast("long").alias("tiles"))
    sets = materialise(join_groups(sets.drop("n"), materialise(held, "lines-held"), "component", "held"), "lines-grouped")
    # A class of one line that matches no other says nothing that the line does not know, and stays out of the join.
    known = sets.filter("members = 1").select("set", "check", F.struct("doc_id", "line_no", "key").alias("first"), "members")
    known = known.unionByName(classes.filter("members > 1").select("set", "check", "first", "members"))
    known = known.join(verify(rows, sets, seed), ["set", "check"], "left").filter("members > 1 or links is not null").select(F.struct("set", "check").alias("set"), "first", "members", F.coalesce("links", F.lit(0)).alias("links"), "before")
    known = materialise(known, "lines-known")

    met = join_groups(lines.select("doc_id", "line_no", "key", "n", F.struct("set", "check").alias("set")), known, "set", "members", hashed=True)
    here, known_first = F.struct("doc_id", "line_no", "key"), F.col("first")
    kept = known_first.isNull() | ((here == known_first) & (F.col("before").isNull() | (F.col("before") > known_first)))
    first = F.coalesce(known_first, here)
    known_id = lambda c: F.when(c != LAST, c)
    return met.select(
        known_id(F.col("doc_id")).alias("doc_id"),
        "line_no",
        "key",
        F.col("n").alias("n_words"),
        known_id(F.when(F.col("n") > 0, first["doc_id"])).alias("class_doc_id"),
        F.when(F.col("n") > 0, first["line_no"]).alias("class_line_no"),
        F.coalesce("members", F.lit(1)).alias("members"),
        F.coalesce("links", F.lit(0)).alias("links"),
        (kept | (F.col("n") == 0)).alias("kept"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the lines that go. Rows without an id keep all lines; texts that share an id are judged apart."""
    gone = judged_lines(docs, id_col, text_col).filter("not kept and doc_id is not null")
    gone = gone.groupBy(row_key(F.col("doc_id"), F.col("key")).alias("_cl_id")).agg(F.collect_set("line_no").alias("_cl_gone"), F.count(F.lit(1)).alias("_cl_n"))
    met = join_by_id(docs.withColumn("_cl_key", row_key(F.col(id_col), F.xxhash64(F.col(text_col).cast("binary")))), gone, "_cl_key", 2_000_000, "_cl_n")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_cl_gone", i.cast("long"))), "\n")
    return met.withColumn(text_col, F.when(F.col("_cl_gone").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
