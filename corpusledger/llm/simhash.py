"""SimHash near-duplicates, linked by a forest of vantage-point trees.

Fingerprint: A-Z are lower-cased, words are runs of anything but ASCII white space, and every
3-word shingle, repeats included, is hashed by XXH64 with seed 42. A bit is set when it is set in
more than half of the hashes. Texts with fewer words have one shingle, texts without words the
fingerprint zero, which links like any other.

Two fingerprints link when they differ in at most ``radius`` = 3 bits. The 64 bits are cut into
``blocks`` = 4; each has its own tree over the Hamming distance within the block, a pseudo-metric. Of
two linked fingerprints at least one block differs in at most rho = radius // blocks = 0 bits, so a ball of
that radius in the tree of that block meets the other one. A node keeps one vantage point, drawn
from a bounded sample of ``pool`` fingerprints, and one branch per distance to it. By the triangle
bound a ball reaches only the branches from d - rho to d + rho, here one of 17: the others are pruned. A fingerprint
lives in one leaf, that is shard, and is sent as a query to the shards across each boundary that its ball overlaps; a
ball of radius 0 overlaps none, so a fingerprint is a row a tree, whatever the depth. ``FULL_DEPTH`` levels part
nearly all values of a block.

With fewer blocks rho is larger: two blocks have rho = 1, a ball reaches three of 33 branches, and of two linked
fingerprints in different shards one query is enough, so only shards after the own one, in the order of
their distances, are queried, (3^depth - 1) / 2 a tree; the depth then follows the number of fingerprints, a level for
each factor of about ten beyond ``tile``. One block is the plain tree over whole fingerprints with rho = 3, which prunes
less, as distances of unrelated fingerprints crowd around 32. All choices give the same pairs.

Inside a leaf all pairs are compared on whole fingerprints; only a spanning forest of the links is
emitted. A leaf of more than ``tile`` fingerprints is cut into tiles, and pairs of tiles are dealt
out as tasks of their own. Links become components by star passes over the distributed edges.

Defined cases: a null text is empty. Rows that repeat are linked to each other. A row with a null id
gets its fingerprint, links nothing, and belongs to the component of its fingerprint, null if there
is none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusledger.llm.common import components, in_small_batches, join_by_id, join_groups
from corpusledger.runtime import materialise

SEED = 42
SHINGLE = 3
FULL_DEPTH = 10


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py() or b"") for x in batch.column(1)]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Routing of fingerprints through the trees of all blocks."""

    def __init__(self, pool: list[int], blocks: int, radius: int, depth: int):
        self.pool = np.array(pool or [0], np.int64).view(np.uint64)
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.masks = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.rho, self.depth = radius // blocks, depth

    def route(self, fps: np.ndarray, tree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, leaf, home): each fingerprint's own leaf, then every later leaf that its ball overlaps."""
        mask = self.masks[tree]
        rows, leaves, home = np.arange(len(fps)), np.full(len(fps), tree, np.uint64), np.ones(len(fps), bool)
        for level in range(self.depth):
            mixed = (leaves ^ np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
            vantage = self.pool[((mixed >> np.uint64(32)) % np.uint64(len(self.pool))).astype(np.int64)]
            distance = np.bitwise_count((fps[rows] ^ vantage) & mask).astype(np.int64)
            parts = []
            for step in range(-self.rho, self.rho + 1):
                at = distance + step
                # Before its first step off the own path a query goes only to greater distances.
                ok = (at >= 0) & (at <= 64) & ~(home & (step < 0))
                parts.append((rows[ok], leaves[ok] * np.uint64(65) + at[ok].astype(np.uint64), home[ok] & (step == 0)))
            rows, leaves, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        return rows, leaves, home


def _links(fps: np.ndarray, home: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one leaf by breadth-first search; memory linear in its rows.

    Links count between rows of which one at least is at home; of a pair of tiles, between its sides.
    """
    rest, out, split = np.arange(len(fps)), [], side.min() != side.max()
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = (np.bitwise_count(fps[rest] ^ fps[at]) <= radius) & (home[rest] | home[at])
            if split:
                near &= side[rest] != side[at]
            if near.any():
                found = rest[near].tolist()
                out += [(at, x) for x in found]
                queue += found
                rest = rest[~near]
    return out


def _small_links(leaf: np.ndarray, fps: np.ndarray, home: np.ndarray, side: np.ndarray, split: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for many small leaves at once, sorted by leaf: compare each row with the s-th after it."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out, at, s = [], np.arange(len(leaf)), 0
    while len(at):
        s += 1
        at = at[at + s < len(leaf)]
        at = at[leaf[at] == leaf[at + s]]
        to = at + s
        near = (np.bitwise_count(fps[at] ^ fps[to]) <= radius) & (home[at] | home[to]) & (~split[at] | (side[at] != side[to]))
        for a, b in zip(at[near].tolist(), to[near].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def levels(fingerprints: int, tile: int) -> int:
    """Depth of the trees: a level parts unrelated fingerprints about tenfold."""
    depth = 1
    while fingerprints > tile * 10**depth:
        depth += 1
    return depth


def links(distinct: DataFrame, radius: int = 3, blocks: int = 4, depth: int | None = None, pool: int = 1024, tile: int = 4096) -> DataFrame:
    """Edges (u, v) between the ``rep`` ids of linked fingerprints: a forest per leaf, none lost."""
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(pool).select("fp").collect()]
    # A ball of radius 0 is in one branch: levels cost no rows, and so many tell nearly all values of a short block apart.
    forest = Forest(sample, blocks, radius, depth or (levels(distinct.count(), tile) if radius // blocks else FULL_DEPTH))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, fps = (np.asarray(x) for x in batch.columns)
            for tree in range(blocks):
                rows, leaves, home = forest.route(fps.view(np.uint64), tree)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves.view(np.int64)), pa.array(reps[rows]), pa.array(fps[rows]), pa.array(home)], ["leaf", "rep", "fp", "home"]
                )

    routed = materialise(distinct.select("rep", "fp").mapInArrow(route, "leaf long, rep long, fp long, home boolean"), "simhash-routed")
    held = materialise(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > tile), "simhash-hot")
    tiles = F.ceil(F.coalesce("held", F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    shard = join_groups(routed, held, "leaf", "held").select("*", tiles.alias("tiles"), own.alias("own"))
    shard = shard.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "fp", "home"
    )
    dealt = shard.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
            leaf, low, high, own, rep, fp, home = cols
            fps, split = fp.view(np.uint64), low != high
            starts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            sizes = np.diff(np.r_[starts, len(leaf)])
            group, big, pairs = np.repeat(np.arange(len(starts)), sizes), sizes > 64, []
            for start, size in zip(starts[big], sizes[big], strict=True):
                s = slice(start, start + size)
                pairs += [(a + start, b + start) for a, b in _links(fps[s], home[s], own[s], radius)]
            few = np.flatnonzero(~big[group])
            pairs += [(few[a], few[b]) for a, b in _small_links(group[few], fps[few], home[few], own[few], split[few], radius)]
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rep[ends[:, 0]]), pa.array(rep[ends[:, 1]])], ["u", "v"])

        for batch in batches:
            cols = [np.asarray(x.to_numpy(zero_copy_only=False)) for x in batch.columns]
            kept = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]) | (kept[2] != kept[2][-1]))
            if len(last) and len(kept[0]) >= 50_000:
                cut = int(last[-1]) + 1
                yield settle([x[:cut] for x in kept])
                kept = [x[cut:] for x in kept]
        if kept is not None and len(kept[0]):
            yield settle(kept)

    return dealt.mapInArrow(link, "u long, v long").filter("u != v")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 4, depth: int | None = None, tile: int = 4096
) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    return _judged(docs, id_col, text_col, radius, blocks, depth, tile).drop("component_fingerprint")


def _judged(docs: DataFrame, id_col: str, text_col: str, radius: int = 3, blocks: int = 4, depth: int | None = None, tile: int = 4096) -> DataFrame:
    """With the smallest fingerprint that the component's document has."""
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash-fps")
    groups = fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
    groups = materialise(groups, "simhash-groups")
    # Fingerprints are the nodes: an id may have several.
    linked = components(links(groups.select("fp", F.col("fp").alias("rep")), radius, blocks, depth, tile=tile), "simhash").withColumnRenamed("node", "fp")
    linked = materialise(groups.join(linked, "fp"), "simhash-linked")
    best = linked.groupBy("component").agg(F.min(F.struct("first", "fp")).alias("best"), F.count(F.lit(1)).alias("held"))
    met = join_groups(linked.select("fp", "component"), materialise(best, "simhash-best"), "component", "held").select("fp", "best")
    merged = groups.join(met, "fp", "left").select("fp", "members", F.coalesce("best", F.struct("first", "fp")).alias("best"))
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return join_groups(fps, materialise(merged, "simhash-merged"), "fp", "members").select(
        "doc_id", shown("fp").alias("fingerprint"), F.col("best.first").alias("component_id"), shown("best.fp").alias("component_fingerprint")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns. Rows without an id stay.

    An id that has several fingerprints is judged by each: of a component stay the rows of its smallest id that have its
    smallest fingerprint there.
    """
    made = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text").filter("doc_id is not null")
    made = made.withColumn("stays", F.expr("doc_id = component_id and fingerprint = component_fingerprint"))
    made = materialise(made.groupBy("doc_id", "fingerprint").agg(F.max("stays").alias("stays")), "simhash-decisions")
    rows = made.groupBy(F.col("doc_id").alias("_cl_id")).agg(F.max("stays").alias("_cl_stays"), (F.count(F.lit(1)) > 1).alias("_cl_many"))
    marked = join_by_id(docs, rows.filter("_cl_many or not _cl_stays").drop("_cl_stays"), id_col)
    stay = marked.filter("_cl_many is null").select(*docs.columns)
    many = rows.filter("_cl_many").select(F.col("_cl_id").alias("doc_id"))
    if many.isEmpty():
        return stay
    kept = made.filter("stays").join(many, "doc_id").select(F.struct("doc_id", "fingerprint").alias("_cl_id"), F.col("stays").alias("_cl_stays"))
    again = with_fingerprints(marked.filter("_cl_many").drop("_cl_many"), text_col)
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.lpad(F.hex("_cl_fp"), 16, "0")).alias("fingerprint"))
    return stay.unionByName(join_by_id(again.withColumn("_cl_key", key), kept, "_cl_key").filter("_cl_stays").select(*docs.columns))


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their fingerprint beside, as ``_cl_fp``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.encode() if x else b"") for x in batch.column(place).to_pylist()], np.uint64).view(np.int64)
            yield batch.append_column("_cl_fp", pa.array(fps))

    return in_small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("_cl_fp", LongType())]))
