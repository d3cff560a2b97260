r"""Document fingerprints by winnowing.

A text is lower-cased and cut into tokens: runs of up to 8 letters and digits, of up to 8 other
characters, or single characters of scripts written without spaces. Karp-Rabin hashes modulo
2^31 - 1 roll over every ``k`` = 4 tokens; of each ``w`` = 4 hashes in a row the smallest is chosen,
the rightmost of equal ones. Hash and position lie in one long, hash above and mirrored position
below, so that a plain minimum chooses both. Two texts that share a run of w + k - 1 = 7 tokens
share a chosen hash. Positions are kept in the fingerprint, ``hash@position`` in order.

Hashes and minima over longer spans are made by doubling (pairs, then fours), each pass linear in
the tokens. Everything is DataFrame functions.

Tokens are made of what Java's regular expressions take for letters, marks and digits.

Defined cases: a null text is empty. A text without tokens has the empty fingerprint; one with fewer
than k tokens has the one hash of all of them; one with fewer than w hashes has their minimum. Two
empty fingerprints are alike (1), an empty and another one are not (0). For the order of documents,
rows with equal ids are ordered by text; a row with a null id stands outside the order: it follows
nothing and the empty text follows it. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{1,8}|[^\s\p{L}\p{M}\p{N}]{1,8}"
PRIME, BASE, SPAN = 2**31 - 1, 1_000_003, 2**31
BASE2 = BASE * BASE % PRIME


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``, the chosen (hash, position) longs in order.

    Each pass is a column of its own: a lambda then reads the array before it by position instead
    of making it anew for every element.
    """
    a, b, c, d = (f"{out}_{x}" for x in "abcd")

    def ahead(name: str, by: int, combine):
        return lambda x, i: combine(x, F.coalesce(F.get(F.col(name), i + by), F.lit(0)))

    def first(name: str, less: int) -> Column:
        return F.slice(name, 1, F.greatest(F.size(name) - less, F.lit(0)))

    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(a, F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))))
    df = df.withColumn(b, F.transform(first(a, 1), ahead(a, 1, lambda x, y: (x * BASE + y) % PRIME)))
    few = F.aggregate(a, F.lit(0).cast("long"), lambda x, y: (x * BASE + y) % PRIME)
    fours = F.when(F.size(a) >= 4, F.transform(first(b, 2), ahead(b, 2, lambda x, y: (x * BASE2 + y) % PRIME)))
    df = df.withColumn(c, F.coalesce(fours, F.when(F.size(a) > 0, F.array(few)).otherwise(F.array().cast("array<long>"))))
    df = df.withColumn(c, F.transform(c, lambda x, i: x * SPAN + (SPAN - 1 - i)))
    df = df.withColumn(d, F.transform(first(c, 1), lambda x, i: F.least(x, F.get(F.col(c), i + 1))))
    windows = F.when(F.size(c) >= 4, F.transform(first(d, 2), lambda x, i: F.least(x, F.get(F.col(d), i + 2))))
    one = F.when(F.size(c) > 0, F.array(F.array_min(c))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, F.array_distinct(F.coalesce(windows, one))).drop(a, b, c, d)


def as_text(chosen: str) -> Column:
    return F.array_join(
        F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), (SPAN - 1 - x.bitwiseAND(F.lit(SPAN - 1))).cast("string"))), " "
    )


def hashes(chosen: str) -> Column:
    return F.transform(chosen, lambda x: F.shiftright(x, 31))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two hash sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, positions_hashes for every row: the operator by itself."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", "chosen").select("doc_id", as_text("chosen").alias("fingerprint"), "chosen")


def cuts(ids: DataFrame, per_block: int, most: int, drawn: int = 16) -> list[list[int]]:
    """Bounds that cut the ids into blocks of about ``per_block`` rows, ``most`` blocks at most, as a table of two levels.

    They are quantiles of ``drawn`` ids a block, drawn by hash; any bounds give the same result, good ones even blocks.
    """
    blocks = max(1, min(most, ids.count() // per_block))
    sample = ids.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(blocks * drawn).collect()
    found = sorted({r[0] for r in sample})
    step = max(1, len(found) // blocks)
    bounds = found[step::step]
    width = max(1, round(len(bounds) ** 0.5))
    return [bounds[i : i + width] for i in range(0, len(bounds), width)]


def block_of(doc_id: Column, table: list[list[int]]) -> Column:
    """How many bounds lie at or below the id: the part of the table first, then the place in it."""
    if not table:
        return F.lit(0)
    under = lambda bounds: F.size(F.filter(bounds, lambda x: x <= doc_id))
    heads = F.from_json(F.lit(json.dumps([part[0] for part in table])), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
    before = under(heads)
    return F.when(before == 0, F.lit(0)).otherwise((before - 1) * len(table[0]) + under(F.element_at(parts, F.greatest(before, F.lit(1)))))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_block: int = 64, most_blocks: int = 16_384) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness.

    The next document is the one with the next lower id. Texts are shuffled once, by blocks of about ``per_block``
    documents that follow each other, wherever their ids lie; the first document of a block is sent on to the block above it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = cuts(rows.select("doc_id"), per_block, most_blocks)
    outside = F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("string")
    block = F.when(F.col("doc_id").isNotNull(), block_of(F.col("doc_id"), table).cast("string")).otherwise(F.concat(F.lit("n"), outside))
    dealt = rows.withColumn("block", block).repartition("block")
    order = Window.partitionBy("block").orderBy(F.desc("doc_id"), "text")

    # A row a block, ``most_blocks`` at most, meet in one task; the highest block follows the lowest.
    down = Window.orderBy(F.desc("at"))
    held = rows.filter("doc_id is not null").select(block_of(F.col("doc_id"), table).alias("at")).distinct()
    follow = held.select(F.col("at").cast("string").alias("to"), F.coalesce(F.lead("at").over(down), F.max("at").over(Window.partitionBy())).cast("string").alias("from"))
    firsts = dealt.withColumn("nth", F.row_number().over(order)).filter("nth = 1 and doc_id is not null").select(F.col("block").alias("from"), F.col("text").alias("sent"))
    firsts = with_fingerprint(firsts.join(follow, "from").select(F.col("to").alias("block"), "sent"), "sent", "sent_chosen")

    marked = with_fingerprint(dealt.sortWithinPartitions("block", F.desc("doc_id"), "text"), "text", "chosen")
    marked = marked.withColumn("next", F.lead("text").over(order)).withColumn("next_chosen", F.lead("chosen").over(order))
    joined = marked.join(firsts, "block", "left")
    placed = F.col("doc_id").isNotNull()
    joined = joined.select(
        "doc_id",
        "text",
        "chosen",
        F.length("text").cast("long").alias("n_chars"),
        F.coalesce(F.when(placed, F.coalesce("next", "sent")), F.lit("")).alias("next"),
        F.coalesce(F.when(placed, F.coalesce("next_chosen", "sent_chosen")), F.array().cast("array<long>")).alias("next_chosen"),
    )
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next", F.lit(1), cut))
    joined = with_fingerprint(joined.withColumn("edited", edited), "edited", "edited_chosen")
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("chosen").alias("fingerprint"),
        as_text("edited_chosen").alias("edited_fingerprint"),
        likeness(hashes("chosen"), hashes("edited_chosen")).alias("near_edited"),
        likeness(hashes("chosen"), hashes("next_chosen")).alias("near_next"),
    )
