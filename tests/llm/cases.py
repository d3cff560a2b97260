"""Awkward documents: nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, digest int, _id long, score string, kept string"

SYLLABLES = {"en": "the and ing ed er tion ly ou th sh".split(), "de": "der die und sch ung keit ü ö ä ß".split(), "fr": "le la que é è ê eau oux ment ç".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    parts = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)]
    for i in range(7, words, rng.randint(6, 12)):
        parts[i] += rng.choice([".", ".\n", ","])
    return " ".join(parts)


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i * 7, prose(rng, lang, rng.choice([3, 20, 60, 200])), lang, f"src{i % 4}"))
    rows += [(1000 + k, rows[k][1], rows[k][2], rows[k][3]) for k in range(12)]  # exact copies
    rows += [(1100 + k, rows[k][1].replace(" ", "  \n", 3), None, rows[k][3]) for k in range(6)]  # other white space
    rows += [(1200 + k, rows[k][1] + " end", rows[k][2], None) for k in range(6)]  # near copies
    rows += [(2000, None, None, None), (2001, "", "en", "src0"), (2002, " \n\t ", None, "src1"), (2003, "12 34 !!", "en", "src2")]
    rows += [(None, rows[3][1], "en", "src0"), (None, None, None, None)]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(-3, prose(rng, "en", 20_000), "en", "src1"), (2**62, "日本語のテキスト 中文", None, "src3"), (3000, "é ½ ﬁ \U0001f600 \x00 a", "fr", "src3")]
    return [(*r, len(r[1] or ""), "s", "k", 1, 5, "z", "no") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
