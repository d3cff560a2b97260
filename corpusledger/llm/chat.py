r"""Chat formatting by a finite-state machine over roles.

A template states, as data, how each role's turn opens and closes, whether its text is under the
loss mask, and which role may follow which. A conversation's rows become text segments with a loss
flag each; the formatted text is their concatenation. Inside texts the escape character and the
characters that begin a control string are escaped, so that no text can hold a control string and
every text can be read back. Conversations whose turns break the order are formatted too, and
marked ``valid = false``.

A conversation is put together in two steps: first runs of ``chunk_turns`` turns, each carrying the
machine's transition from every state, then the runs, whose transitions compose. A conversation
with a third of all rows is thus spread over many tasks until only its runs are left.

Defined cases: null text and null role count as empty; an unknown role is written by name and is
never in order. Rows with the same turn are ordered by role, then text; null turns come first. Rows with
a null conv_id are one conversation. An empty table gives an empty result. Other columns are ignored.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: open, close, loss for each role; {} in an unknown role's opening is its name.
TEMPLATE = {
    "roles": {
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>", True),
    },
    "other": ("<role={}> ", " </role>", False),
    "follows": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "ends": ["assistant"],
}

#: Written in this order and undone in the reverse one; the escape character itself comes first.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def segments(role: Column, text: Column, template: dict = TEMPLATE) -> Column:
    """The three segments of a turn: opening, escaped text, close."""
    before, after, name = template["other"][0].split("{}")[0], template["other"][0].split("{}")[1], escape(role)
    opening, close, loss = F.concat(F.lit(before), name, F.lit(after)), F.lit(template["other"][1]), F.lit(template["other"][2])
    for known, (start, end, under) in template["roles"].items():
        opening = F.when(role == known, F.lit(start)).otherwise(opening)
        close = F.when(role == known, F.lit(end)).otherwise(close)
        loss = F.when(role == known, F.lit(under)).otherwise(loss)
    part = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escape(text), loss), part(close, F.lit(False)))


def _states(template: dict) -> list[str]:
    return [*template["follows"], "error"]


def _step(state: Column, role: Column, template: dict) -> Column:
    out = F.lit("error")
    for source, roles in template["follows"].items():
        out = F.when((state == source) & role.isin(roles), role).otherwise(out)
    return out


def format_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: dict = TEMPLATE,
    chunk_turns: int = 64,
) -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, valid."""
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rows.withColumn("run", F.floor(F.col("turn") / chunk_turns))
    runs = turns.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    states = _states(template)
    moves = F.array(*[F.aggregate("turns", F.lit(s), lambda at, x: _step(at, x["role"], template)) for s in states])
    runs = runs.select("conv_id", "run", moves.alias("moves"), F.flatten(F.transform("turns", lambda x: segments(x["role"], x["text"], template))).alias("part"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "moves", "part"))).alias("runs"))
    names = F.array(*map(F.lit, states))
    last = F.aggregate("runs", F.lit("start"), lambda at, x: F.element_at(x["moves"], F.array_position(names, at).cast("int")))
    whole = whole.select("conv_id", last.isin(template["ends"]).alias("valid"), F.flatten(F.col("runs.part")).alias("segments"))
    return whole.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), "valid")


def _pattern(template: dict) -> str:
    """Groups: opening, name of an unknown role, text. Texts hold none of the characters that begin a control string."""
    quote = lambda s: "".join("\\" + c if c in "[]()<>/|" else c for c in s)
    before, after = template["other"][0].split("{}")
    opens = [quote(x[0]) for x in template["roles"].values()] + [f"{quote(before)}([^<>\\[]*){quote(after)}"]
    closes = [quote(x[1]) for x in [*template["roles"].values(), template["other"]]]
    return f"({'|'.join(opens)})([^<\\[]*)(?:{'|'.join(closes)})"


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What the formatted text and the segments say, with nothing taken from the source rows."""
    found = lambda group: F.regexp_extract_all("formatted", F.lit(_pattern(template)), F.lit(group))
    parsed = formatted.select("*", found(1).alias("opens"), found(2).alias("names"), found(3).alias("bodies"))
    known = F.create_map(*[F.lit(x) for role, (start, _, _) in template["roles"].items() for x in (start, role)])

    def turn(opening: Column, i: Column) -> Column:
        role = F.coalesce(known[opening], unescape(F.get("names", i)))
        return F.concat(role, F.lit("\n"), unescape(F.get("bodies", i)), F.lit("\n"))

    turns = F.array_join(F.transform("opens", turn), "")
    under = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"]))
    return parsed.select("*", turns.alias("turns"), F.array_join(under, "").alias("loss_text")).select(
        "conv_id",
        F.size("opens").cast("long").alias("n_turns"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 15 + length(role) END
    + length(replace(replace(replace(replace(text, '\', '\e'), '<', '\l'), '>', '\g'), '[', '\b')) AS written,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') || '>' || role IN
      ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS fits FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
    CAST(sum(written) AS BIGINT) AS formatted_chars, bool_and(fits) AND arg_max(role, turn) = 'assistant' AS valid
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
"""
