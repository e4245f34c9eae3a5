r"""Conversations as training examples, by a template whose grammar is parsed back.

    conversation  :=  "<s>" turn*
    turn          :=  "[INST] " text " [/INST]"                  of the user
                   |  "[SYS] " text " [/SYS]"                    of the system
                   |  " " text "</s>"                            of the assistant
                   |  "[ROLE] " role " [/ROLE] " text "</s>"     of anyone else

A text must not hold a bare control string. Those are escaped by a backslash behind their first character, and as one
that already has backslashes there gets one more, taking one away gives the text back, whatever it was. A turn is first
rendered as it is and parsed; only if the parser does not give back just that turn is it rendered escaped. What a
conversation's turns join to is parsed once more and compared with its source before it goes out.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN = "<s>"
#: Marks before and behind the text, by role; anyone else's has the role before it.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
ROLE, NAMED, END = "[ROLE] ", " [/ROLE] ", "</s>"
LEARNED = "assistant"

# Each pattern begins with a plain character or set, so that most places of a text fail at once.
_TAILS = (("<", "/?s>"), (r"\[", r"/?(?:INST|SYS|ROLE)\]"))
_BARE = "|".join(f"{lead}{tail}" for lead, tail in _TAILS)
_ESCAPABLE = r"[<\[](?:" + "|".join(rf"(?<={lead})(?=\\*{tail})" for lead, tail in _TAILS) + ")"
_ESCAPED = r"\\(?:" + "|".join(rf"(?<={lead}\\)(?=\\*{tail})" for lead, tail in _TAILS) + ")"
_CLOSED = r"(?<=[\]>])(?<=\[/INST\]|\[/SYS\]|</s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPABLE), F.lit("$0\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit(""))


def _rendered(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(ROLE), role, F.lit(NAMED), text, F.lit(END))
    for name, (before, behind) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), text, F.lit(behind))).otherwise(out)
    return out


def _segments(formatted: Column) -> Column:
    """The turns' renderings, and an empty one behind them if the last is closed."""
    return F.split(F.substr(formatted, F.lit(len(OPEN) + 1)), _CLOSED)


def _turn(segment: Column) -> Column:
    """struct(role, text) of one rendering; both null if it is none."""
    n = F.char_length(segment)

    def read(role: Column, first: Column, last: Column) -> Column:
        inner = F.substr(segment, first, last - first)
        fine = (last >= first) & ~inner.rlike(_BARE)
        return F.when(fine, F.struct(unescaped(role).alias("role"), unescaped(inner).alias("text")))

    named = F.locate(NAMED, segment, len(ROLE) + 1)
    role = F.substr(segment, F.lit(len(ROLE) + 1), named - len(ROLE) - 1)
    other = segment.startswith(ROLE) & segment.endswith(END) & (named > 0) & ~role.rlike(_BARE) & ~role.isin(*MARKS)
    out = F.when(other, read(role, named + len(NAMED), n - len(END) + 1))
    for name, (before, behind) in MARKS.items():
        out = F.when(segment.startswith(before) & segment.endswith(behind), read(F.lit(name), F.lit(len(before) + 1), n - len(behind) + 1)).otherwise(out)
    return F.coalesce(out, F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))


def parse(formatted: Column) -> Column:
    """The turns, an array of struct(role, text), that a formatted conversation holds; nulls where it breaks the grammar."""
    return F.transform(F.filter(_segments(formatted), lambda s: s != ""), _turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    texts = F.transform(F.array(_segments(formatted)), lambda held: F.array_join(F.transform(spans, lambda s: unescaped(F.substr(held[s["turn"]], s["begin"] + 1, s["length"]))), ""))
    return texts[0]


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted and loss_spans (array of turn, begin, start, length) for each conversation of ``rows``.

    A span is the rendered text of one turn of the assistant: ``length`` characters (code points) from the 0-based
    ``start`` of formatted, or from ``begin`` of its ``turn``-th rendering. Turns are taken in order of the turn column;
    null turns come first, ties go by role and text, and rows that are equal in all are all kept. A null text or role
    is an empty one, null conversation ids are one conversation. Roles are taken as they are written ("User" is not
    "user"). An empty table gives an empty one; other columns, whatever their names, are not read.

    One shuffle, by conversation; turns are rendered and checked before it. A conversation is one value, as a training
    example and its digest must be, so it is held by one task and must stay under 2 GB.
    """
    turns = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    as_it_is = _rendered(F.col("role"), F.col("text"))
    given = F.array(F.struct(F.col("role"), F.col("text")))
    kept = parse(F.concat(F.lit(OPEN), as_it_is)) == given
    done = turns.withColumn("piece", F.when(kept, as_it_is).otherwise(_rendered(F.when(F.col("role").isin(*MARKS), F.col("role")).otherwise(escaped(F.col("role"))), escaped(F.col("text")))))
    ordered = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.sum(F.char_length("piece").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    placed = done.select("conv", (F.row_number().over(ordered) - 1).alias("turn"), "role", "piece", F.xxhash64("role", "text").alias("source"), (F.coalesce(before, F.lit(0)) + len(OPEN)).alias("start"))
    head, tail = (len(x) for x in MARKS[LEARNED])
    one = F.struct("turn", "piece", "source", F.when(F.col("role") == LEARNED, F.col("start") + head).alias("start"))
    grouped = placed.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    out = grouped.select(
        "conv", F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"), F.transform("turns", lambda t: t["source"]).alias("sources"),
        F.transform(
            F.filter("turns", lambda t: t["start"].isNotNull()),
            lambda t: F.struct(t["turn"].alias("turn"), F.lit(head).alias("begin"), t["start"].alias("start"), (F.char_length(t["piece"]) - head - tail).alias("length")),
        ).alias("loss_spans"),
    )
    back = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"])) == F.col("sources")
    sure = F.when(back, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back to its turns")).cast("string"))
    return out.select(F.col("conv").alias(conv), sure.alias("formatted"), "loss_spans")
