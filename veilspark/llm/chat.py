"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted, adjacent turns of one role are merged with array functions, and the pieces
are concatenated.  A long conversation is first formatted in chunks of consecutive turn numbers, so that its rows
needn't meet before they are text.

The format: ``### <role>: <text></turn>`` and a line end for each merged turn; ``<+>`` stands between the texts
that were merged.  Inside roles and texts the three characters that control strings are made of are escaped:
``\\`` as ``\\\\``, ``#`` as ``\\h``, ``<`` as ``\\l``, and in roles ``:`` as ``\\c``.  So no control string can
occur in a text, and undoing the escapes gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only
from .quality import once

OPEN, NAMED, NEXT, CLOSE = "### ", ": ", "<+>", "</turn>\n"
#: Turn numbers in a chunk of a conversation, and runs in a block of a mask.
CHUNK = 128


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask: one row per conversation.

    mask is the loss mask as runs, array<struct<chars, learn>>: their lengths in code points add up to the
    formatted text, and learn is true for the texts of the role ``learn``, without markers.  A null role or text is
    empty; null turn numbers come first; equal turn numbers are ordered by role, then text, and repeated rows stay.
    Rows without a conversation id form one conversation.  Further columns are left out; no rows give no rows.
    """
    rows = only(turns, conv_col, turn_col, role_col, text_col).toDF("c", "t", "role", "text")
    rows = rows.select("c", "t", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = rows.groupBy("c", F.floor(F.col("t") / CHUNK).alias("part")).agg(F.sort_array(F.collect_list(F.struct("t", "role", "text"))).alias("ts"))
    ts = F.col("ts")

    def piece(x: Column, i: Column) -> Column:
        """Marker and escaped text of a turn; the chunk's first marker is left to the joining of chunks."""
        before = F.get(ts, i - 1)["role"]
        head = F.concat(F.lit(CLOSE + OPEN), escaped_role(x["role"]), F.lit(NAMED))
        mark = F.when(i == 0, F.lit("")).when(before == x["role"], F.lit(NEXT)).otherwise(head)
        return F.struct(mark.alias("mark"), escaped(x["text"]).alias("text"), (x["role"] == learn).alias("learn"))

    part = part.select("c", "part", F.get(ts, F.lit(0))["role"].alias("first"), F.get(ts, F.size(ts) - 1)["role"].alias("last"), F.transform(ts, piece).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: F.concat(p["mark"], p["text"])), "")
    runs = F.flatten(F.transform("ps", lambda p: F.array(run(F.length(p["mark"]), F.lit(False)), run(F.length(p["text"]), p["learn"]))))
    part = part.select("c", F.struct("part", "first", "last", body.alias("body"), runs.alias("runs")).alias("p"))
    whole = part.groupBy("c").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    ps = F.col("ps")

    def joined(p: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escaped_role(p["first"]), F.lit(NAMED))
        mark = F.when(F.coalesce(F.get(ps, i - 1)["last"] == p["first"], F.lit(False)), F.lit(NEXT)).otherwise(head)
        return F.struct(mark.alias("mark"), p["body"].alias("body"), p["runs"].alias("runs"))

    whole = whole.select("c", F.transform(ps, joined).alias("js"))
    text = F.concat(F.array_join(F.transform("js", lambda j: F.concat(j["mark"], j["body"])), ""), F.lit(CLOSE))
    mask = F.concat(F.flatten(F.transform("js", lambda j: F.concat(F.array(run(F.length(j["mark"]), F.lit(False))), j["runs"]))), F.array(run(F.lit(len(CLOSE)), F.lit(False))))
    return whole.select(F.col("c").alias(conv_col), text.alias("formatted"), mask.alias("mask"))


def run(chars: Column, learn: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), learn.alias("learn"))


def read_back(formatted: DataFrame, *, conv_col: str = "conv_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and learned array<string>, as the formatted text and mask say.

    The mask is followed in blocks of runs, each with its own piece of the text: work grows with the text, not with
    its square.  No rows give no rows."""
    marked = F.filter(F.split("formatted", r"</turn>\n", -1), lambda s: s != "")

    def turns(s: Column) -> Column:
        role = F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), NAMED, 1)
        texts = F.split(F.substr(s, F.length(role) + len(OPEN) + len(NAMED) + 1), r"<\+>", -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    def step(s: Column, r: Column) -> Column:
        end = s["at"] + r["chars"]
        return F.struct(end.alias("at"), F.when(r["learn"], F.array_append(s["spans"], F.struct(s["at"].alias("at"), r["chars"].alias("chars")))).otherwise(s["spans"]).alias("spans"))

    none = F.array().cast("array<struct<at:int,chars:int>>")
    numbers = F.sequence(F.lit(0), F.floor((F.size("mask") - 1) / CHUNK).cast("int"))
    blocks = F.transform(numbers, lambda j: F.aggregate(F.slice("mask", j * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def starts(bs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(bs, first, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])

    def texts(b: Column, start: Column) -> Column:
        piece = F.substr(F.col("formatted"), start + 1, b["at"])
        return once(piece, lambda t: F.transform(b["spans"], lambda p: unescaped(F.substr(t, p["at"] + 1, p["chars"]))))

    learned = once(blocks, lambda bs: once(starts(bs), lambda st: F.flatten(F.transform(bs, lambda b, i: texts(b, F.get(st, i))))))
    return formatted.select(F.col(f"`{conv_col}`"), *keep, F.flatten(F.transform(marked, turns)).alias("turns"), learned.alias("learned"))
