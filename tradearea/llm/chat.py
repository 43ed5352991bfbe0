"""Chat formatting: typed content parts become one marked text per conversation, and back.

A turn is a list of parts (kind, text, ref, units). A visitor turns each part into text: text parts are
escaped; image, audio and document parts become a numbered placeholder, their reference is recorded, and the
placeholder counts as so many tokens as the attachment will expand to. Everything is column
expressions, one row per conversation in the end.

Escaping puts a backslash behind the first character of each control string and doubles every backslash,
so no control string stands in escaped text and dropping the backslashes gives the text back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: whatever these begin is a control string: turn marks, placeholders, and the marks of other common templates
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"
#: tokens that one unit of an attachment expands to: image tiles, seconds of audio, document pages
TOKENS_PER_UNIT: dict[str, int] = {"image": 256, "audio": 25, "document": 600}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """An escaped role on one line: a line feed becomes a backslash and n, which escaped text has nowhere else."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A backslash and n is a line feed if an even number of backslashes stands before it."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """The text that a part leaves: escaped text, or the placeholder <|kind|>."""
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), F.regexp_replace(part["kind"], r"[|<>\\]", "_"), F.lit("|>")))


def expanded(part: Column, per_unit: Mapping[str, int] = TOKENS_PER_UNIT) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text and 1 for kinds without a rate."""
    rates = F.create_map(*[F.lit(x) for pair in per_unit.items() for x in pair])
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    return F.when(is_text(part), F.lit(0)).otherwise(
        F.coalesce(F.try_element_at(rates, part["kind"]) * units, F.lit(1))).cast("bigint")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
              per_unit: Mapping[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: conv, formatted, attachments (in order: turn number, kind, ref, tokens), attachment_tokens.

    `parts` is an array of (kind, text, ref, units). Turns go by number (null first), then role, then text. A null role is
    empty, a turn without parts has empty text, rows that repeat a turn are turns of their own. A null
    conversation id is a conversation. Other columns are passed over; an empty table gives no rows.
    """
    own = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    body = F.array_join(F.transform(own, visit), "")
    named = F.filter(F.transform(own, lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p, per_unit).alias("tokens"))), lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")
    said = F.coalesce(F.col(role), F.lit(""))
    marked = F.concat(F.lit(BEGIN), escape_role(said), F.lit("\n"), body, F.lit(END))
    # ties go by the text itself: escaping changes the order
    plain = F.array_join(F.transform(own, lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(""))), "")
    rows = turns.select(F.col(conv).alias("_conv"), F.struct(
        F.col(turn).alias("t"), said.alias("r"), plain.alias("p"), marked.alias("m"), named.alias("a")).alias("_x"))
    grouped = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_x")).alias("_turns"))
    attachments = F.flatten(F.transform("_turns", lambda x, i: F.transform(x["a"], lambda a: F.struct(
        i.cast("bigint").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = grouped.select(
        F.col("_conv").alias(conv), F.array_join(F.transform("_turns", lambda x: x["m"]), "").alias("formatted"), attachments.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.slice(F.split(text, r"<\|im_end\|>\n", -1), 1, F.size(F.split(text, r"<\|im_end\|>\n", -1)) - 1)

    def one(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(BEGIN) + 1), F.length(piece))
        head = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substring(inner, F.length(head) + 2, F.length(inner))).alias("text"))

    return F.transform(pieces, one)


def loss_text(turns: Column, trained: str = "assistant") -> Column:
    """All text under the loss mask: that of the trained role, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == trained), lambda t: t["text"]), "")
