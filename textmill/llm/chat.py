"""Chat formatting (DataFrame expressions only).

A message holds typed content parts. A visitor (one CASE per part) flattens them in order: text is escaped, every other
part becomes a placeholder, and its reference and expanded token count are recorded. The template marks turns:

    <|im_start|>ROLE\\nBODY<|im_end|>\\n

Escaping is a bijection onto texts without "<|": one backslash is added between "<" and "|" of every "<\\...\\|".
In roles, "%" and line feeds are percent-coded too, so that the first line feed of a turn always ends its role.

Defined cases: null text, null role, null part list or null part: empty; an unknown part type: a placeholder of 0 tokens;
null or equal turn numbers: ordered by turn (nulls first), role, body; rows repeat as often as they are given;
a null conv_id is a conversation of its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

START, END = "<|im_start|>", "<|im_end|>"
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: Expanded tokens: one for each image patch of this many pixels a side, these many a second of audio and a page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _kind(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise("unknown")


def _tokens(part: Column) -> Column:
    kind = _kind(part)

    def n(c: str) -> Column:
        return F.greatest(F.coalesce(part[c], F.lit(0)).cast("double"), F.lit(0.0))

    return (
        F.when(kind == "image", F.ceil(n("width") / PATCH) * F.ceil(n("height") / PATCH))
        .when(kind == "audio", F.ceil(n("seconds") * AUDIO_TOKENS))
        .when(kind == "document", n("pages").cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit_text(content: Column) -> Column:
    """The body of a turn: escaped texts and placeholders, in order."""
    return F.array_join(
        F.transform(
            F.coalesce(content, F.array().cast(PART_TYPE)),
            lambda p: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), _kind(p), F.lit("|>"))
            ),
        ),
        "",
    )


def visit_attachments(content: Column) -> Column:
    """The other parts, in the order of their placeholders: kind, reference, expanded tokens."""
    return F.transform(
        F.filter(F.coalesce(content, F.array().cast(PART_TYPE)), lambda p: _kind(p) != "text"),
        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )


def text_parts(text: Column) -> Column:
    """The content of a message that is one plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, content (PART_TYPE). One row per conversation: conv_id, n_turns, formatted,
    loss_spans, attachments, expanded_tokens. A span has its turn, the body's start in the turn and in the whole
    conversation, and its length, all in code points. Only the raw messages are shuffled, once, by conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    turns = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit_text(F.col("content")).alias("body"), visit_attachments(F.col("content")).alias("parts")
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = (
        turns.withColumn("idx", F.row_number().over(order) - 1)
        .withColumn("head_chars", F.length(head))
        .withColumn("turn_chars", (F.col("head_chars") + F.length("body") + len(END) + 1).cast("long"))
        .withColumn("at", F.coalesce(F.sum("turn_chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    row = F.struct(
        "idx",
        F.concat(head, "body", F.lit(END + "\n")).alias("segment"),
        F.col("role").isin(*loss_roles).alias("loss"),
        F.struct(
            F.col("idx").alias("turn"),
            F.col("head_chars").alias("offset"),
            (F.col("at") + F.col("head_chars")).alias("start"),
            F.length("body").alias("length"),
        ).alias("span"),
        "parts",
    )
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select(
            "conv_id",
            F.size("rows").cast("long").alias("n_turns"),
            F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
            F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: r["span"]).alias("loss_spans"),
            F.flatten(F.transform("rows", lambda r: r["parts"])).alias("attachments"),
        )
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations: adds turns (role, text as it was given) and loss_texts (what the mask covers)."""
    segments = let(F.split("formatted", r"<\|im_start\|>", -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
    role = lambda s: F.substring_index(s, "\n", 1)

    def body(s: Column) -> Column:
        return F.substr(s, F.length(role(s)) + 2, F.length(s) - F.length(role(s)) - 2 - len(END))

    return (
        formatted.withColumn("segments", segments)
        .withColumn("turns", F.transform("segments", lambda s: F.struct(unescape_role(role(s)).alias("role"), unescape(body(s)).alias("text"))))
        .withColumn(
            "loss_texts",
            let(
                F.col("segments"),  # a lambda would split the conversation again for every span
                lambda all_of_them: F.transform(
                    "loss_spans", lambda p: unescape(F.substr(F.get(all_of_them, p["turn"]), p["offset"] - len(START) + 1, p["length"]))
                ),
            ),
        )
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, read back from them."""
    return read_back(formatted).select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.aggregate("loss_texts", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
