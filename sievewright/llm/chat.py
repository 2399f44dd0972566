"""Chat formatting with typed content parts, in DataFrame expressions only.

A message's content is an ordered list of typed parts (text, image, audio, document). A visitor flattens
the parts in order: text parts are escaped and written out, every other part becomes a numbered placeholder,
its reference is recorded as an attachment and its expanded token count is kept. A conversation becomes one
string plus the code-point spans of its loss mask; ``read_turns`` parses that string again.

Template: ``### <role>: <body></turn>\n`` per turn, placeholders ``<image:0>``. Inside roles, texts and
references the four control characters are replaced (``\\`` to ``\\s``, ``#`` to ``\\h``, ``<`` to ``\\l``, ``:``
in roles to ``\\c``), so that no control string can occur in escaped text and escaping is undone exactly.

Defined cases: null text is empty; a null role is the empty role; null or unknown part types are treated as
documents; a message with null parts has an empty body; turns that repeat keep all their rows, ordered by
(turn, role, body), null turns first; rows with a null conversation id form one conversation; an empty table
gives an empty result; extra columns are ignored. A conversation is one record and is formatted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
MODEL_ROLE = "assistant"
#: Tokens that one placeholder expands to, where a part does not carry its own count.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART_TYPE = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\c"), F.lit(":")))


def text_part(c: Column) -> Column:
    """The parts of a message that is only text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(c, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", *PART_TOKENS), p["kind"]).otherwise("document")


def flatten_parts(parts: Column) -> Column:
    """Visit the parts in order: ``struct(body, attachments, tokens)``; attachments keep ordinal, kind, ref and tokens."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>"))
    media = F.filter(parts, lambda p: _kind(p) != "text")
    expand = F.create_map(*[F.lit(x) for kv in PART_TOKENS.items() for x in kv])
    attachments = F.transform(
        media,
        lambda p, i: F.struct(i.alias("ordinal"), _kind(p).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], expand[_kind(p)]).alias("tokens")),
    )
    # the ordinal of a media part is the number of media parts before it
    pieces = F.transform(
        parts,
        lambda p, i: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), _kind(p), F.lit(":"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: _kind(q) != "text")).cast("string"), F.lit(">"))
        ),
    )
    return F.struct(
        F.array_join(pieces, "").alias("body"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def format_conversations(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``key, n_turns, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are (start, length) pairs of code points, start from 0, over the body of every model turn.
    """
    flat = df.select(F.col(key), F.col(order).alias("turn"), escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"), flatten_parts(F.col(parts)).alias("flat"))
    head = lambda t: F.concat(F.lit("### "), t["role"], F.lit(": "))
    turn = F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"), F.col("flat.tokens").alias("tokens"))
    convs = flat.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # running (offset, spans) over the turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, t: F.struct(
        (a["at"] + F.char_length(head(t)) + F.char_length(t["body"]) + F.lit(len(END))).alias("at"),
        F.when(t["role"] == MODEL_ROLE, F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(head(t))).alias("start"), F.char_length(t["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    return convs.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Parse a formatted conversation: an array of ``struct(role, text)``, unescaped, in order."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(F.substr(b, F.lit(5)), ": ", 1)).alias("role"),
            unescape(F.substr(b, F.instr(b, ": ") + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
