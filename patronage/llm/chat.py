"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role "\\n" body "\\n</turn>\\n"

``### `` and ``</turn>`` are control strings.  In a body one that has backslashes
directly before it is text, and the parser takes one of them away; a bare one is an
error, and the parser gives no text for its turn.  A turn is first rendered as it is and
parsed again; only if the parser does not give back exactly that turn, each control
string in it gets one more backslash.  Roles are kept on one line by percent codes.

Defined results: NULL text or role counts as empty; turns sort by turn, role and text,
NULL turn first; rows with NULL conv_id are one conversation; repeated rows, and rows
that tie in all of these, are turns of their own; very long texts are rendered whole; no
rows give no conversations.  Only the four named columns are read.

A conversation is one value, so all of it meets in one row: the digest of a whole
conversation has to read it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, END = "### ", "</turn>"
CONTROL = r"(### |</turn>)"
BARE = r"(?<!\\)" + CONTROL
TURN_END = r"(?<!\\)</turn>\n"
LOSS_ROLE = "assistant"
CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("#", "%23"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def _coded(role: Column) -> Column:
    for plain, code in CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _decoded(role: Column) -> Column:
    for plain, code in reversed(CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, ``array<struct<role, text>>``, by its grammar."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 2)
        return F.struct(
            _decoded(F.substring(head, len(HEAD) + 1, F.length(head))).alias("role"),
            F.when(~body.rlike(BARE), unescape(body)).alias("text"),
        )

    pieces = F.split(formatted, TURN_END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), _coded(role), F.lit("\n"), body, F.lit(f"\n{END}\n"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, round_trip.

    ``loss_spans`` are (start, length) in bytes of the UTF-8 text, in order: the bodies
    of the assistant's turns.  ``round_trip`` tells that the parser gave back the turns.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = parse(_render(F.col("role"), F.col("text")))
    same = (F.size(plain) == 1) & F.element_at(plain, 1).eqNullSafe(F.struct("role", "text"))
    turns = turns.withColumn("body", F.when(same, F.col("text")).otherwise(escape(F.col("text"))))
    turns = turns.withColumn("piece", _render(F.col("role"), F.col("body")))

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0))
    )
    head = F.octet_length(F.concat(F.lit(HEAD), _coded(F.col("role")), F.lit("\n")))
    span = F.struct(
        (F.col("start") + head).alias("start"), F.octet_length("body").cast("long").alias("length")
    )
    turns = turns.withColumn("span", F.when(F.col("role") == LOSS_ROLE, span))
    conversations = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "piece", "span"))).alias("t")
    )
    conversations = conversations.withColumn(
        "formatted", F.array_join(F.transform("t", lambda t: t["piece"]), "")
    )
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        "formatted",
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias(
            "loss_spans"
        ),
        (parse(F.col("formatted")) == source).alias("round_trip"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped.  Bytes are cut in time of the cut's length."""
    data = F.encode(formatted, "UTF-8")
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")
            ),
        ),
        "",
    )


def digest(conversations: DataFrame) -> DataFrame:
    """Figures read back from the formatted text and its mask."""
    turns = parse(F.col("formatted"))
    whole = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = conversations.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "round_trip",
    )
