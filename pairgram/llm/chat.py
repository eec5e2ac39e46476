r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (one string; turns follow each other):

    conversation = turn*
    turn         = "<s>" [ "[INST]" ] level role "\n" text "</s>"
    level        = "0" | "1"

``[INST]`` marks the turns of MARKED roles. Level 0 holds role and text as they
are, level 1 holds them escaped: a backslash is doubled, each control string gets
a backslash after its first character, and a line feed in a role is ``\n``.

Every turn is first rendered at level 0 and reparsed by the grammar; where the
recovered turn differs from the source, or its content holds a control string,
it is rendered at level 1. The joined conversation is then reparsed as a whole
and compared with its source turn by turn (``roundtrip_ok``). At level 1 no content holds a
control string, so a turn ends at the first ``</s>`` and the loop ends there.

Defined cases: null texts and null roles are empty; turns are in the order of
(turn, role, text), so ties and repeated turns are kept in a fixed order; rows
with a null conv_id are one conversation. An empty table gives no conversations.
Input columns other than conv_id, turn, role and text are ignored. A
conversation is one output string and so is gathered in one row, as any training
example is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgram.llm.common import settled

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKED = ("user",)
LOSS = ("assistant",)

TURN_END = "</s>"


def has_control(c: Column) -> Column:
    out = F.lit(False)
    for s in CONTROL:
        out = out | c.contains(s)
    return out


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    """``\\n`` is a line feed unless its backslash is itself escaped; \\x01 keeps doubled backslashes apart."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\\\x01"))
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    c = F.replace(c, F.lit("\\\x01"), F.lit("\\\\"))
    return unescape(c)


def head(role: Column, level: int) -> Column:
    mark = F.when(role.isin(*MARKED), F.lit("<s>[INST]")).otherwise(F.lit("<s>"))
    shown = role if level == 0 else escape_role(role)
    return F.concat(mark, F.lit(str(level)), shown, F.lit("\n"))


def parse_turn(piece: Column) -> Column:
    """One turn without its end mark -> struct(ok, role, text, start): start is where the body begins."""
    marked = piece.startswith("<s>[INST]")
    at = F.when(marked, F.lit(10)).otherwise(F.lit(4))
    level = F.substring(piece, at, F.lit(1))
    line = F.locate("\n", piece)
    role = F.substring(piece, at + 1, F.greatest(line - at - 1, F.lit(0)))
    body = F.substring(piece, line + 1, F.length(piece))
    ok = piece.startswith("<s>") & level.isin("0", "1") & (line > at)
    return F.struct(ok.alias("ok"),
                    F.when(level == "1", unescape_role(role)).otherwise(role).alias("role"),
                    F.when(level == "1", unescape(body)).otherwise(body).alias("text"),
                    line.alias("start"), level.alias("level"))


def pieces(formatted: Column) -> Column:
    """Turns of a formatted string, each without its end mark."""
    parts = F.split(formatted, r"\Q</s>\E")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def reparse(formatted: Column) -> Column:
    return F.transform(pieces(formatted), parse_turn)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Turns with both renderings' parts: ``head, body`` at the level that the round trip asks for."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    plain = settled(turns, piece=F.concat(head(F.col("role"), 0), F.col("text"), F.lit(TURN_END)))
    plain = settled(plain, parsed=reparse(F.col("piece")))
    got = F.element_at("parsed", 1)
    same = (F.size("parsed") == 1) & got["ok"] & (got["role"] == F.col("role")) & (got["text"] == F.col("text"))
    clean = F.coalesce(same, F.lit(False)) & ~has_control(F.col("text")) & ~has_control(F.col("role"))
    return plain.select("conv_id", "turn", "role", "text", F.when(clean, 0).otherwise(1).alias("level"))


def _joined(turns: DataFrame) -> DataFrame:
    """One row per conversation: source turns, the formatted string and the loss mask over it."""
    hard = F.col("level") == 1
    parts = settled(turns, head=F.when(hard, head(F.col("role"), 1)).otherwise(head(F.col("role"), 0)),
                    body=F.when(hard, escape(F.col("text"))).otherwise(F.col("text")))
    # lengths in code points; offsets are running sums in turn order
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = F.length("head") + F.length("body") + len(TURN_END)
    placed = parts.withColumn("_from", F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - whole + F.length("head"))
    placed = placed.withColumn("_nr", F.row_number().over(order))
    got = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "_nr", "role", "text", F.concat("head", "body", F.lit(TURN_END)).alias("piece"), "_from",
        F.length("head").alias("_at"), F.length("body").alias("_len")))).alias("t"))
    return got.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"].isin(*LOSS)),
                    lambda x: F.struct(x["_from"].alias("start"), (x["_from"] + x["_len"]).alias("end"),
                                       (x["_nr"] - 1).alias("turn"), x["_at"].alias("at"))).alias("loss_mask"))


def _checked(joined: DataFrame) -> DataFrame:
    read = settled(joined, recovered=F.transform(reparse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    return read.select("conv_id", "source", "formatted", "loss_mask", (F.col("recovered") == F.col("source")).alias("roundtrip_ok"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask, roundtrip_ok``, one row per conversation.

    loss_mask: code point ranges [start, end) of the bodies of LOSS roles, in order, each
    with its turn (from 0) and the place ``at`` in that turn where it starts.
    """
    return _checked(_joined(turn_rows(conversations))).drop("source")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a trainer reads from ``formatted`` and ``loss_mask`` alone."""
    rows = settled(formatted, pieces=pieces(F.col("formatted")))
    rows = settled(rows, turns=F.transform("pieces", parse_turn))
    # a range is cut out of its turn, so that each turn is scanned once
    rows = settled(rows, under=F.transform("loss_mask", lambda m: F.struct(
        F.substring(F.get("pieces", m["turn"]), m["at"] + 1, (m["end"] - m["start"]).cast("int")).alias("shown"),
        F.get("turns", m["turn"])["level"].alias("level"))))
    loss = F.array_join(F.transform("under", lambda u: F.when(u["level"] == "1", unescape(u["shown"])).otherwise(u["shown"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = settled(rows, loss=loss, said=said)
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "roundtrip_ok")
