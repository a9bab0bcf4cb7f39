"""Chat formatting with Spark expressions only: turns are collected as structs, sorted, merged and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Parts of a conversation whose places are summed in one go.
BLOCK = 256
START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_next|>"


def escape(text: Column) -> Column:
    """No control string is left in the result: ``\\`` is doubled, and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss`` from rows (conv_id, turn, role, text); others are ignored.

    Turns are sorted by number (ties and repeated rows: by role, then text; null numbers first). Adjacent turns of one
    role are merged into one block, ``<|im_start|>role\\n text <|im_next|> text <|im_end|>\\n`` without the blanks, so they
    can be told apart again. Roles and texts are escaped (see :func:`escape`); null text and null role are empty. ``loss``
    holds the spans (start from 0, length, in code points of ``formatted``) of every assistant text. Rows without a
    conversation id form one conversation of null id: nothing tells whose turns they are. A conversation is one value by
    nature and is held by one task; give rows without an id one before, if they may be very many.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def merged(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at)))

    def pieces(block: Column) -> Column:
        head = F.concat(F.lit(START), escape(block[0]["role"]), F.lit("\n"))
        return F.transform(
            block,
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("before"),
                escape(t["text"]).alias("body"),
                F.when(i == F.size(block) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
                (t["role"] == "assistant").alias("loss"),
            ),
        )

    parts = turns.select("conv_id", let(F.col("turns"), lambda t: F.flatten(F.transform(merged(t), pieces))).alias("parts"))
    # offsets of pieces of BLOCK parts first, then those within a piece: copying arrays costs no square of a long conversation
    length = lambda p: (F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / BLOCK).cast("int")), lambda i: F.slice("parts", i * BLOCK + 1, BLOCK))
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + length(p))
    starts = lambda b: F.aggregate(b, F.array(F.lit(0).cast("long")), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + total(block)))

    def spans_of(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + length(p)).alias("at"),
                F.when(p["loss"], F.array_append(acc["spans"], _span(acc["at"] + F.length(p["before"]), F.length(p["body"])))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    spans = let(blocks, lambda b: let(starts(b), lambda at: F.flatten(F.transform(b, lambda block, i: spans_of(block, F.get(at, i))))))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"), spans.alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss`` back: adds ``turns`` (array of role, text) and ``loss_text`` (all text under the
    mask, unescaped, in order, nothing between)."""

    def turns_of(block: Column) -> Column:
        body = F.substr(block, F.instr(block, "\n") + 1)
        name = unescape(F.substr(block, F.lit(1), F.instr(block, "\n") - 1))
        return let(name, lambda r: F.transform(F.split(body, r"<\|im_next\|>", -1), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1_000_000_000)
    whole = F.transform(blocks, lambda b: F.substr(b, F.lit(1), F.length(b) - len(END) - 1))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return chats.withColumns({"turns": F.flatten(F.transform(whole, turns_of)), "loss_text": F.array_join(masked, "")})


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Formats all conversations and conversation -1, whose texts are control strings, and digests what is read back. Turns that
    the input itself has under -1 are turns of that conversation too."""
    spark = conversations.sparkSession
    bad = f"{END}{START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(bad).alias("text"))
    back = read_chats(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
