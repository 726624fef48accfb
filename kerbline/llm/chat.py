r"""Chat formatting, in DataFrame functions only.

A conversation becomes ``<|im_start|>role\ntext<|im_end|>\n`` for every run of
adjacent turns of one role; texts of a run are joined by ``<|turn|>`` and so can be
told apart again. In texts and roles ``<|`` is never left standing: ``<``, k stars
and ``|`` become ``<``, k + 1 stars and ``|``, which undoes without loss; a line end in a
role becomes ``<|nl|>``.

The formatted string comes in blocks, which joined are the whole: a run of turns, or ``BLOCK_TURNS`` of them
where it is longer, so that work stays linear in a run's length. The loss mask lists for each block
the spans, in code points of its string, of assistant texts; separators and headers are outside.

Defined results: null text and null role count as empty; turns are sorted by
turn, role, text, nulls first, so repeated turns have a fixed order; rows of a null
conv_id form one conversation; texts may be of any length; an empty table gives no rows. Other columns are
ignored, whatever their names. One conversation is one string, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END, TURN, NEWLINE = "<|im_start|>", "<|im_end|>", "<|turn|>", "<|nl|>"

BLOCK_TURNS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\**)\|", r"<*$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\*(\**)\|", r"<$1|")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, blocks array<struct<text, loss array<struct<start, chars>>>>, formatted."""
    empty = F.lit("")
    row = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_t"))
    changes = lambda i: F.element_at("_t", i)["role"] != F.element_at("_t", F.greatest(i - 1, F.lit(1)))["role"]
    chats = chats.withColumn("_heads", F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (i % BLOCK_TURNS == 0) | changes(i)))
    stop = lambda i: F.coalesce(F.get("_heads", i + 1), F.size("_t") + 1)
    runs = F.transform(
        "_heads",
        lambda h, i: F.struct(
            F.element_at("_t", h)["role"].alias("role"),
            F.transform(F.slice("_t", h, stop(i) - h), lambda t: escape(t["text"])).alias("texts"),
            ((h == 1) | changes(h)).alias("first"),
            ((stop(i) > F.size("_t")) | changes(F.least(stop(i), F.size("_t")))).alias("last"),
        ),
    )
    chats = chats.withColumn("_runs", runs)

    def block(run: Column) -> Column:
        head = F.when(run["first"], F.concat(F.lit(START), F.regexp_replace(escape(run["role"]), "\n", NEWLINE), F.lit("\n"))).otherwise(TURN)
        text = F.concat(head, F.array_join(run["texts"], TURN), F.when(run["last"], END + "\n").otherwise(""))
        ends = F.aggregate(
            run["texts"],
            F.struct(F.length(head).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x) + len(TURN)).alias("at"),
                F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(x).alias("chars")))).alias("spans"),
            ),
        )["spans"]
        return F.struct(text.alias("text"), F.when(run["role"] == "assistant", ends).otherwise(F.array().cast("array<struct<start:int,chars:int>>")).alias("loss"))

    chats = chats.withColumn("blocks", F.transform("_runs", block))
    return chats.select("conv_id", "blocks", _joined(F.transform("blocks", lambda b: b["text"])).alias("formatted"))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)  # before the first mark there is nothing

    def turns(chunk: Column) -> Column:
        role = unescape(F.regexp_replace(F.substring_index(chunk, "\n", 1), r"<\|nl\|>", "\n"))
        body = F.substring_index(F.regexp_replace(chunk, r"\A[^\n]*\n", ""), END, 1)
        return F.transform(F.split(body, r"<\|turn\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(chunks, turns))


def loss_texts(blocks: Column) -> Column:
    """The texts under the loss mask, unescaped, cut from the formatted blocks by their spans."""
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["loss"], lambda s: unescape(F.substring(b["text"], s["start"] + 1, s["chars"])))))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's figures, read back from the formatted output and its mask."""
    read = chats.select("conv_id", parse_formatted(F.col("formatted")).alias("t"), _joined(loss_texts(F.col("blocks"))).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = _joined(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
