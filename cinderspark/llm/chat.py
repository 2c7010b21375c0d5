"""Chat formatting with Spark expressions only.

Template: every run of turns of one role is ``<s>`` role ``[INST]`` text ``[/INST]`` text ... ``</s>``. Inside roles and
texts the characters that control strings begin with are escaped, so none can appear there; unescaping gives
the text back.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, BODY, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
# Escapes, in the order they are applied.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role become one struct with all their texts."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(turns, empty, add)


def _loss_spans(blocks: Column) -> Column:
    """(start, length) in code points of every text of the loss role in the formatted string."""

    def pieces(block: Column) -> Column:
        head = F.length(escaped(block["role"])) + len(OPEN) + len(BODY)
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(len(NEXT))).cast("bigint").alias("before"),
                F.length(escaped(text)).cast("bigint").alias("length"),
                F.when(i == F.size(block["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0)).cast("bigint").alias("after"),
                (block["role"] == LOSS_ROLE).alias("loss"),
            ),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["before"]
        span = F.array(F.struct(begin.alias("start"), piece["length"].alias("length")))
        return F.struct(
            (begin + piece["length"] + piece["after"]).alias("at"),
            F.when(piece["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(F.flatten(F.transform(blocks, pieces)), start, add, lambda state: state["spans"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_spans``.

    Turns go by ``turn``, then role, then text; equal rows stay apart. Null roles and texts are empty. A null
    ``turn`` comes first; rows without a conv_id are one conversation. A conversation is one value, which
    bounds its group.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = collected.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    written = F.transform(
        "blocks",
        lambda b: F.concat(
            F.lit(OPEN), escaped(b["role"]), F.lit(BODY), F.array_join(F.transform(b["texts"], escaped), NEXT), F.lit(CLOSE)
        ),
    )
    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), _loss_spans(F.col("blocks")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted string, in order."""

    def of_block(block: Column) -> Column:
        parts = F.split(block, r"\[INST\]", -1)
        role = unescaped(F.substring(parts[0], len(OPEN) + 1, 1 << 30))
        return F.transform(F.split(parts[1], r"\[/INST\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split(formatted, CLOSE, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), of_block))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(formatted.substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted table holds, read back from it."""
    read = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
