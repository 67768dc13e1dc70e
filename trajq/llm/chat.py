"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings begin with this; inside texts it is written differently.
OPEN, ESCAPED_OPEN, ESCAPED_NEWLINE = "<|", "<\\|", "<\\n"


def _lit(x: str) -> Column:
    return F.lit(x)


def escape(text: Column) -> Column:
    """Double every backslash, then break up `<|`. After the first step backslashes come in pairs, so the single one
    that the second step puts after `<` is never mistaken for the text's own."""
    return F.replace(F.replace(text, _lit("\\"), _lit("\\\\")), _lit(OPEN), _lit(ESCAPED_OPEN))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, _lit(ESCAPED_OPEN), _lit(OPEN)), _lit("\\\\"), _lit("\\"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, run: int = 128) -> Column:
    """The sum of the numbers before each. Summed by runs first, so that the work grows little faster than the array."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    before = lambda part: F.transform(part, lambda _, i: total(F.slice(part, F.lit(1), i)))
    n_runs = F.ceil(F.size(numbers) / run).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n_runs - 1), lambda r: F.slice(numbers, r * run + 1, F.lit(run)))

    def shifted(runs: Column) -> Column:
        starts = let(F.transform(runs, total), before)
        return F.flatten(F.zip_with(runs, starts, lambda part, start: F.transform(before(part), lambda x: x + start)))

    return F.when(F.size(numbers) > 0, let(runs, shifted)).otherwise(F.array().cast("array<bigint>"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), _lit("\n"), _lit(ESCAPED_NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, _lit(ESCAPED_NEWLINE), _lit("\n")))


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans.

    Turns are collected as structs and sorted by turn (null last, then by role and text). Adjacent turns of a role
    become one block `<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n`, which keeps where each turn began.
    loss_spans lists the code-point spans (start, end) of loss_role's texts in formatted, without any marker.
    Null roles and texts count as empty; rows with a null conv_col form one conversation; repeated rows are repeated
    turns; an empty input gives no rows; other columns are ignored.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("last"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), _lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), _lit("")).alias("text"),
    )
    collected = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    at = lambda i: F.element_at("_turns", (i + 1).cast("int"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (at(i)["role"] != F.coalesce(at(F.greatest(i - 1, F.lit(0)))["role"], _lit(""))))

    def block(start: Column, j: Column) -> Column:
        end = F.coalesce(F.try_element_at("_starts", j + 2), F.size("_turns"))
        return F.struct(at(start)["role"].alias("role"), F.transform(F.slice("_turns", start + 1, end - start), lambda t: escape(t["text"])).alias("texts"))

    blocks = collected.withColumn("_starts", starts).withColumn("_blocks", F.transform("_starts", block))
    head = lambda b: F.concat(_lit(START), _escape_role(b["role"]), _lit("\n"))
    tail = END + "\n"
    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), _lit(tail))), "")

    def piece(turn: Column, i: Column) -> Column:
        """How many characters come before the turn's text since the one before it, and how many it has."""
        opening = F.char_length(F.concat(_lit(START), _escape_role(turn["role"]), _lit("\n")))
        lead = F.when(i == 0, opening).when(at(i - 1)["role"] == turn["role"], len(SEP)).otherwise(opening + len(tail))
        return F.struct(lead.cast("long").alias("lead"), F.char_length(escape(turn["text"])).cast("long").alias("chars"), (turn["role"] == loss_role).alias("wanted"))

    def spans_of(pieces: Column) -> Column:
        starts = running_sums(F.transform(pieces, lambda p: p["lead"] + p["chars"]))
        span = lambda p, before: F.struct((before + p["lead"]).alias("start"), (before + p["lead"] + p["chars"]).alias("end"), p["wanted"].alias("wanted"))
        wanted = F.filter(F.zip_with(pieces, starts, span), lambda s: s["wanted"])
        return F.transform(wanted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    spans = let(F.transform("_turns", piece), spans_of)
    return blocks.select(F.col(conv_col), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(head) + 2)
        role = _unescape_role(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What format_conversations' output says, read back from it: counts and digests of turns, and of the text under
    the loss mask, which is cut from `formatted` at loss_spans."""
    read = formatted.withColumn("_read", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], _lit("\n"), t["text"], _lit("\n"))), "")
    masked = lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(masked(s))), "")
    return read.select(
        F.col(conv_col),
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
