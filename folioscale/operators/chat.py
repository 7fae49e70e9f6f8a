"""Conversations as tables: history windows, budgets, reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(messages: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Messages with ``turn`` from 1 in order of time and id, and ``from_end`` from 1 at the last."""
    order = Window.partitionBy(conversation).orderBy("created_at", "id")
    back = Window.partitionBy(conversation).orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumns({"turn": F.row_number().over(order).cast("bigint"), "from_end": F.row_number().over(back).cast("bigint")})


def trimmed_history(messages: DataFrame, most: int = 20, first: int = 2) -> DataFrame:
    """Of conversations longer than ``most``, the ``first`` messages and the last ``most - first``; the others whole."""
    return numbered(messages).where((F.col("turn") <= first) | (F.col("from_end") <= most - first)).drop("from_end")


def history_within(messages: DataFrame, characters: int) -> DataFrame:
    """The newest messages whose lengths, counted from the end, sum to ``characters`` at most, with ``used``."""
    back = Window.partitionBy("conversation_id").orderBy("from_end").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered(messages).withColumn("used", F.sum(F.coalesce(F.length("content"), F.lit(0)).cast("bigint")).over(back))
    return rows.where(F.col("used") <= characters)


def survives_next_turn(messages: DataFrame, characters: int) -> DataFrame:
    """conversation_id, used, next_turn, survives: whether one more turn, as long as the longest so far, still fits."""
    size = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    rows = numbered(messages).withColumn("size", size)
    pairs = rows.groupBy("conversation_id", F.floor((F.col("turn") - 1) / 2).alias("pair")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).where("n = 2")
    longest = pairs.groupBy("conversation_id").agg(F.max("s").alias("next_turn"))
    used = history_within(messages, characters).groupBy("conversation_id").agg(F.max("used").alias("used"))
    out = used.join(longest, "conversation_id", "left").withColumn("next_turn", F.coalesce("next_turn", F.lit(0)))
    return out.withColumn("survives", F.col("used") + F.col("next_turn") <= characters)


def transcripts(messages: DataFrame, shown: int = 150, last: int = 4) -> DataFrame:
    """conversation_id, transcript: the last messages as ``role: text`` lines, texts cut at ``shown`` characters."""
    rows = numbered(messages).where(F.col("from_end") <= last)
    text = F.coalesce("content", F.lit(""))
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring(text, 1, shown), F.when(F.length(text) > shown, "...").otherwise(""))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n")
    return rows.groupBy("conversation_id").agg(said.alias("transcript"))


def previous_answers(messages: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Numbered messages with ``answer``, the text of the last message before with one of the roles."""
    before = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return numbered(messages).withColumn("answer", F.last(F.when(F.col("role").isin(*roles), F.col("content")), ignorenulls=True).over(before))


def with_subject(question: Column, subject: Column) -> Column:
    """The question with ``it``, ``this`` and ``that`` replaced by the subject, where there is one."""
    quoted = F.regexp_replace(subject, r"([\\$])", r"\\$1")
    return F.when(subject.isNotNull() & (subject != ""), F.regexp_replace(question, F.lit(r"(?i)\b(it|this|that)\b"), quoted)).otherwise(question)
