"""Runs, greedy packing and context of chunks.

Packing depends on what was packed before, so each group's sizes are folded in order by one higher-order expression: it
stays in the JVM, needs no Python and only holds the group's sizes, not its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Rows with ``run`` from 0: consecutive rows of one key are one run, a null key is a run of its own."""
    by = Window.partitionBy(group).orderBy(order)
    same = F.coalesce((F.lag(key).over(by) == F.col(key)), F.lit(False))
    return rows.withColumn("run", (F.sum(F.when(same, 0).otherwise(1)).over(by) - 1).cast("bigint"))


def fold_bins(sizes: Column, budget: int, most: int | None = None) -> Column:
    """Number of the bin of each size: next fit, a new bin where the sum would pass ``budget`` or the count ``most``."""
    full = lambda s, n: (s["total"] + n > budget) | (F.lit(False) if most is None else s["count"] >= most)

    def step(s: Column, n: Column) -> Column:
        new = (s["count"] > 0) & full(s, n)
        return F.struct(
            F.array_append(s["bins"], s["bin"] + F.when(new, 1).otherwise(0).cast("bigint")).alias("bins"), (s["bin"] + F.when(new, 1).otherwise(0).cast("bigint")).alias("bin"),
            (F.when(new, 0).otherwise(s["total"]) + n).cast("bigint").alias("total"), (F.when(new, 0).otherwise(s["count"]) + 1).cast("bigint").alias("count"),
        )

    zero = F.struct(F.array().cast("array<bigint>").alias("bins"), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("count"))
    return F.aggregate(sizes, zero, step, lambda s: s["bins"])


def pack(rows: DataFrame, group: str, order: str, size: str, budget: int, most: int | None = None) -> DataFrame:
    """group, order, size, bin: rows of each group in order, packed by next fit."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("bigint").alias("n")))).alias("rows"))
    bins = lists.withColumn("bins", fold_bins(F.transform("rows", lambda r: r["n"]), budget, most))
    out = bins.select(group, F.explode_outer(F.arrays_zip("rows", "bins")).alias("z"))
    return out.select(group, F.col(f"z.rows.{order}").alias(order), F.col("z.rows.n").alias(size), F.col("z.bins").alias("bin"))


def _struct(starts: Column, first: Column, total: Column) -> Column:
    return F.struct(starts.alias("spans"), first.cast("bigint").alias("first"), total.cast("bigint").alias("total"))


def pack_overlapping(rows: DataFrame, group: str, order: str, size: str, budget: int, overlap: int, least: int = 0) -> DataFrame:
    """group, span from 0, first, last (places in order, from 0), tokens: greedy spans of at most ``budget``.

    A span that is full is followed by one that takes back trailing units of at most ``overlap`` in all. A last span under
    ``least`` is merged into the one before it. One unit above the budget is a span of its own, after its overlap.
    """
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("bigint").alias("n")))).alias("rows"))
    sums = F.aggregate(
        F.transform("rows", lambda r: r["n"]), F.array(F.lit(0).cast("bigint")), lambda s, n: F.array_append(s, F.element_at(s, -1) + n)
    )
    lists = lists.select(group, sums.alias("sums"), F.size("rows").cast("bigint").alias("n"))
    at = lambda k: F.element_at("sums", (k + 1).cast("int"))

    def step(s: Column, k: Column) -> Column:
        n = at(k + 1) - at(k)
        new = (s["first"] < k) & (s["total"] + n > budget)
        # the earliest unit from which those before k sum to the overlap at most
        back = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0).cast("bigint"), k), lambda j: at(k) - at(j) <= overlap)), k)
        closed = F.struct(s["first"].alias("first"), (k - 1).cast("bigint").alias("last"), s["total"].alias("tokens"))
        return _struct(F.when(new, F.array_append(s["spans"], closed)).otherwise(s["spans"]), F.when(new, back).otherwise(s["first"]), F.when(new, at(k) - at(back)).otherwise(s["total"]) + n)

    none = F.array().cast("array<struct<first:bigint,last:bigint,tokens:bigint>>")
    ended = lambda s: F.array_append(s["spans"], F.struct(s["first"].alias("first"), (F.col("n") - 1).alias("last"), s["total"].alias("tokens")))
    spans = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), _struct(none, F.lit(0), F.lit(0)), step, ended)
    tail, prior = (F.try_element_at("spans", F.lit(k)) for k in (-1, -2))
    merged = F.array_append(F.slice("spans", 1, F.greatest(F.size("spans") - 2, F.lit(0))), F.struct(prior["first"].alias("first"), F.greatest(prior["last"], tail["last"]).alias("last"), (prior["tokens"] + tail["tokens"]).alias("tokens")))
    out = lists.withColumn("spans", spans).withColumn("spans", F.when((F.size("spans") > 1) & (F.try_element_at("spans", F.lit(-1))["tokens"] < least), merged).otherwise(F.col("spans")))
    # the outer form: of the plain one Catalyst infers a filter on the size, which would compute the fold many times over
    return out.select(group, F.posexplode_outer("spans").alias("span", "s")).select(group, F.col("span").cast("bigint").alias("span"), "s.first", "s.last", "s.tokens")


def page_label(start: Column, end: Column) -> Column:
    same = F.concat(F.lit("p."), start.cast("string"))
    return F.when(start.isNull(), "").when(end.isNotNull() & (end != start), F.concat(same, F.lit("-"), end.cast("string"))).otherwise(same)


def context_line(title: Column, section: Column, page_start: Column, page_end: Column, subsection: Column | None = None) -> Column:
    """``[Title — Section > Subsection, p.N]``; parts that are missing are left out, without any it is empty."""
    head = F.substring(F.translate(F.trim(F.coalesce(title, F.lit(""))), "\n", " "), 1, 120)
    named = F.initcap(F.replace(F.coalesce(section, F.lit("")), F.lit("_"), F.lit(" ")))
    more = F.substring(F.trim(F.coalesce(F.lit(None) if subsection is None else subsection, F.lit(""))), 1, 80)
    some = lambda c: F.when(c != "", c)
    tail = F.concat_ws(", ", some(F.concat_ws(" > ", some(named), some(more))), some(page_label(page_start, page_end)))
    line = F.concat_ws(" — ", some(head), some(tail))
    return F.when(line != "", F.concat(F.lit("["), line, F.lit("]"))).otherwise("")


def parent_window(parent: Column, child: Column, width: int = 2000) -> Column:
    """Characters of the parent around the place where the child stands in it; its head if it stands nowhere."""
    probe = F.trim(F.substring(F.coalesce(child, F.lit("")), 1, 400))
    first = F.when(probe != "", F.instr(parent, probe)).otherwise(0)
    later = F.when(F.length(probe) > 80, F.instr(parent, F.substring(probe, 41, 160))).otherwise(0)
    found = F.when(first > 0, first).otherwise(later) - 1
    whole = F.length(parent)
    begin = F.greatest(F.lit(0), found + F.floor(F.length(probe) / 2).cast("int") - width // 2)
    end = F.least(whole, begin + width)
    begin = F.greatest(F.lit(0), end - width)
    window = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(parent, begin + 1, end - begin), F.when(end < whole, "...").otherwise(""))
    return F.when(F.coalesce(parent, F.lit("")) == "", "").when(whole <= width, parent).when(found < 0, F.substring(parent, 1, width)).otherwise(window)


def with_parents(fine: DataFrame, chunks: DataFrame, width: int = 2000) -> DataFrame:
    """Fine chunks with parent_context, the window of their parent's text; null where there is no parent.

    Repeated rows of a parent count once.
    """
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("__parent")).distinct()
    joined = fine.join(parents, "parent_chunk_id", "left")
    return joined.withColumn("parent_context", F.when(F.col("__parent").isNotNull(), parent_window(F.col("__parent"), F.col("text"), width))).drop("__parent")
