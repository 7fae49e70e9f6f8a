"""The catalog: latest versions, summaries, pages of results, resolution of tokens, upserts and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row a key, the first in ``order``; the order must be total for a stable result."""
    keys = [key] if isinstance(key, str) else key
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, with total and has_more.

    The sort is a top-n of offset + limit rows, not of the table; the total is a count of its own.
    """
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def counts_by(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """key and one column of counts for each kind named, 0 where there is none, and ``total``."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.count("*").alias("total"))


def over_domain(rows: DataFrame, kind: str, domain: list[str]) -> DataFrame:
    """kind, n of every kind of the domain, 0 where none occurs; other kinds are left out."""
    spine = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{kind} string")
    return spine.join(rows.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def top_of_each(rows: DataFrame, category: str, item: str, n: int) -> DataFrame:
    """category, item, uses, place: the ``n`` most frequent items of each category, ties by item."""
    counted = rows.groupBy(category, item).agg(F.count("*").alias("uses"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("uses"), item)).cast("bigint"))
    return placed.where(F.col("place") <= n)


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table with the incoming rows in place of those of their keys."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(incoming.select(table.columns))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these keys; rows without key stay."""
    return table.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def replayed(snapshot: DataFrame, journal: DataFrame, key: str, sequence: str) -> DataFrame:
    """Snapshot and append-only journal as one state: the last row of each key wins, the journal's over the snapshot's."""
    both = snapshot.withColumn("__part", F.lit(0)).unionByName(journal.withColumn("__part", F.lit(1)))
    return latest(both, key, F.desc("__part"), F.desc(sequence)).drop("__part")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side`` (left or right), repeated as often as they are missing."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def safe_name(name: Column) -> Column:
    """The name with letters, digits, dot, underscore, dash and blank only, ending in .pdf."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "")
    return F.when(F.lower(kept).endswith(".pdf"), kept).otherwise(F.concat(kept, F.lit(".pdf")))


def unique_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with ``unique_name``: second and later rows of a name get _1, _2 ... before the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def looks_like_id(token: Column) -> Column:
    return F.coalesce(token.rlike("(?i)^[0-9a-f]{12}$"), F.lit(False))


def resolve(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """token_no, token, file_name, via: the catalog file that each token names.

    tokens: token_no, token; catalog: paper_id, file_name. A token is tried as it is (an id, then a file name), then by the
    last component of its path, with .pdf added where it is missing. Keys are made on both sides, so each try is an
    equi-join; the first try that meets wins, and of several files the first in order.
    """
    last = F.trim(F.regexp_extract("token", r"[^/\\]*$", 0))
    named = F.when(F.lower(last).endswith(".pdf"), last).otherwise(F.concat(last, F.lit(".pdf")))
    tries = F.array(
        F.struct(F.lit(0).alias("order"), F.lower("token").alias("key"), F.lit("id").alias("via")), F.struct(F.lit(1).alias("order"), F.col("token").alias("key"), F.lit("exact").alias("via")),
        F.struct(F.lit(2).alias("order"), named.alias("key"), F.lit("path").alias("via")),
    )
    asked = tokens.select("token_no", "token", F.inline(tries))
    keys = catalog.select(F.lit(0).alias("order"), F.col("paper_id").alias("key"), "file_name").unionByName(
        catalog.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("order"), F.col("file_name").alias("key"), "file_name")
    ).distinct()
    met = asked.join(keys, ["order", "key"])
    first = latest(met, "token_no", F.col("order"), F.col("file_name")).select("token_no", "file_name", "via")
    return tokens.select("token_no", "token").join(first, "token_no", "left").select("token_no", "token", "file_name", F.coalesce("via", F.lit("none")).alias("via"))
