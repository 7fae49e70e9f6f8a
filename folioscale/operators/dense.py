"""Dense search, fusion and pooling of vectors.

Exact search multiplies each Arrow block of vectors with the whole batch of queries in numpy and lets only the block's
best answers out; a batch beyond ``MAX_QUERY_VALUES`` numbers is cut into slices, each a scan. Filters are columns, so they
reach the scan before anything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most numbers in the queries that one worker holds.
MAX_QUERY_VALUES = 8_000_000


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the elements, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length; null for null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(0.0))


def predicate(**wanted: list | None) -> Column:
    """All columns named must be in their lists; a null or empty list asks nothing."""
    out = F.lit(True)
    for name, values in wanted.items():
        if values:
            out = out & F.col(name).isin(*values)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, key: str = "vec_id", vector: str = "embedding", query: str = "query_id") -> DataFrame:
    """query_id, rank from 1, key, score (cosine to six decimals): the exact ``top`` of each query.

    queries: ``query`` (bigint) and ``vector``, of any number; more than ``MAX_QUERY_VALUES`` numbers are asked in parts by hash of
    the id, each a scan. Null vectors, and those of another length than the queries, are no answers; a
    vector without length has the score 0. Equal scores go by key.
    """
    spark = vectors.sparkSession
    rows = queries.where(F.col(query).isNotNull() & F.col(vector).isNotNull()).select(F.col(query).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    schema = "query_id bigint, id bigint, score double"
    size, number = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    rows = rows.where(F.size("v") == size)
    parts = max(1, -(-size * number // MAX_QUERY_VALUES))
    found = None
    source = vectors.where(F.size(vector) == size).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    for k in range(parts):
        asked = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == k)).collect()
        if not asked:
            continue
        ids = [r[0] for r in asked]
        q = np.array([r[1] for r in asked], dtype=np.float64).reshape(len(ids), size)
        shared = spark.sparkContext.broadcast(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))

        def score(batches: Iterator[pa.RecordBatch], ids=ids, shared=shared, block: int = 8192) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for whole in batches:
                for start in range(0, whole.num_rows, block):
                    batch = whole.slice(start, block)
                    m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                    length = np.linalg.norm(m, axis=1, keepdims=True)
                    got = np.round((m / np.where(length > 0, length, 1)) @ shared.value.T, 6) + 0.0
                    name = batch.column(0).to_numpy(zero_copy_only=False)
                    best = [np.lexsort((name, -got[:, j]))[:top] for j in range(len(ids))]
                    d = np.concatenate(best)
                    j = np.repeat(np.arange(len(ids)), [len(b) for b in best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[j]), pa.array(name[d]), pa.array(got[d, j])], names=["query_id", "id", "score"])

        part = source.mapInArrow(score, schema)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(key), "score")


def reciprocal_rank_fusion(runs: list[DataFrame], top: int = 10, rrf_k: int = 60, key: str = "id") -> DataFrame:
    """query_id, rank, key, score: sum of 1 / (rrf_k + rank) over the runs (query_id, rank, key)."""
    both = runs[0].select("query_id", "rank", key)
    for more in runs[1:]:
        both = both.unionByName(more.select("query_id", "rank", key))
    summed = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", key, "score")


def normalized(run: DataFrame, score: str = "score") -> DataFrame:
    """The run with ``normalized``: scores of each query from 0 to 1; the score itself where all of a query are equal."""
    of = Window.partitionBy("query_id")
    low, high = F.min(score).over(of), F.max(score).over(of)
    return run.withColumn("normalized", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.col(score)))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, top: int = 10, key: str = "id", dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """query_id, rank, key, score: weighted sum of the normalized scores; an answer that one run lacks has 0 there."""
    a = normalized(dense).select("query_id", key, F.col("normalized").alias("d"))
    b = normalized(sparse).select("query_id", key, F.col("normalized").alias("s"))
    joined = a.join(b, ["query_id", key], "full_outer")
    score = dense_weight * F.coalesce("d", F.lit(0.0)) + sparse_weight * F.coalesce("s", F.lit(0.0))
    joined = joined.select("query_id", key, F.round(score, 9).alias("score"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", key, "score")


def boosted(run: DataFrame, overlap: str, factor: float = 0.1, resort: bool = False) -> DataFrame:
    """Scores times 1 + factor overlap. Ranks stay as they are unless ``resort``, as in the reference."""
    out = run.withColumn("score", F.round(F.col("score") * (1.0 + factor * F.col(overlap)), 9))
    if resort:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))).cast("bigint"))
    return out


def pooled(vectors: DataFrame, group: str, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """group, pooled: the (weighted) mean of a group's vectors, brought to length 1; of no length if the mean has none.

    Sums per position are combined before the shuffle, so a group may be of any size.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = vectors.where(F.col(vector).isNotNull()).select(group, w.alias("w"), F.posexplode(vector).alias("at", "x"))
    mean = parts.groupBy(group, "at").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    out = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("v"))
    length = norm(F.col("v"))
    return out.select(group, F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("pooled"))


def best_of_group(run: DataFrame, groups: DataFrame, top: int = 10, key: str = "id", group: str = "paper_id") -> DataFrame:
    """query_id, rank, group, score: each group by its best answer. groups: key and ``group``."""
    best = run.join(groups.select(key, group), key).groupBy("query_id", group).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), group)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", group, "score")
