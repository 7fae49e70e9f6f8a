"""Retrieval metrics over runs and graded judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gain of a grade, 2 ** grade - 1.
GAIN = {0: 0.0, 1: 1.0, 2: 3.0}


def gain(grade: Column) -> Column:
    return F.when(grade == 2, 3.0).when(grade == 1, 1.0).otherwise(0.0)


def discounted(grade: Column, rank: Column) -> Column:
    """Gain of the answer at ``rank``, discounted by log2(rank + 1)."""
    return gain(grade) / F.log2(rank.cast("double") + 1.0)


def evaluate(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20), key: str = "doc_id") -> DataFrame:
    """arm, query_id, and for each k recall@k, recall2@k, ndcg@k, precision@k, judged@k, then mrr, mrr2, n_results.

    runs: arm, query_id, rank, ``key``; qrels: query_id, ``key``, grade (0 to 2). Answers without judgment have grade 0.
    Queries without relevant answers have 0. A query is evaluated where the run answered it.
    """
    ideal = qrels.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), key)))
    ideal = ideal.groupBy("query_id").agg(
        *(F.sum(F.when(F.col("at") <= k, discounted(F.col("grade"), F.col("at"))).otherwise(0.0)).alias(f"ideal_{k}") for k in ks),
        F.count_if(F.col("grade") >= 1).alias("relevant"), F.count_if(F.col("grade") == 2).alias("relevant2"),
    )
    graded = runs.join(qrels.select("query_id", key, F.col("grade").alias("judged")), ["query_id", key], "left")
    graded = graded.withColumn("grade", F.coalesce("judged", F.lit(0)))
    sums = [F.count("*").alias("n_results"), F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"), F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first2")]
    for k in ks:
        near = F.col("rank") <= k
        sums += [
            F.count_if(near & (F.col("grade") >= 1)).alias(f"hit_{k}"), F.count_if(near & (F.col("grade") == 2)).alias(f"hit2_{k}"),
            F.sum(F.when(near, discounted(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}"),
            F.count_if(near & F.col("judged").isNotNull()).alias(f"judged_{k}"),
        ]
    got = graded.groupBy("arm", "query_id").agg(*sums).join(ideal, "query_id", "left")
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    out = []
    for k in ks:
        shown = F.least(F.lit(k), F.col("n_results"))
        out += [
            share(f"hit_{k}", "relevant").alias(f"recall_{k}"), share(f"hit2_{k}", "relevant2").alias(f"recall2_{k}"), share(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}"),
            (F.col(f"hit_{k}") / shown).alias(f"precision_{k}"), (F.col(f"judged_{k}") / shown).alias(f"judged_{k}"),
        ]
    reciprocal = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return got.select("arm", "query_id", *out, reciprocal("first").alias("mrr"), reciprocal("first2").alias("mrr2"), "n_results")


def averages(metrics: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """arm, kind (null for all), n_queries and the mean of each metric; undefined values are left out of a mean."""
    names = [f.name for f in metrics.schema.fields if f.dataType.simpleString() == "double"]
    rows = metrics.join(kinds, "query_id", "left") if kinds is not None else metrics.withColumn("kind", F.lit(None).cast("string"))
    sets = rows.groupingSets([["arm"], ["arm", "kind"]], "arm", "kind") if kinds is not None else rows.groupBy("arm", "kind")
    return sets.agg(F.count("*").alias("n_queries"), *(F.avg(n).alias(n) for n in names))


def pool(runs: DataFrame, depth: int, cap: int, key: str = "doc_id") -> DataFrame:
    """query_id, place, key, arm: round-robin pool by (rank, arm_no), each answer once, at most ``cap`` of a query.

    runs: arm, arm_no, query_id, rank, key. ``arm`` is the one that brought the answer first.
    """
    first = runs.where(F.col("rank") <= depth).groupBy("query_id", key).agg(F.min(F.struct("rank", "arm_no", "arm")).alias("f"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("f.rank", "f.arm_no", key)).cast("bigint"))
    return placed.where(F.col("place") <= cap).select("query_id", "place", key, F.col("f.arm").alias("arm"))


def group_grades(qrels: DataFrame, groups: DataFrame, key: str = "doc_id", group: str = "paper_id") -> DataFrame:
    """query_id, group, grade: the largest grade of a group's members."""
    return qrels.join(groups.select(key, group), key).where(F.col(group).isNotNull()).groupBy("query_id", group).agg(F.max("grade").alias("grade"))


def wins(metrics: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """wins, losses, ties and mean difference of arm ``a`` over arm ``b``, query by query."""
    x = metrics.where(F.col("arm") == a).select("query_id", F.col(metric).alias("x"))
    y = metrics.where(F.col("arm") == b).select("query_id", F.col(metric).alias("y"))
    d = x.join(y, "query_id").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(
        F.count_if(F.col("d") > 1e-9).alias("wins"), F.count_if(F.col("d") < -1e-9).alias("losses"), F.count_if(F.abs("d") <= 1e-9).alias("ties"),
        F.round(F.avg("d"), 9).alias("mean_difference"),
    )


def randomization_test(metrics: DataFrame, a: str, b: str, metric: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """n, mean_difference, p_value (two-sided, by sign flips), low and high (95 % bootstrap) of arm ``a`` less arm ``b``.

    One row a query enters, so the whole test is one small group in numpy.
    """
    import numpy as np
    import pandas as pd

    x = metrics.where(F.col("arm") == a).select("query_id", F.col(metric).alias("x"))
    y = metrics.where(F.col("arm") == b).select("query_id", F.col(metric).alias("y"))
    d = x.join(y, "query_id").select(F.lit(1).alias("one"), "query_id", (F.col("x") - F.col("y")).alias("d"))

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("query_id")["d"].to_numpy()
        rng = np.random.default_rng(seed)
        flips = np.abs((rng.choice((-1.0, 1.0), (resamples, len(v))) * v).mean(axis=1))
        means = rng.choice(v, (resamples, len(v))).mean(axis=1)
        p = (1 + (flips >= abs(v.mean()) - 1e-12).sum()) / (1 + resamples)
        return pd.DataFrame([(len(v), v.mean(), p, *np.quantile(means, (0.025, 0.975)))], columns=["n", "mean_difference", "p_value", "low", "high"])

    return d.groupBy("one").applyInPandas(test, "n bigint, mean_difference double, p_value double, low double, high double")


def agreement(pairs: DataFrame, a: str = "a", b: str = "b", top: int = 2) -> DataFrame:
    """n, exact, within_one, binary (both or neither relevant) and linear-weighted kappa of two judges' grades 0 to ``top``."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumn("apart", F.abs(F.col("x") - F.col("y")).cast("double"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    chance = rows.crossJoin(cols).agg(F.sum(F.abs(F.col("x") - F.col("y")) * F.col("nx") * F.col("ny")).alias("chance"))
    seen = cells.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("apart") == 0, F.col("n")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("apart") <= 1, F.col("n")).otherwise(0.0)).alias("w"),
        F.sum(F.when((F.col("x") >= 1) == (F.col("y") >= 1), F.col("n")).otherwise(0.0)).alias("r"), F.sum(F.col("apart") * F.col("n")).alias("apart"),
    )
    n = F.col("n")
    kappa = F.when(F.col("chance") > 0, 1.0 - F.col("apart") * n / F.col("chance")).otherwise(1.0)
    return seen.crossJoin(chance).select(n.cast("bigint").alias("n"), (F.col("e") / n).alias("exact"), (F.col("w") / n).alias("within_one"), (F.col("r") / n).alias("binary"), kappa.alias("kappa"))
