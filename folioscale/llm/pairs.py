"""Pairs within groups, for results that must list them: hot groups are cut into parts, so no task holds a whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(members: DataFrame, groups: list[str], item: str, block: int = 1000) -> DataFrame:
    """groups, a, b of each two different items of one group, the smaller first in order of bytes, once each.

    members: groups and item, no row twice. Groups of one are gone before the join. A group of n items is joined in
    n / ``block`` parts: each item stands in one part on the left and in all parts on the right.
    """
    sizes = members.groupBy(*groups).agg(F.count("*").alias("__n")).where("__n > 1")
    rows = members.join(sizes, groups).withColumn("__parts", F.ceil(F.col("__n") / block))
    left = rows.select(*groups, F.col(item).alias("a"), F.pmod(F.xxhash64(item), F.col("__parts")).alias("__part"))
    right = rows.select(*groups, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)).alias("__part"))
    return left.join(right, [*groups, "__part"]).where("a < b").select(*groups, "a", "b")
