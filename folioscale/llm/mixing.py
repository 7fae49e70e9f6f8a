"""Problem 8: a selection of documents in which each listed source has its target share of the tokens.

A source can give at most its tokens times ``max_repeats``. Capped water-filling raises one level for all sources: each
gets its share of the level until it is full, and the others share what it cannot take. Quotas are computed on the
driver from one row per listed source. Each source then uses all its records as often as its quota holds all of them,
and the rest of the quota is filled in hash order of the key up to the record nearest to it.

Records are placed by hash buckets, whose sizes are summed first, so only the one bucket of a source in which its
quota ends is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.session import ensure_checkpoint_dir, table

#: Largest table of targets that is brought to the driver.
MAX_SOURCES = 100_000


@cache
def _tokenizer(vocabulary: str | None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], vocabulary: str | None = None) -> list[int]:
    """Tokens of each text in a vocabulary of ranks, given by its path (the public byte_bpe_50k by default); 0 for null."""
    encode = _tokenizer(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def water_fill(shares: list[float], caps: list[float], total: float | None = None) -> list[float]:
    """Quotas of at most ``caps`` that follow ``shares`` and sum to ``total``, or to all caps if those are less.

    Without a total, the largest quotas at which every source with a cap above 0 keeps its share of the others.
    """
    full = [c / s if s > 0 else float("inf") for s, c in zip(shares, caps)]
    live = [i for i, c in enumerate(caps) if c > 0 and shares[i] > 0]
    if not live:
        return [0.0] * len(shares)
    level = min(full[i] for i in live)
    if total is not None:
        left, weight = total, sum(shares[i] for i in live)
        for i in sorted(live, key=full.__getitem__):
            level = left / weight if weight > 0 else float("inf")
            if level <= full[i]:
                break
            left, weight = left - caps[i], weight - shares[i]
            level = full[i]
    return [min(c, s * level) if c > 0 and s > 0 else 0.0 for s, c in zip(shares, caps)]


def mix(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, buckets: int = 1024,
    epochs: float | None = None, vocabulary: str | None = None, seed: int = 42,
) -> DataFrame:
    """doc_id, source, tokens, uses (1 to max_repeats) of each record used, with its source's target_share.

    targets: source, target_share, max_repeats. Sources without documents get nothing, those without a target are left
    out. ``total``: tokens wanted, or ``epochs`` times all tokens of the listed sources; default as in water_fill. Which
    records stand for a fraction is drawn by hash with ``seed``. ``vocabulary``: path of the tokenizer's ranks.
    Null and empty texts have no tokens and are never used; repeated rows are records of their own; an empty table gives none.
    """
    wanted = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are more than the driver should hold")
    spark = documents.sparkSession
    named = F.broadcast(targets.where("source is not null").select(F.col("source").alias("named")))
    rows = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    rows = rows.join(named, F.col("source") == F.col("named"), "left_semi")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array(count_tokens(batch.column(2).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["doc_id", "source", "tokens"])

    counted = rows.mapInArrow(run, f"doc_id {kind}, source string, tokens bigint").where("tokens > 0")
    ensure_checkpoint_dir(spark)
    counted = counted.withColumn("place", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("place", F.lit(buckets))).checkpoint()

    sizes = counted.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    have = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("size")).collect()}
    if total is None and epochs is not None:
        total = epochs * sum(have.get(s, 0) for s, _, _ in wanted)
    caps = [float(have.get(s, 0) * max(n or 0, 0)) for s, _, n in wanted]
    quotas = water_fill([w or 0.0 for _, w, _ in wanted], caps, total)
    plan = []
    for (s, share, repeats), quota in zip(wanted, quotas):
        if quota > 0:
            passes = min(int(quota // have[s]), repeats)
            plan.append((s, share, passes, quota - passes * have[s] if passes < repeats else 0.0))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, passes int, rest double"))

    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    cuts = sizes.withColumn("after", so_far).join(plan.select("source", "rest"), "source").where("after - size < rest and after > rest")
    cuts = F.broadcast(cuts.groupBy("source").agg(F.min_by("bucket", "after").alias("cut"), F.min(F.col("after") - F.col("size")).alias("before")))
    fits = F.broadcast(
        sizes.withColumn("after", so_far).join(plan.select("source", "rest"), "source").where("after <= rest").groupBy("source").agg(F.max("bucket").alias("whole"))
    )
    placed = counted.join(plan, "source").join(cuts, "source", "left").join(fits, "source", "left").withColumn("at_cut", F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False)))
    away = placed.where("not at_cut").withColumn("uses", F.col("passes") + F.coalesce((F.col("bucket") <= F.col("whole")).cast("int"), F.lit(0)))
    end = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    near = placed.where("at_cut").withColumn("end", end).withColumn("uses", F.col("passes") + (F.col("end") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    names = ["doc_id", "source", "tokens", "uses", "target_share"]
    return away.select(names).unionByName(near.select(names)).where("uses > 0")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, records, tokens and share reached of every target, those that got nothing included."""
    got = selection.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    out = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["records", "tokens"])
    return out.withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy())))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The records used, and how often."""
    return mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_epoch(spark: SparkSession, root: str) -> DataFrame:
    """The records used when as many tokens are wanted as the listed sources hold: sources that their cap stops leave theirs to the others."""
    return mix(table(spark, root, "documents"), table(spark, root, "mix_targets"), epochs=1.0)


def p8_epoch_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of tokens that each target source reaches when as many are wanted as there are."""
    return shares(p8_epoch(spark, root), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share of tokens that each target source reaches."""
    return shares(p8_mix(spark, root), table(spark, root, "mix_targets"))
