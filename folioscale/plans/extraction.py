"""Registered queries over facts, mentions and tables; parsers without SQL are held by tests on literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import extract as E
from folioscale.session import table


def _texts(spark: SparkSession, root: str, where: str = "true") -> DataFrame:
    return table(spark, root, "chunks").where(where).select("chunk_id", "paper_id", "text", "chunk_type").distinct()


def prose_facts(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root, "chunk_type <> 'table'").select("chunk_id", F.inline(E.facts_of(F.col("text"))))


def fact_summary(spark: SparkSession, root: str) -> DataFrame:
    """Properties, units and entities of each chunk's facts, each once and in order."""
    f = F.col("facts")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(f, lambda x: x[c])))), "|")
    rows = _texts(spark, root).withColumn("facts", E.facts_of(F.col("text"))).where(F.size("facts") > 0)
    return rows.select("chunk_id", names("property").alias("properties"), names("unit").alias("units"), F.lower(names("entity")).alias("entities"))


def table_facts(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root, "text rlike '(?i)<tr[ >]'").select("chunk_id", F.inline(E.table_facts_of(F.col("text"))))


def mentions(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("chunk_id", F.inline(E.mentions_of(F.col("text"))))


def resolved(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of every paper's chunks with the caption chunk that they mean."""
    c = _texts(spark, root)
    said = c.where("chunk_type <> 'caption'").select("paper_id", F.inline(E.mentions_of(F.col("text")))).groupBy("paper_id", "kind", "number").agg(F.count("*").alias("times"))
    captions = c.where("chunk_type in ('caption', 'table')").select("paper_id", F.col("chunk_id").alias("target"), E.label_of(F.col("text")).alias("l"))
    labels = captions.where("l.kind is not null").select("paper_id", "l.kind", "l.number", "target")
    return E.resolved_mentions(said, labels)


def labels(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of the figure captions of each paper, filled in where they follow from their neighbours."""
    c = table(spark, root, "chunks").where("chunk_type = 'caption'").select("paper_id", "chunk_id", "figure_label").distinct()
    objects = c.select("paper_id", F.col("chunk_id").alias("at"), F.expr("try_cast(regexp_extract(figure_label, '([0-9]+)', 1) as bigint)").alias("number"))
    return E.labels_by_sequence(objects)


def folded(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "resolved").select("token_no", E.folded_text(F.col("token")).alias("folded"))


def queries() -> dict:
    return {
        "c10_1_prose_facts": (prose_facts, None), "c2_29_fact_summary": (fact_summary, None), "c10_2_table_facts": (table_facts, None), "c10_13_mentions": (mentions, None),
        "c10_15_resolved_mentions": (resolved, None), "c10_64_folded": (folded, None),
        "c6_11_labels_by_sequence": (labels, """WITH o AS (SELECT paper_id, "at", try_cast(nullif(regexp_extract(figure_label, '([0-9]+)', 1), '') AS BIGINT) AS number, row_number() OVER (PARTITION BY paper_id ORDER BY "at") AS p
  FROM (SELECT DISTINCT paper_id, chunk_id AS "at", figure_label FROM chunks WHERE chunk_type = 'caption')),
k AS (SELECT *, (SELECT max(p) FROM o a WHERE a.paper_id = o.paper_id AND a.p <= o.p AND a.number IS NOT NULL) AS ap, (SELECT min(p) FROM o b WHERE b.paper_id = o.paper_id AND b.p >= o.p AND b.number IS NOT NULL) AS bp FROM o),
v AS (SELECT k.*, a.number + k.p - ap AS up, b.number - bp + k.p AS down FROM k LEFT JOIN o a ON a.paper_id = k.paper_id AND a.p = ap LEFT JOIN o b ON b.paper_id = k.paper_id AND b.p = bp)
SELECT paper_id, "at", number, CASE WHEN number IS NOT NULL THEN number WHEN up IS NOT NULL AND down IS NOT NULL THEN CASE WHEN up = down THEN up END WHEN up IS NOT NULL THEN up WHEN down IS NOT NULL THEN CASE WHEN down >= 1 THEN down END ELSE p END AS filled FROM v"""),
    }
