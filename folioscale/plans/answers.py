"""Registered queries of the whole path from question to context, and of the stand-in services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import services
from folioscale.functions import text as T
from folioscale.operators import answering, dense
from folioscale.plans.search import _tokens
from folioscale.session import table


def _questions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def answer_context(spark: SparkSession, root: str) -> DataFrame:
    return answering.context(_questions(spark, root), table(spark, root, "chunks")).select("query_id", "rank", "chunk_id", "paper_id", "score")


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """Length of the numbered sources of each question."""
    out = answering.formatted(answering.context(_questions(spark, root), table(spark, root, "chunks"), 5, 2, 800))
    return out.select("query_id", F.length("sources").cast("bigint").alias("chars"))


def reranked(spark: SparkSession, root: str) -> DataFrame:
    """Best five chunks of each question by shared words, two of a paper, out of the twenty best by BM25."""
    q = _questions(spark, root)
    found = answering.context(q, table(spark, root, "chunks"), 20, 0).select("query_id", "rank", "chunk_id", "paper_id", F.col("context").alias("text"))
    out = services.reranked(found.join(q.withColumnRenamed("text", "query"), "query_id"), top=5, per_paper=2)
    return out.select("query_id", "rank", "chunk_id", "rerank_score", "was")


def embedded_search(spark: SparkSession, root: str) -> DataFrame:
    """Nearest chunks of each question in the stand-in's vectors."""
    embedder = services.HashedWords(64)
    c = table(spark, root, "documents").where("text is not null").select("doc_id", services.embedded(F.col("text"), embedder).alias("embedding"))
    q = _questions(spark, root).select("query_id", services.embedded(F.col("text"), embedder).alias("embedding"))
    return dense.nearest(c, q, 5, "doc_id")


def token_totals(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of all chunks by type."""
    c = table(spark, root, "chunks").select("chunk_id", "chunk_type", "text").distinct()
    return c.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(services.estimated_tokens(F.col("text"))).alias("tokens"))


def queries() -> dict:
    more = ", ".join(
        f"CASE WHEN regexp_matches(text, '(?i)\\b{T._escaped(a)}\\b') AND NOT contains(lower(text), '{e.lower()}') THEN '{e}' END" for a, e in T.ACRONYMS.items()
    )
    spelt = f"text || ' ' || array_to_string(list_slice(list_filter([{more}], lambda x: x IS NOT NULL), 1, 3), ' ')"
    sql = f"""WITH pool AS (SELECT DISTINCT chunk_id, paper_id, text FROM chunks WHERE chunk_type IN ('abstract', 'section', 'fine', 'caption', 'table')),
split AS (SELECT chunk_id, paper_id, coalesce({_tokens('text')}, []::VARCHAR[]) AS t FROM pool),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM split),
tf AS (SELECT chunk_id, paper_id, term, dl, count(*)::BIGINT AS tf FROM (SELECT chunk_id, paper_id, unnest(t) AS term, len(t)::BIGINT AS dl FROM split) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE), 0) AS idf FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus),
asked AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT item_id AS query_id, unnest({_tokens(spelt)}) AS term FROM eval_items) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, paper_id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN tf USING (term), corpus GROUP BY ALL HAVING score > 0),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, chunk_id) AS place FROM scored)
SELECT query_id, rank, chunk_id, paper_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::BIGINT AS rank FROM capped WHERE place <= 3) WHERE rank <= 10"""
    return {
        "c12_1_answer_context": (answer_context, sql), "c2_35_prompts": (prompts, None), "c9_14_reranked": (reranked, None), "c9_16_embedded_search": (embedded_search, None),
        "c10_31_token_totals": (token_totals, "SELECT chunk_type, count(*)::BIGINT AS n, sum(coalesce(ceil(length(text) / 4.0), 0))::BIGINT AS tokens FROM (SELECT DISTINCT chunk_id, chunk_type, text FROM chunks) GROUP BY chunk_type"),
    }
