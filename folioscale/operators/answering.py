"""From questions to ranked, capped and expanded context: the whole path as one DataFrame pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.functions import text as T
from folioscale.operators import lexical, packing


def context(questions: DataFrame, chunks: DataFrame, top: int = 10, per_paper: int = 3, window: int = 2000, kinds: tuple[str, ...] = ("abstract", "section", "fine", "caption", "table")) -> DataFrame:
    """query_id, rank, chunk_id, paper_id, score, kind, context of the best chunks of each question.

    questions: query_id, text; chunks: chunk_id, paper_id, chunk_type, text, parent_chunk_id. Questions are corrected and
    their acronyms spelt out before the search; a fine chunk's context is the window of its parent around it, any
    other's its own text. Rows of a chunk stored twice count once.
    """
    asked = questions.select("query_id", T.expanded(T.corrected(F.col("text"))).alias("text"), T.question_kind(F.col("text")).alias("kind"))
    pool = chunks.where(F.col("chunk_type").isin(*kinds)).select("chunk_id", "paper_id", "text", "parent_chunk_id", "chunk_type").dropDuplicates(["chunk_id"])
    found = lexical.search(pool, asked, per_paper, top, key="chunk_id", source="paper_id").select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score")
    hits = found.join(pool, "chunk_id")
    hits = packing.with_parents(hits, chunks.where("chunk_type = 'section'"), window)
    shown = F.when((F.col("chunk_type") == "fine") & (F.coalesce("parent_context", F.lit("")) != ""), F.col("parent_context")).otherwise(F.col("text"))
    return hits.join(asked.select("query_id", "kind"), "query_id").select("query_id", "rank", "chunk_id", "paper_id", "score", "kind", shown.alias("context"))


def formatted(contexts: DataFrame) -> DataFrame:
    """query_id, sources: the contexts as numbered sources of one prompt."""
    one = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.coalesce("paper_id", F.lit("unknown")), F.lit("\n"), F.coalesce("context", F.lit("")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))), lambda x: x["s"])
    return contexts.groupBy("query_id").agg(F.array_join(said, "\n---\n").alias("sources"))
