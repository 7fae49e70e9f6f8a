"""Registered queries of the search core: lexical, dense, fusion, judging. Each stands beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators import dense, judging, lexical
from folioscale.session import table

_STOP = "[" + ", ".join(f"'{w}'" for w in lexical.STOPWORDS) + "]"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z]+\\d*|\\d+\\.?\\d*[a-z]*'), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


#: Common table expressions: every document's tokens, term frequencies, statistics, and the questions' terms.
BM25_SQL = f"""
split AS (SELECT doc_id, source, coalesce({_tokens('text')}, []::VARCHAR[]) AS t FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl, sum(len(t))::BIGINT AS total FROM split),
tf AS (SELECT doc_id, source, term, dl, count(*)::BIGINT AS tf FROM (SELECT doc_id, source, unnest(t) AS term, len(t)::BIGINT AS dl FROM split) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE), 0) AS idf FROM df, corpus),
asked AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM eval_items) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, source, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN tf USING (term), corpus GROUP BY ALL HAVING score > 0),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS place FROM scored)"""

#: Exact cosine of every query vector (ids divisible by 20) with every vector, to rank 20.
COSINE_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM v AS q JOIN v ON true WHERE q.vec_id % 20 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM near) WHERE rank <= 20)"""


def _questions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    """df and idf of every term of the corpus."""
    return lexical.term_statistics(table(spark, root, "documents")).select("term", "df", F.round("idf", 9).alias("idf"))


def corpus_statistics(spark: SparkSession, root: str) -> DataFrame:
    return lexical.corpus_statistics(table(spark, root, "documents")).select("n_docs", "total_tokens", F.round("avgdl", 9).alias("avgdl"))


def incremental_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the early documents, then merged with those of the late ones: the same as of all at once."""
    documents = table(spark, root, "documents")
    middle = F.col("added_at") < F.lit("2024-07-01").cast("timestamp_ntz")
    known = lexical.term_statistics(documents.where(middle))
    return lexical.merge_statistics(known, lexical.term_statistics(documents.where(~F.coalesce(middle, F.lit(False)))))


def document_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Document side of BM25 for every document and term."""
    return lexical.vectors(table(spark, root, "documents")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def query_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Question side of BM25 for the evaluation texts."""
    statistics = lexical.term_statistics(table(spark, root, "documents"))
    return lexical.query_vectors(_questions(spark, root), statistics).select("query_id", "term", F.round("weight", 6).alias("weight"))


def length_drift(spark: SparkSession, root: str) -> DataFrame:
    """Mean length of each language's documents against that of the corpus, and whether it drifts by over a fifth."""
    documents = table(spark, root, "documents")
    sizes = documents.select("lang", F.coalesce(F.size(lexical.tokens(F.col("text"))), F.lit(0)).alias("dl"))
    frozen = sizes.agg(F.avg("dl").alias("frozen"))
    seen = sizes.groupBy("lang").agg(F.avg("dl").alias("observed")).crossJoin(F.broadcast(frozen))
    moved = seen.withColumn("drift", F.round(lexical.drift(F.col("observed"), F.col("frozen")), 6))
    return moved.select("lang", F.round("observed", 6).alias("observed"), "drift", (F.col("drift") > 0.2).alias("drifts"))


def sparse_search(spark: SparkSession, root: str) -> DataFrame:
    """Best ten documents of each evaluation text, without a cap."""
    return lexical.search(table(spark, root, "documents"), _questions(spark, root), per_source=0, top=10)


def _dense(spark: SparkSession, root: str, top: int = 20, where=None) -> DataFrame:  # noqa: ANN001
    vectors = table(spark, root, "embeddings")
    queries = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.nearest(vectors if where is None else vectors.where(where), queries, top)


def dense_search(spark: SparkSession, root: str) -> DataFrame:
    """Best twenty vectors of each vector whose id is divisible by 20, among all."""
    return _dense(spark, root)


def filtered_search(spark: SparkSession, root: str) -> DataFrame:
    """The same among the vectors with the labels 1 to 4, filtered before scoring."""
    return _dense(spark, root, 10, dense.predicate(label=[1, 2, 3, 4]))


def pair_cosine(spark: SparkSession, root: str) -> DataFrame:
    """Cosine of each vector with the next one, as a column expression."""
    v = table(spark, root, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def pooled_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Mean vector of each label, of length 1, position by position."""
    p = dense.pooled(table(spark, root, "embeddings"), "label")
    return p.select("label", F.posexplode("pooled").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def weighted_pool(spark: SparkSession, root: str) -> DataFrame:
    """Mean vector of each label, weighted by 1 / (1 + label + vec_id mod 7)."""
    p = dense.pooled(table(spark, root, "embeddings"), "label", weight=1.0 / (1.0 + F.col("label") + F.col("vec_id") % 7))
    return p.select("label", F.posexplode("pooled").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def group_search(spark: SparkSession, root: str) -> DataFrame:
    """Best labels of each query by their best vector."""
    groups = table(spark, root, "embeddings").select("vec_id", "label")
    return dense.best_of_group(_dense(spark, root), groups, 5, "vec_id", "label")


def _two_runs(spark: SparkSession, root: str) -> list[DataFrame]:
    """Cosine, and as a second opinion the order by distance of ids, on the same queries."""
    near = _dense(spark, root)
    other = near.select("query_id", "vec_id", (1.0 / (1.0 + F.abs(F.col("vec_id") - F.col("query_id")))).alias("score"))
    from pyspark.sql import Window

    other = other.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint"))
    return [near, other.where("rank <= 12")]


_OTHER_SQL = """,
other AS (SELECT * FROM (SELECT query_id, vec_id, 1.0::DOUBLE / (1 + abs(vec_id - query_id)) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (1 + abs(vec_id - query_id)) DESC, vec_id)::BIGINT AS rank FROM dense) WHERE rank <= 12)"""


def fused(spark: SparkSession, root: str) -> DataFrame:
    """Reciprocal rank fusion of two runs."""
    return dense.reciprocal_rank_fusion(_two_runs(spark, root), 10, key="vec_id")


def weighted(spark: SparkSession, root: str) -> DataFrame:
    """Weighted sum of the normalized scores of two runs."""
    return dense.weighted_fusion(*_two_runs(spark, root), 10, key="vec_id")


def boosted(spark: SparkSession, root: str) -> DataFrame:
    """Scores raised by a tenth for each unit of overlap (here the label), ranks taken anew."""
    run = _dense(spark, root).join(table(spark, root, "embeddings").select("vec_id", "label"), "vec_id")
    return dense.boosted(run, "label", resort=True).select("query_id", "rank", "vec_id", "score")


def _arms(spark: SparkSession, root: str) -> DataFrame:
    documents, questions = table(spark, root, "documents"), _questions(spark, root)
    one = lexical.search(documents, questions, per_source=0, top=20).select(F.lit("plain").alias("arm"), F.lit(0).alias("arm_no"), "query_id", "rank", "doc_id")
    two = lexical.search(documents, questions, per_source=2, top=20).select(F.lit("capped").alias("arm"), F.lit(1).alias("arm_no"), "query_id", "rank", "doc_id")
    return one.unionByName(two)


def _judged(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """Grades of all answers: document types stand in for judges."""
    grade = F.when(F.col("doc_type") == "section", 2).when(F.col("doc_type").isin("abstract", "protocol"), 1).when(F.col("doc_type").isNotNull(), 0)
    graded = table(spark, root, "documents").select("doc_id", grade.alias("grade")).where("grade is not null")
    return runs.select("query_id", "doc_id").distinct().join(graded, "doc_id")


_ARMS_SQL = """,
runs AS (
  SELECT 'plain' AS arm, 0 AS arm_no, query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM scored) WHERE rank <= 20
  UNION ALL
  SELECT 'capped', 1, query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM capped WHERE place <= 2) WHERE rank <= 20),
qrels AS (
  SELECT query_id, doc_id, CASE WHEN doc_type = 'section' THEN 2 WHEN doc_type IN ('abstract', 'protocol') THEN 1 ELSE 0 END AS grade
  FROM (SELECT DISTINCT query_id, doc_id FROM runs) JOIN documents USING (doc_id) WHERE doc_type IS NOT NULL),
g AS (SELECT r.*, q.grade AS judged, coalesce(q.grade, 0) AS grade FROM runs r LEFT JOIN qrels q USING (query_id, doc_id)),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS spot FROM qrels)"""
_GAIN_SQL = "(CASE grade WHEN 2 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _metrics_sql() -> str:
    ideal = ", ".join(f"sum(CASE WHEN spot <= {k} THEN {_GAIN_SQL} / log2(spot + 1.0::DOUBLE) ELSE 0 END) AS i{k}" for k in (5, 10, 20))
    got = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN {_GAIN_SQL} / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS d{k}, count(*) FILTER (rank <= {k} AND grade >= 1) AS h{k}, "
        f"count(*) FILTER (rank <= {k} AND grade = 2) AS hh{k}, count(*) FILTER (rank <= {k} AND judged IS NOT NULL) AS j{k}"
        for k in (5, 10, 20)
    )
    out = ", ".join(
        f"coalesce(h{k} / nullif(rel, 0)::DOUBLE, 0) AS recall_{k}, coalesce(hh{k} / nullif(rel2, 0)::DOUBLE, 0) AS recall2_{k}, coalesce(d{k} / nullif(i{k}, 0), 0) AS ndcg_{k}, "
        f"h{k} / least({k}, n)::DOUBLE AS precision_{k}, j{k} / least({k}, n)::DOUBLE AS judged_{k}"
        for k in (5, 10, 20)
    )
    return f""",
ideals AS (SELECT query_id, count(*) FILTER (grade >= 1) AS rel, count(*) FILTER (grade = 2) AS rel2, {ideal} FROM ideal GROUP BY query_id),
got AS (SELECT arm, query_id, count(*)::BIGINT AS n, min(rank) FILTER (grade >= 1) AS first, min(rank) FILTER (grade >= 2) AS first2, {got} FROM g GROUP BY arm, query_id),
metrics AS (SELECT arm, query_id, {out}, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(1.0::DOUBLE / first2, 0) AS mrr2, n AS n_results FROM got LEFT JOIN ideals USING (query_id))"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in rows.schema.fields))


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """All metrics of two arms for every evaluation text."""
    runs = _arms(spark, root)
    return _rounded(judging.evaluate(runs, _judged(spark, root, runs)))


def metric_averages(spark: SparkSession, root: str) -> DataFrame:
    """Means of the metrics by arm, and by arm and kind of question."""
    runs = _arms(spark, root)
    kinds = table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), "kind")
    rows = judging.averages(judging.evaluate(runs, _judged(spark, root, runs)), kinds)
    return _rounded(rows.select("arm", "kind", "n_queries", "ndcg_10", "recall_20", "precision_5", "mrr"))


def judging_pool(spark: SparkSession, root: str) -> DataFrame:
    """Round-robin pool of two arms, fifteen answers a question at most."""
    return judging.pool(_arms(spark, root), 10, 15)


def paper_grades(spark: SparkSession, root: str) -> DataFrame:
    """Grade of a paper for a question: the best of its documents."""
    runs = _arms(spark, root)
    return judging.group_grades(_judged(spark, root, runs), table(spark, root, "documents").select("doc_id", "paper_id"))


def arm_wins(spark: SparkSession, root: str) -> DataFrame:
    """Questions that the plain arm wins, loses and ties against the capped one by ndcg at 10."""
    runs = _arms(spark, root)
    return judging.wins(judging.evaluate(runs, _judged(spark, root, runs)), "plain", "capped", "ndcg_10")


def arm_test(spark: SparkSession, root: str) -> DataFrame:
    """Randomization test of the two arms; seeded, without SQL."""
    runs = _arms(spark, root)
    return judging.randomization_test(judging.evaluate(runs, _judged(spark, root, runs)), "plain", "capped", "ndcg_10")


def judge_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of two graders on all messages: length and role stand in for their grades."""
    m = table(spark, root, "messages").where("content is not null")
    pairs = m.select(F.least(F.floor(F.length("content") / 100), F.lit(2)).cast("int").alias("a"), F.least(F.floor(F.length("content") / 160 + F.col("id") % 2), F.lit(2)).cast("int").alias("b"))
    return _rounded(judging.agreement(pairs))


def queries() -> dict:
    """Name: (query, SQL or None)."""
    with_bm25 = lambda sql, more="": f"WITH {BM25_SQL}{more}\n{sql}"
    with_cosine = lambda sql, more="": f"WITH {COSINE_SQL}{more}\n{sql}"
    judged = _ARMS_SQL + _metrics_sql()
    names = [f"{m}_{k}" for k in (5, 10, 20) for m in ("recall", "recall2", "ndcg", "precision", "judged")] + ["mrr", "mrr2"]
    pool_sql = lambda w: f"""WITH p AS (SELECT label, i AS pos, sum(w * x) / sum(w) AS m FROM (
  SELECT label, {w} AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL)
SELECT label, pos::BIGINT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM p"""  # noqa: E731
    return {
        "c5_1_term_statistics": (term_statistics, with_bm25("SELECT term, df, round(idf, 9) AS idf FROM idf")),
        "c5_1_corpus_statistics": (corpus_statistics, with_bm25("SELECT n::BIGINT AS n_docs, total AS total_tokens, round(avgdl, 9) AS avgdl FROM corpus")),
        "c5_2_incremental_statistics": (incremental_statistics, with_bm25("SELECT term, df FROM df")),
        "c5_5_document_vectors": (document_vectors, with_bm25("SELECT doc_id, term, round(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS weight FROM tf, corpus")),
        "c9_4_query_vectors": (query_vectors, with_bm25("SELECT query_id, term, round(qf * coalesce(idf, 3.0::DOUBLE), 6) AS weight FROM asked LEFT JOIN idf USING (term)")),
        "c9_7_length_drift": (length_drift, with_bm25("""SELECT lang, round(o, 6) AS observed, round(abs(o - avgdl) / avgdl, 6) AS drift, round(abs(o - avgdl) / avgdl, 6) > 0.2 AS drifts
FROM (SELECT lang, avg(len(t))::DOUBLE AS o FROM split JOIN documents USING (doc_id) GROUP BY lang), corpus""")),
        "c9_8_sparse_search": (sparse_search, with_bm25("SELECT query_id, rank, doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM scored) WHERE rank <= 10")),
        "c6_1_capped_search": (lexical.evaluation_search, with_bm25("SELECT query_id, rank, doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM capped WHERE place <= 2) WHERE rank <= 10")),
        "c9_1_dense_search": (dense_search, with_cosine("SELECT query_id, rank, vec_id, score FROM dense")),
        "c3_1_filtered_search": (filtered_search, with_cosine("SELECT query_id, rank, vec_id, score FROM (SELECT near.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, near.vec_id)::BIGINT AS rank FROM near JOIN embeddings e ON e.vec_id = near.vec_id WHERE label IN (1, 2, 3, 4)) WHERE rank <= 10")),
        "c9_24_pair_cosine": (pair_cosine, "SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1"),
        "c5_10_pooled_vectors": (pooled_vectors, pool_sql("1.0::DOUBLE")),
        "c5_12_weighted_pool": (weighted_pool, pool_sql("1.0::DOUBLE / (1 + label + vec_id % 7)")),
        "c7_2_group_search": (group_search, with_cosine("SELECT query_id, rank, label, score FROM (SELECT query_id, label, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, label)::BIGINT AS rank FROM dense JOIN embeddings USING (vec_id) GROUP BY query_id, label) WHERE rank <= 5")),
        "c9_9_rank_fusion": (fused, with_cosine("""SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank
FROM (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, vec_id, rank FROM dense UNION ALL SELECT query_id, vec_id, rank FROM other) GROUP BY ALL)) WHERE rank <= 10""", _OTHER_SQL)),
        "c9_11_weighted_fusion": (weighted, with_cosine("""SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, round(0.7::DOUBLE * coalesce(a.s, 0) + 0.3::DOUBLE * coalesce(b.s, 0), 9) AS score
  FROM (SELECT query_id, vec_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM dense WINDOW w AS (PARTITION BY query_id)) a
  FULL JOIN (SELECT query_id, vec_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM other WINDOW w AS (PARTITION BY query_id)) b
  ON a.query_id = b.query_id AND a.vec_id = b.vec_id)) WHERE rank <= 10""", _OTHER_SQL)),
        "c9_12_boosted": (boosted, with_cosine("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + 0.1::DOUBLE * label), 9) DESC, rank)::BIGINT AS rank, vec_id, round(score * (1 + 0.1::DOUBLE * label), 9) AS score FROM dense JOIN embeddings USING (vec_id)")),
        "c4_11_metrics": (metrics, with_bm25(f"SELECT arm, query_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, n_results FROM metrics", judged)),
        "c5_15_metric_averages": (metric_averages, with_bm25("""SELECT arm, kind, count(*)::BIGINT AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_20), 6) AS recall_20, round(avg(precision_5), 6) AS precision_5, round(avg(mrr), 6) AS mrr
FROM metrics JOIN eval_items ON item_id = metrics.query_id GROUP BY GROUPING SETS ((arm), (arm, kind))""", judged)),
        "c6_7_judging_pool": (judging_pool, with_bm25("""SELECT query_id, place, doc_id, arm FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, arm_no, doc_id)::BIGINT AS place FROM (
  SELECT query_id, doc_id, arg_min(arm, rank * 10 + arm_no) AS arm, min(rank * 10 + arm_no) // 10 AS rank, min(rank * 10 + arm_no) % 10 AS arm_no FROM runs WHERE rank <= 10 GROUP BY query_id, doc_id)) WHERE place <= 15""", _ARMS_SQL)),
        "c5_24_paper_grades": (paper_grades, with_bm25("SELECT query_id, paper_id, max(grade) AS grade FROM qrels JOIN documents USING (doc_id) WHERE paper_id IS NOT NULL GROUP BY query_id, paper_id", _ARMS_SQL)),
        "c6_8_arm_wins": (arm_wins, with_bm25("""SELECT count(*) FILTER (d > 1e-9)::BIGINT AS wins, count(*) FILTER (d < -1e-9)::BIGINT AS losses, count(*) FILTER (abs(d) <= 1e-9)::BIGINT AS ties, round(avg(d), 9) AS mean_difference
FROM (SELECT a.ndcg_10 - b.ndcg_10 AS d FROM metrics a JOIN metrics b ON a.query_id = b.query_id AND a.arm = 'plain' AND b.arm = 'capped')""", judged)),
        "c6_8_arm_test": (arm_test, None),
        "c5_23_judge_agreement": (judge_agreement, """WITH p AS (SELECT least(length(content) // 100, 2) AS a, least(floor(length(content) / 160 + id % 2)::BIGINT, 2) AS b FROM messages WHERE content IS NOT NULL),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY a, b), t AS (SELECT sum(n) AS n FROM c),
x AS (SELECT a, sum(n) AS n FROM c GROUP BY a), y AS (SELECT b, sum(n) AS n FROM c GROUP BY b)
SELECT (SELECT n FROM t)::BIGINT AS n, round(sum(n) FILTER (a = b) / (SELECT n FROM t), 6) AS exact, round(sum(n) FILTER (abs(a - b) <= 1) / (SELECT n FROM t), 6) AS within_one,
  round(sum(n) FILTER ((a >= 1) = (b >= 1)) / (SELECT n FROM t), 6) AS "binary",
  round(1 - sum(abs(a - b) * n) * (SELECT n FROM t) / (SELECT sum(abs(a - b) * x.n * y.n) FROM x, y), 6) AS kappa FROM c"""),
    }
