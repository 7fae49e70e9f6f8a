"""BM25: tokens, corpus statistics, sparse vectors, and exact search for a batch of questions.

Statistics are one counting job. Search scores every document of the scan against the whole batch of questions at once:
the questions' term weights go to the workers (their size is checked; a larger batch is cut into slices, each a scan),
every Arrow block of documents is scored with numpy, and only its best answers leave it. So postings are never shuffled
and what is shuffled grows with blocks times questions times ``top``, not with matching pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.session import table

#: Words that carry no meaning for search. Fixed values, those of the reference.
STOPWORDS = tuple(
    """the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would
    could should may might must shall can need this that these those it its their they we our you your he him his she her
    which who whom what when where why how all each every both few more most other some such no not only same so than too
    very just also into through during before after above below between under over study studies studied method methods
    result results used using use show shown showed find found finding analysis analyzed data""".split()
)
TOKEN = r"[a-z]+\d*|\d+\.?\d*[a-z]*"
#: Most weights (terms times questions) that one worker holds for a slice of the questions.
MAX_WEIGHTS = 16_000_000
#: Most characters of questions that the driver holds at once; a larger batch is asked in parts by hash of the id.
MAX_QUESTION_CHARS = 64_000_000
_TOKEN, _STOP = re.compile(TOKEN), frozenset(STOPWORDS)


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of two characters or more, without stopwords; null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def split_tokens(text: str | None) -> list[str]:
    """The same in Python, for use inside Arrow blocks."""
    return [t for t in _TOKEN.findall(text.lower()) if len(t) >= 2 and t not in _STOP] if text else []


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, dl: how often each term occurs in each document, and the document's number of tokens."""
    split = documents.select(key, tokens(F.col(text)).alias("t"))
    split = split.select(key, F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("term"))
    return split.groupBy(key, "dl", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def corpus_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """n_docs, total_tokens, avgdl of the corpus; empty and null texts count as documents without tokens."""
    sizes = documents.select(F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).cast("bigint").alias("dl"))
    return sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1.0), F.lit(0.0))


def term_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """term, df, idf of the whole corpus; terms are made distinct per document before the count."""
    n = documents.agg(F.count("*").cast("double").alias("n"))
    terms = documents.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df").cast("double")).alias("idf"))


def merge_statistics(known: DataFrame, more: DataFrame) -> DataFrame:
    """term, df after the documents behind ``more`` (term, df) have been added to those behind ``known``."""
    return known.select("term", "df").unionByName(more.select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))


def vectors(documents: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key, term, weight: document side of BM25, tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))."""
    mean = corpus_statistics(documents, text).select("avgdl")
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    weight = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.col("avgdl")))
    return postings(documents, key, text).crossJoin(F.broadcast(mean)).select(key, "term", weight.alias("weight"))


def query_vectors(questions: DataFrame, statistics: DataFrame, key: str = "query_id", text: str = "text", unknown: float = 3.0) -> DataFrame:
    """key, term, weight: question side, tf idf; a term that the corpus does not know has the idf ``unknown``."""
    tf = questions.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))
    return tf.join(statistics.select("term", "idf"), "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("weight"))


def drift(observed: Column, frozen: Column) -> Column:
    """Relative change of the mean document length since the statistics were frozen; null without frozen length."""
    return F.abs(observed - frozen) / F.when(frozen > 0, frozen)


def _best(scores: np.ndarray, ids: np.ndarray, source: np.ndarray, per_source: int, top: int) -> np.ndarray:
    """Places of the answers of one question that can be among its best: ``per_source`` of a source, ``top`` in all."""
    order = np.lexsort((ids, -scores))
    if per_source:
        by = order[np.argsort(source[order], kind="stable")]
        s = source[by]
        start = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(len(s)), 0))
        kept = by[np.arange(len(s)) - start < per_source]
        order = kept[np.lexsort((ids[kept], -scores[kept]))]
    return order[:top]


def search(
    documents: DataFrame, questions: DataFrame, per_source: int = 2, top: int = 10, k1: float = 1.5, b: float = 0.75,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """query_id, rank from 1, doc_id, source, score: the ``top`` documents of each question, ``per_source`` of one source at most.

    documents: ``key`` (a number or a string), ``source``, ``text``; questions: query_id, text, a batch of any size.
    Statistics are those of all documents, empty ones included. Documents that share no term with a question are no
    answer. Documents without a source share one cap; a cap of 0 is none. Equal scores (to six decimals) go by key. Null
    questions and those without terms have no answers; neither have empty tables.
    """
    asked = questions.where("query_id is not null and text is not null").select("query_id", "text")
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(chars) // MAX_QUESTION_CHARS))
    found = None
    for k in range(parts):
        part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        best = _search(documents, part, per_source, top, k1, b, key, source, text)
        found = best if found is None else found.unionByName(best)
    return found


def _search(documents: DataFrame, questions: DataFrame, per_source: int, top: int, k1: float, b: float, key: str, source: str, text: str) -> DataFrame:
    """search for questions that the driver holds."""
    spark = documents.sparkSession
    asked = {q: Counter(split_tokens(t)) for q, t in questions.collect()}
    asked = {q: c for q, c in asked.items() if c}
    kind = questions.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, doc_id {documents.schema[key].dataType.simpleString()}, source string, score double"
    rows = documents.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))

    vocabulary = sorted({t for c in asked.values() for t in c})
    place = {t: i for i, t in enumerate(vocabulary)}
    known = spark.sparkContext.broadcast(place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(known.value) + 1, dtype=np.int64), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ts = split_tokens(t)
                n, total = n + 1, total + len(ts)
                for w in set(ts):
                    df[known.value.get(w, -1)] += 1
        found = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found.tolist(), -1, -2]), pa.array([*df[found].tolist(), n, total])], names=["term", "n"]
        )

    counted = dict(rows.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    n, total = counted.get(-1, 0), counted.get(-2, 0)
    avgdl = total / n if n else 0.0
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], dtype=np.float64)
    weight = np.maximum(np.log((n - df + 0.5) / (df + 0.5) + 1.0), 0.0)

    names = list(asked)
    each = max(1, MAX_WEIGHTS // max(1, len(vocabulary)))
    found = None
    for at in range(0, len(names), each):
        mine = names[at : at + each]
        w = np.zeros((len(vocabulary), len(mine)))
        for j, q in enumerate(mine):
            for t, c in asked[q].items():
                w[place[t], j] = c * weight[place[t]]
        shared = spark.sparkContext.broadcast(w)

        def score(batches: Iterator[pa.RecordBatch], mine=mine, shared=shared, block: int = 4096) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            w, terms = shared.value, known.value
            for whole in batches:
                for start in range(0, whole.num_rows, block):
                    batch = whole.slice(start, block)
                    got = np.zeros((batch.num_rows, len(mine)))
                    for i, t in enumerate(batch.column(2).to_pylist()):
                        ts = split_tokens(t)
                        tf = Counter(terms[x] for x in ts if x in terms)
                        if tf:
                            ids = np.fromiter(tf, np.int64, len(tf))
                            f = np.fromiter(tf.values(), np.float64, len(tf))
                            got[i] = (f * (k1 + 1.0) / (f + k1 * (1.0 - b + b * len(ts) / avgdl))) @ w[ids]
                    got = np.round(got, 6)
                    doc = np.array(batch.column(0).to_pylist())
                    src = batch.column(1).dictionary_encode()
                    code = src.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    q, d = [], []
                    for j in range(len(mine)):
                        here = np.flatnonzero(got[:, j] > 0)
                        best = here[_best(got[here, j], doc[here], code[here], per_source, top)] if len(here) else here
                        q += [j] * len(best)
                        d += best.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([mine[j] for j in q], out.field(0).type), batch.column(0).take(pa.array(d, pa.int64())), batch.column(1).take(pa.array(d, pa.int64())), pa.array(got[d, q])], schema=out
                    )

        from pyspark.sql.pandas.types import to_arrow_schema

        out = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(spark.createDataFrame([], schema).schema)])
        part = rows.mapInArrow(score, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return rank_capped(found, "query_id", "source", [F.desc("score"), F.asc("doc_id")], per_source, top).select("query_id", "rank", "doc_id", "source", "score")


def rank_capped(answers: DataFrame, query: str, source: str, order: list[Column], per_source: int, top: int) -> DataFrame:
    """Answers with rank from 1: in ``order``, at most ``per_source`` of one source (null is one source), ``top`` of a query."""
    if per_source:
        answers = answers.withColumn("__place", F.row_number().over(Window.partitionBy(query, source).orderBy(*order))).where(F.col("__place") <= per_source).drop("__place")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)


def evaluation_search(spark: SparkSession, root: str) -> DataFrame:
    """The evaluation texts as a batch of questions over the documents."""
    questions = table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return search(table(spark, root, "documents"), questions)
