"""Registered streaming queries: each stream runs over its whole table and its result is compared as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.streaming import operators as S


def _events(spark: SparkSession, root: str) -> DataFrame:
    return S.read_stream(spark, root, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    return S.run_available(S.document_frequencies(S.read_stream(spark, root, "documents")), "complete")


def tumbling(spark: SparkSession, root: str) -> DataFrame:
    out = S.run_available(S.windowed(_events(spark, root), "ts", ["event_type"], "6 hours"), "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


def sliding(spark: SparkSession, root: str) -> DataFrame:
    out = S.run_available(S.windowed(_events(spark, root), "ts", ["event_type"], "12 hours", slide="6 hours"), "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


def limiter(spark: SparkSession, root: str) -> DataFrame:
    """Events of each user that pass when two are allowed in six hours."""
    return S.run_available(S.rate_limited(_events(spark, root), "user_id", "at", "event_id", 2, 21600.0))


def rolling(spark: SparkSession, root: str) -> DataFrame:
    out = S.run_available(S.last_n_means(_events(spark, root), "event_type", "at", "event_id", "value", 100))
    return out.select("event_type", "event_id", F.round("mean", 9).alias("mean"))


def caches(spark: SparkSession, root: str) -> DataFrame:
    """Hits of one cache of twenty users for each kind of event, items at most a day old."""
    return S.run_available(S.cache_hits(_events(spark, root), "event_type", "at", "event_id", "user_id", 20, 86400.0))


def sentences(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of the notes and answers of each paper as its documents come in, one part a document."""
    d = S.read_stream(spark, root, "documents").where("doc_type in ('note', 'answer') and paper_id is not null")
    parts = d.select("paper_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("closing"))
    out = S.run_available(S.complete_sentences(parts, "paper_id", "doc_id", "text", "closing"))
    return out.select("paper_id", F.md5("sentence").alias("digest"))


def firsts(spark: SparkSession, root: str) -> DataFrame:
    """Users and kinds of event that occur at all, each once."""
    return S.run_available(S.first_of_each(_events(spark, root).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")).select("user_id", "event_type")


def queries() -> dict:
    token = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+\\d*|\\d+\\.?\\d*[a-z]*'), lambda t: length(t) >= 2 AND NOT list_contains({0}, t)))"
    from folioscale.operators.lexical import STOPWORDS

    stop = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
    return {
        "c11_14_stream_frequencies": (frequencies, f"SELECT term, count(*)::BIGINT AS df FROM (SELECT unnest({token.format(stop)}) AS term FROM documents) GROUP BY term"),
        "c11_tumbling": (tumbling, "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"),
        "c11_sliding": (sliding, "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - d * INTERVAL 6 HOUR, '%Y-%m-%d %H') AS start, count(*)::BIGINT AS n FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY 1, 2"),
        "c11_3_rate_limited": (limiter, """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, event_id, true AS allowed, sec AS a, -1e18::DOUBLE AS b FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, e.sec - b >= 21600, CASE WHEN e.sec - b >= 21600 THEN e.sec ELSE a END, CASE WHEN e.sec - b >= 21600 THEN a ELSE b END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, allowed FROM w"""),
        "c11_8_rolling_means": (rolling, "SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM events"),
        "c11_5_cache_hits": (caches, None),
        "c11_1_stream_sentences": (sentences, None),
        "c11_7_first_of_each": (firsts, "SELECT DISTINCT user_id, event_type FROM events"),
    }
