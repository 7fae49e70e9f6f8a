"""Registered queries over catalog, conversations and logs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.operators import chat, library
from folioscale.session import table

TYPES = ["abstract", "section", "fine", "caption", "table", "full"]
DOMAIN = ["click", "error", "login", "purchase", "refund", "search", "view"]

CATALOG_SQL = """cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY indexed_at DESC NULLS LAST, num_pages DESC NULLS LAST, file_name) AS n FROM papers) WHERE n = 1)"""


def _catalog(spark: SparkSession, root: str) -> DataFrame:
    return library.latest(table(spark, root, "papers"), "paper_id", F.desc_nulls_last("indexed_at"), F.desc_nulls_last("num_pages"), F.col("file_name"))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("chunk_id", "paper_id", "chunk_type", "section_name", "page_end").distinct()


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "messages").where("conversation_id is not null").dropDuplicates(["id"])


_MESSAGES_SQL = """msg AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id)::BIGINT AS turn,
  row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC)::BIGINT AS from_end
  FROM (SELECT DISTINCT * FROM messages WHERE conversation_id IS NOT NULL))"""


def all_papers(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of every paper."""
    return _catalog(spark, root).select("paper_id", "title", "year", "num_pages", "file_name")


def list_papers(spark: SparkSession, root: str) -> DataFrame:
    """Second page of ten of the papers whose title, file or authors hold 'an', newest first."""
    text = F.lower(F.concat_ws(" ", "title", "file_name", F.array_join("authors", " ")))
    rows = _catalog(spark, root).where(F.contains(text, F.lit("an"))).select("paper_id", "title", "indexed_at")
    return library.page(rows, [F.desc_nulls_last("indexed_at"), F.asc("paper_id")], 10, 10).select("paper_id", "title", "total", "has_more")


def paper_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Chunk counts by type and last page of every paper of the catalog, and whether it is indexed."""
    counts = library.counts_by(_chunks(spark, root), "paper_id", "chunk_type", TYPES)
    last = _chunks(spark, root).groupBy("paper_id").agg(F.max("page_end").cast("bigint").alias("last_page"))
    out = _catalog(spark, root).select("paper_id").join(counts, "paper_id", "left").join(last, "paper_id", "left")
    names = [f"n_{t}" for t in TYPES] + ["total"]
    return out.select("paper_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), "last_page", F.when(F.coalesce("total", F.lit(0)) > 0, "indexed").otherwise("pending").alias("status"))


def corpus_facets(spark: SparkSession, root: str) -> DataFrame:
    """Chunks by type and section, with all totals, and the share of the corpus that each reaches."""
    c = _chunks(spark, root)
    total = c.agg(F.count("*").cast("double").alias("all"))
    cube = c.cube("chunk_type", "section_name").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return cube.crossJoin(F.broadcast(total)).select("chunk_type", "section_name", "level", "n", F.round(F.col("n") / F.col("all"), 6).alias("reach"))


def duplicate_texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose text another document has, each with the first of them and their number."""
    d = table(spark, root, "documents").where("text <> ''").select("doc_id", F.md5("text").alias("digest"))
    groups = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(groups, "digest").select("doc_id", "digest", "first_id", "copies")


def resolved_tokens(spark: SparkSession, root: str) -> DataFrame:
    return library.resolve(table(spark, root, "resolved"), table(spark, root, "papers"))


def id_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "resolved").select("token_no", library.looks_like_id(F.col("token")).alias("is_id"))


def cited_scores(spark: SparkSession, root: str) -> DataFrame:
    """Sources in the metadata of messages, flattened; malformed JSON counts as none."""
    rows = table(spark, root, "messages").select("id", F.try_parse_json("message_metadata").alias("v")).where("v is not null")
    rows = rows.select("id", F.try_variant_get("v", "$.query_type", "string").alias("query_type"), F.try_variant_get("v", "$.sources", "array<struct<n:bigint,score:double>>").alias("sources"))
    return rows.select("id", "query_type", F.inline("sources")).distinct()


def after_delete(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that stay by paper when the papers without a year are deleted."""
    gone = _catalog(spark, root).where("year is null")
    return library.without(_chunks(spark, root), gone, "paper_id").groupBy("paper_id").agg(F.count("*").alias("n"))


def upserted(spark: SparkSession, root: str) -> DataFrame:
    """Chunks by type after the table chunks have come in again as captions."""
    c = _chunks(spark, root).select("chunk_id", "chunk_type")
    incoming = c.where("chunk_type = 'table'").withColumn("chunk_type", F.lit("caption")).unionByName(c.where("chunk_type = 'full'").select(F.concat("chunk_id", F.lit("_new")).alias("chunk_id"), "chunk_type"))
    return library.upsert(c, incoming, "chunk_id").groupBy("chunk_type").agg(F.count("*").alias("n"))


def journal_state(spark: SparkSession, root: str) -> DataFrame:
    """Last event of every user, from a snapshot of January's first half and the journal after it."""
    e = table(spark, root, "events").select("user_id", "event_id", "event_type", "value", "ts")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    snapshot = library.latest(e.where(half), "user_id", F.desc("event_id"))
    return library.replayed(snapshot, e.where(~half), "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


def unique_files(spark: SparkSession, root: str) -> DataFrame:
    """File names cleaned for a file system, made unique over all ids."""
    p = table(spark, root, "papers").select("paper_id", "file_name").distinct().withColumn("clean", library.safe_name(F.col("file_name")))
    return library.unique_names(p, "clean", "paper_id", "file_name").select("paper_id", "file_name", "unique_name")


def name_differences(spark: SparkSession, root: str) -> DataFrame:
    """Paper ids of the catalog and of the extracts that the other lacks."""
    return library.differences(table(spark, root, "papers").select("paper_id").distinct(), table(spark, root, "extracts").select("paper_id").distinct())


def conversations(spark: SparkSession, root: str) -> DataFrame:
    """Every chat with the number of its messages and a digest of them in order; chats without messages included."""
    m = chat.numbered(_messages(spark, root)).withColumn("conversation_id", F.lower(F.trim("conversation_id")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.coalesce("content", F.lit("")).alias("c")))), lambda s: s["c"]), "\n")
    rows = m.groupBy("conversation_id").agg(F.count("*").alias("n"), F.md5(said).alias("digest"))
    return table(spark, root, "chats").join(rows, F.col("id") == F.col("conversation_id"), "left").select("id", "user_id", F.coalesce("n", F.lit(0)).alias("n"), "digest")


def user_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Chats of every user, newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    return table(spark, root, "chats").select("user_id", "id", F.row_number().over(order).cast("bigint").alias("place"))


def trimmed(spark: SparkSession, root: str) -> DataFrame:
    return chat.trimmed_history(_messages(spark, root), 6, 2).select("conversation_id", "id", "turn")


def budgeted(spark: SparkSession, root: str) -> DataFrame:
    return chat.history_within(_messages(spark, root), 1200).select("conversation_id", "id", "used")


def surviving(spark: SparkSession, root: str) -> DataFrame:
    return chat.survives_next_turn(_messages(spark, root), 1200)


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    return chat.transcripts(_messages(spark, root))


def golden_texts(spark: SparkSession, root: str) -> DataFrame:
    """Texts asked more than once, in one case and without outer blanks: first id, times, conversations."""
    m = _messages(spark, root).where("trim(content) <> ''")
    groups = m.groupBy(F.lower(F.trim("content")).alias("text")).agg(F.min("id").alias("first_id"), F.count("*").alias("occurrences"), F.count_distinct("conversation_id").alias("conversations"))
    return groups.where("occurrences > 1").select(F.md5("text").alias("digest"), "first_id", "occurrences", "conversations")


def conversation_totals(spark: SparkSession, root: str) -> DataFrame:
    m = _messages(spark, root)
    one = m.groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    return one.agg(F.count("*").alias("conversations"), F.sum("n").alias("messages"), F.sum("chars").alias("chars"), F.max("n").alias("longest"))


def type_distribution(spark: SparkSession, root: str) -> DataFrame:
    return library.over_domain(table(spark, root, "events"), "event_type", DOMAIN)


def recent_latency(spark: SparkSession, root: str) -> DataFrame:
    """Mean, median and largest value of the last hundred events of each type."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, root, "events").withColumn("n", n).where("n <= 100")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.max("value").alias("largest"))


def confidence_bands(spark: SparkSession, root: str) -> DataFrame:
    """Share of the last hundred events of each user in the bands of k / 100: 0.7 and more, 0.3 to 0.7, less."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, root, "events").withColumn("n", n).where("n <= 100").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return rows.groupBy("user_id").agg(share(F.col("k") >= 70).alias("high"), share(F.col("k").between(30, 69)).alias("middle"), share(F.col("k") < 30).alias("low"))


def top_entities(spark: SparkSession, root: str) -> DataFrame:
    """Five most frequent sources of each document type."""
    return library.top_of_each(table(spark, root, "documents").where("doc_type is not null and source is not null"), "doc_type", "source", 5)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each user: events at most an hour apart, with their number and sum."""
    e = table(spark, root, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "value")


def hourly(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour and type with the totals of each hour."""
    e = table(spark, root, "events").withColumn("hour", F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH"))
    return e.rollup("hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).where("hour is not null")


def as_of(spark: SparkSession, root: str) -> DataFrame:
    """Each error with the last view of its user before it: sorted together, no theta join."""
    e = table(spark, root, "events").where("event_type in ('error', 'view')")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(before))
    return rows.where("event_type = 'error'").select("event_id", "view_id")


def rate_limited(spark: SparkSession, root: str) -> DataFrame:
    """Events of each user with the number in the six hours up to each."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-21600, 0)
    return table(spark, root, "events").select("event_id", F.count("*").over(w).alias("n"))


def relational_pricing(spark: SparkSession, root: str) -> DataFrame:
    """Sums and means of line items by flag and status."""
    li = table(spark, root, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def relational_revenue(spark: SparkSession, root: str) -> DataFrame:
    """Revenue by nation: customers, orders, line items and suppliers of one nation."""
    t = lambda n: table(spark, root, n)
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def relational_top(spark: SparkSession, root: str) -> DataFrame:
    """Three best customers of each segment by order value."""
    o = table(spark, root, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = o.join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "c_custkey")).cast("bigint")
    return rows.withColumn("place", n).where("place <= 3").select("c_mktsegment", "place", "c_custkey", "spent")


def queries() -> dict:
    counts = ", ".join(f"count(*) FILTER (chunk_type = '{t}')::BIGINT AS n_{t}" for t in TYPES)
    shown = ", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in TYPES)
    ck = "ck AS (SELECT DISTINCT chunk_id, paper_id, chunk_type, section_name, page_end FROM chunks)"
    msg = lambda sql: f"WITH {_MESSAGES_SQL}\n{sql}"
    size = "coalesce(length(content), 0)"
    within = f"used AS (SELECT * FROM (SELECT *, sum({size}) OVER (PARTITION BY conversation_id ORDER BY from_end)::BIGINT AS used FROM msg) WHERE used <= 1200)"
    named = r"CASE WHEN lower({0}) LIKE '%.pdf' THEN {0} ELSE {0} || '.pdf' END"
    last = r"trim(regexp_extract(token, '[^/\\]*$'))"
    return {
        "c5_7_all_papers": (all_papers, f"WITH {CATALOG_SQL} SELECT paper_id, title, year, num_pages, file_name FROM cat"),
        "c7_1_list_papers": (list_papers, f"""WITH {CATALOG_SQL}, m AS (SELECT * FROM cat WHERE contains(lower(concat_ws(' ', title, file_name, array_to_string(authors, ' '))), 'an'))
SELECT paper_id, title, (SELECT count(*) FROM m)::BIGINT AS total, (SELECT count(*) FROM m) > 20 AS has_more FROM (SELECT * FROM m ORDER BY indexed_at DESC NULLS LAST, paper_id LIMIT 10 OFFSET 10)"""),
        "c5_8_paper_summaries": (paper_summaries, f"""WITH {CATALOG_SQL}, {ck}, s AS (SELECT paper_id, {counts}, count(*)::BIGINT AS total, max(page_end)::BIGINT AS last_page FROM ck GROUP BY paper_id)
SELECT cat.paper_id, {shown}, coalesce(total, 0) AS total, last_page, CASE WHEN total > 0 THEN 'indexed' ELSE 'pending' END AS status FROM cat LEFT JOIN s USING (paper_id)"""),
        "c5_16_corpus_facets": (corpus_facets, f"WITH {ck} SELECT chunk_type, section_name, grouping_id(chunk_type, section_name)::BIGINT AS level, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM ck)::DOUBLE, 6) AS reach FROM ck GROUP BY CUBE (chunk_type, section_name)"),
        "c3_6_duplicate_texts": (duplicate_texts, "SELECT doc_id, digest, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM (SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> '') WINDOW w AS (PARTITION BY digest) QUALIFY copies > 1"),
        "c4_8_resolved_tokens": (resolved_tokens, f"""WITH f AS (SELECT DISTINCT paper_id, file_name FROM papers), t AS (SELECT token_no, token, {named.format(last)} AS named FROM resolved)
SELECT token_no, token, coalesce(a, b, c) AS file_name, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'path' ELSE 'none' END AS via FROM (
  SELECT token_no, token, (SELECT min(file_name) FROM f WHERE paper_id = lower(token)) AS a, (SELECT min(file_name) FROM f WHERE file_name = token) AS b, (SELECT min(file_name) FROM f WHERE file_name = named) AS c FROM t)"""),
        "c3_12_id_tokens": (id_tokens, "SELECT token_no, coalesce(regexp_full_match(lower(token), '[0-9a-f]{12}'), false) AS is_id FROM resolved"),
        "c1_14_cited_scores": (cited_scores, """SELECT DISTINCT id, query_type, s.n AS n, s.score AS score FROM (SELECT id, json_extract_string(message_metadata, '$.query_type') AS query_type,
  unnest(from_json(json_extract(message_metadata, '$.sources'), '[{"n": "BIGINT", "score": "DOUBLE"}]')) AS s FROM (SELECT * FROM messages WHERE json_valid(message_metadata)))"""),
        "c8_7_after_delete": (after_delete, f"WITH {CATALOG_SQL}, {ck} SELECT paper_id, count(*)::BIGINT AS n FROM ck WHERE paper_id IS NULL OR paper_id NOT IN (SELECT paper_id FROM cat WHERE year IS NULL AND paper_id IS NOT NULL) GROUP BY paper_id"),
        "c1_17_upserted": (upserted, f"WITH {ck} SELECT chunk_type, count(*)::BIGINT AS n FROM (SELECT CASE WHEN chunk_type = 'table' THEN 'caption' ELSE chunk_type END AS chunk_type FROM ck UNION ALL SELECT 'full' FROM ck WHERE chunk_type = 'full') GROUP BY chunk_type"),
        "c1_25_journal_state": (journal_state, "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts >= '2024-01-16'::TIMESTAMP DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
        "c1_30_unique_files": (unique_files, rf"""WITH p AS (SELECT DISTINCT paper_id, file_name, regexp_replace(file_name, '[^\p{{L}}\p{{N}}._\- ]', '', 'g') AS k FROM papers), q AS (SELECT paper_id, file_name, {named.format('k')} AS clean FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY paper_id, file_name) - 1 AS n FROM q)
SELECT paper_id, file_name, CASE WHEN n = 0 THEN clean ELSE regexp_extract(clean, '^(.*?)(\.[^.]*)?$', 1) || '_' || n || regexp_extract(clean, '^(.*?)(\.[^.]*)?$', 2) END AS unique_name FROM n"""),
        "c8_8_differences": (name_differences, "(SELECT paper_id, 'left' AS side FROM (SELECT DISTINCT paper_id FROM papers EXCEPT SELECT paper_id FROM extracts)) UNION ALL (SELECT paper_id, 'right' FROM (SELECT DISTINCT paper_id FROM extracts EXCEPT SELECT paper_id FROM papers))"),
        "c4_15_conversations": (conversations, f"""WITH m AS (SELECT DISTINCT id, lower(trim(conversation_id)) AS c, content, created_at FROM messages WHERE conversation_id IS NOT NULL),
g AS (SELECT c, count(*)::BIGINT AS n, md5(string_agg(coalesce(content, ''), chr(10) ORDER BY created_at NULLS FIRST, id)) AS digest FROM m GROUP BY c) SELECT id, user_id, coalesce(n, 0) AS n, digest FROM chats LEFT JOIN g ON c = id"""),
        "c7_6_user_conversations": (user_conversations, "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, id)::BIGINT AS place FROM chats"),
        "c6_20_trimmed_history": (trimmed, msg("SELECT conversation_id, id, turn FROM msg WHERE turn <= 2 OR from_end <= 4")),
        "c6_21_history_within": (budgeted, msg(f"SELECT conversation_id, id, used FROM (SELECT *, sum({size}) OVER (PARTITION BY conversation_id ORDER BY from_end)::BIGINT AS used FROM msg) WHERE used <= 1200")),
        "c6_22_survives": (surviving, f"""WITH {_MESSAGES_SQL}, {within}, p AS (SELECT conversation_id, sum({size})::BIGINT AS s FROM msg GROUP BY conversation_id, (turn - 1) // 2 HAVING count(*) = 2),
l AS (SELECT conversation_id, max(s) AS next_turn FROM p GROUP BY conversation_id), u AS (SELECT conversation_id, max(used) AS used FROM used GROUP BY conversation_id)
SELECT u.conversation_id, u.used, coalesce(next_turn, 0) AS next_turn, u.used + coalesce(next_turn, 0) <= 1200 AS survives FROM u LEFT JOIN l USING (conversation_id)"""),
        "c10_63_transcripts": (transcripts, msg("SELECT conversation_id, string_agg(coalesce(role, '') || ': ' || coalesce(content, '')[1:150] || CASE WHEN length(content) > 150 THEN '...' ELSE '' END, chr(10) ORDER BY turn) AS transcript FROM msg WHERE from_end <= 4 GROUP BY conversation_id")),
        "c1_34_golden_texts": (golden_texts, msg("SELECT md5(t) AS digest, min(id) AS first_id, count(*)::BIGINT AS occurrences, count(DISTINCT conversation_id)::BIGINT AS conversations FROM (SELECT *, lower(trim(content, ' ')) AS t FROM msg WHERE trim(content, ' ') <> '') GROUP BY t HAVING count(*) > 1")),
        "c5_21_conversation_totals": (conversation_totals, msg(f"SELECT count(*)::BIGINT AS conversations, sum(n)::BIGINT AS messages, sum(c)::BIGINT AS chars, max(n)::BIGINT AS longest FROM (SELECT count(*) AS n, sum({size}) AS c FROM msg GROUP BY conversation_id)")),
        "c5_17_type_distribution": (type_distribution, "SELECT event_type, (SELECT count(*) FROM events e WHERE e.event_type = d.event_type)::BIGINT AS n FROM (SELECT unnest(['click', 'error', 'login', 'purchase', 'refund', 'search', 'view']) AS event_type) d"),
        "c5_19_recent_latency": (recent_latency, "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY event_type"),
        "c5_18_confidence_bands": (confidence_bands, "SELECT user_id, round(avg((k >= 70)::INT), 6) AS high, round(avg((k BETWEEN 30 AND 69)::INT), 6) AS middle, round(avg((k < 30)::INT), 6) AS low FROM (SELECT user_id, json_extract(props, '$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY user_id"),
        "c5_20_top_entities": (top_entities, "SELECT * FROM (SELECT doc_type, source, count(*)::BIGINT AS uses, row_number() OVER (PARTITION BY doc_type ORDER BY count(*) DESC, source)::BIGINT AS place FROM documents WHERE doc_type IS NOT NULL AND source IS NOT NULL GROUP BY doc_type, source) WHERE place <= 5"),
        "c11_sessions": (sessions, """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, s"""),
        "c2_13_hourly_rollup": (hourly, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY GROUPING SETS ((1), (1, 2))"),
        "c2_13_as_of": (as_of, "SELECT e.event_id, (SELECT arg_max(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND (v.ts, v.event_id) < (e.ts, e.event_id)) AS view_id FROM events e WHERE event_type = 'error'"),
        "c11_3_sliding_counts": (rate_limited, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events"),
        "r1_pricing": (relational_pricing, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= '1998-09-02'::TIMESTAMP GROUP BY 1, 2"),
        "r2_revenue": (relational_revenue, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
        "r3_top_customers": (relational_top, "SELECT c_mktsegment, place, c_custkey, spent FROM (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS spent, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey)::BIGINT AS place FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE place <= 3"),
    }
