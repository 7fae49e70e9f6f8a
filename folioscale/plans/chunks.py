"""Registered queries over chunking and the smaller shapes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.operators import chat, chunking, packing, records
from folioscale.plans.collections import _MESSAGES_SQL, _messages
from folioscale.plans.documents import BLOCKS_SQL, _blocks, _heading_sql
from folioscale.session import table


def chunked(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of all extracts, with the digest of their texts."""
    c = chunking.chunk_records(_blocks(spark, root), 120, 25, 15)
    return c.select("chunk_id", "chunk_type", "char_start", "char_end", "page_start", "page_end", "parent_chunk_id", "words", F.md5("text").alias("digest"))


def chunk_totals(spark: SparkSession, root: str) -> DataFrame:
    """Section and table chunks: number and characters of each kind and paper."""
    c = chunking.chunk_records(_blocks(spark, root)).where("chunk_type in ('section', 'table', 'full')")
    return c.groupBy("paper_id", "chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def chunk_check(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose text is not the slice at their offsets, fine chunks outside their parent, and those over the budget and one unit."""
    blocks = _blocks(spark, root)
    c = chunking.chunk_records(blocks, 120, 25, 15)
    parents = c.where("chunk_type = 'section'").select(F.col("chunk_id").alias("parent_chunk_id"), F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    rows = c.join(records.full_texts(blocks), "paper_id").join(parents, "parent_chunk_id", "left")
    slice_ = F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.agg(
        F.count_if(slice_ != F.col("text")).alias("mismatches"), F.count_if((F.col("chunk_type") == "fine") & (F.col("a").isNull() | (F.col("char_start") < F.col("a")) | (F.col("char_end") > F.col("b")))).alias("outside"),
        F.count_if(F.col("char_end") <= F.col("char_start")).alias("empty"),
    )


def items(spark: SparkSession, root: str) -> DataFrame:
    """Blocks out of chunks read as content items: captions and table bodies with their context lines as captions."""
    c = table(spark, root, "chunks").select("paper_id", "chunk_id", "chunk_type", "text", "context_line", "figure_label", F.coalesce("page_start", F.lit(1)).alias("page")).distinct()
    rows = c.select(
        "paper_id", F.col("chunk_id").alias("seq"), F.when(F.col("chunk_type") == "table", "table").otherwise("text").alias("type"), "text",
        F.when(F.col("chunk_type") == "abstract", 1).alias("text_level"), (F.col("page") - 1).alias("page_idx"), F.array_compact(F.array("context_line")).alias("captions"), F.array_compact(F.array("figure_label")).alias("footnotes"),
    )
    return chunking.flattened(rows).select("paper_id", "i", "type", F.md5("text").alias("digest"), "page_idx", "level")


def line_sections(spark: SparkSession, root: str) -> DataFrame:
    return chunking.line_sections(table(spark, root, "extracts"), "paper_id", "markdown")


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Characters of each paper that its fine chunks cover, overlaps once."""
    c = table(spark, root, "chunks").where("chunk_type = 'fine'").select("paper_id", "char_start", "char_end").distinct()
    return chunking.covered(c, "paper_id", "char_start", "char_end")


def stripped(spark: SparkSession, root: str) -> DataFrame:
    """Texts of all chunks without their characters 10 to 20 and 40 to 45, where they are longer than 60."""
    c = table(spark, root, "chunks").where("length(text) > 60").select("chunk_id", "text").distinct()
    hole = lambda a, b: F.struct(F.lit(100 + a).cast("bigint").alias("from"), F.lit(100 + b).cast("bigint").alias("to"))
    return c.select("chunk_id", F.md5(chunking.without_holes(F.col("text"), F.lit(100).cast("bigint"), F.array(hole(10, 20), hole(40, 45)))).alias("digest"))


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """What an answer shows of each chunk: cut text, whether it spans pages, and its pages."""
    c = table(spark, root, "chunks").select("chunk_id", "text", "page_start", "page_end", "page_numbers")
    return c.select("chunk_id", F.md5(chunking.answer_payload(F.col("text"))).alias("digest"), F.coalesce(F.col("page_end") > F.col("page_start"), F.lit(False)).alias("spans"), F.array_join(F.array_sort(F.array_distinct("page_numbers")), ",").alias("pages")).distinct()


def resolved_questions(spark: SparkSession, root: str) -> DataFrame:
    """Messages with ``it``, ``this`` and ``that`` replaced by what the last answer speaks of."""
    rows = chat.previous_answers(_messages(spark, root).where("content is not null"), ("assistant", "Assistant", "ai", "bot"))
    subject = F.regexp_extract("answer", r"(?i)(?:the|a|an)\s+([A-Za-z0-9-]+(?:\s+[A-Za-z0-9-]+)?)\s+(?:is|was|are|were)(?:\s|$)", 1)
    said = chat.with_subject(F.col("content"), subject)
    return rows.where(F.col("answer").isNotNull()).select("id", F.md5(said).alias("digest"), (said != F.col("content")).alias("changed"))


def expanded_questions(spark: SparkSession, root: str) -> DataFrame:
    """Names of a small dictionary that each evaluation text holds: a theta join against a table sent to all."""
    known = spark.createDataFrame([("kinase", "enzyme"), ("uptake", "internalisation"), ("binding", "affinity"), ("half-life", "stability")], "term string, alias string")
    items_ = table(spark, root, "eval_items").select("item_id", F.lower("text").alias("t"))
    hits = items_.join(F.broadcast(known), F.contains("t", F.col("term")))
    return hits.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def median_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Median and 90th percentile of the characters of each chunk type, and the estimated tokens."""
    c = table(spark, root, "chunks").select("chunk_id", "chunk_type", F.length("text").alias("n")).distinct()
    return c.groupBy("chunk_type").agg(F.percentile("n", 0.5).alias("median"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.sum("n").alias("chars"))


def next_tasks(spark: SparkSession, root: str) -> DataFrame:
    """First three orders of each status in the queue: priority, then age."""
    o = table(spark, root, "orders").withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("int"))
    n = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("priority", "o_orderdate", "o_orderkey")).cast("bigint")
    return o.withColumn("place", n).where("place <= 3").select("o_orderstatus", "place", "o_orderkey")


def best_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Of each source, the document type of its longest document."""
    d = table(spark, root, "documents").where("source is not null")
    return d.groupBy("source").agg(F.max_by("doc_type", F.struct("n_chars", "doc_id")).alias("doc_type"), F.max("n_chars").alias("n_chars"))


def unprocessed(spark: SparkSession, root: str) -> DataFrame:
    """Catalog papers that no chunk has come from, and extracts without sections."""
    p, c, s, e = (table(spark, root, n).select("paper_id").distinct() for n in ("papers", "chunks", "sections", "extracts"))
    return p.join(c, "paper_id", "left_anti").withColumn("lacks", F.lit("chunks")).unionByName(e.join(s, "paper_id", "left_anti").withColumn("lacks", F.lit("sections")))


def merged_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Title and pages of each paper: the catalog's latest, else the extract's, else the file's stem."""
    from folioscale.plans.collections import _catalog

    e = table(spark, root, "extracts").select("paper_id", F.col("title").alias("t"), F.col("num_pages").alias("n"))
    stem = F.regexp_replace("file_name", r"(?i)\.pdf$", "")
    return _catalog(spark, root).join(e, "paper_id", "full_outer").select("paper_id", F.coalesce("title", "t", stem).alias("title"), F.coalesce("num_pages", "n").alias("num_pages"))


def flat_spans(spark: SparkSession, root: str) -> DataFrame:
    """Lines of each document packed without overlap into bins of at most 200 words; the largest bin number and size."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    sized = d.select("doc_id", "line_no", F.size(F.split("line", " ")).cast("bigint").alias("words"))
    out = packing.pack(sized, "doc_id", "line_no", "words", 200)
    return out.groupBy("doc_id", "bin").agg(F.count("*").alias("lines"), F.sum("words").alias("words"))


def response_fields(spark: SparkSession, root: str) -> DataFrame:
    """``KEY: value`` lines of a service's answer, here made of the events."""
    e = table(spark, root, "events").select("event_id", F.concat(F.lit("TYPE: "), "event_type", F.lit("\nUSER: "), F.col("user_id").cast("string"), F.lit("\nnoise")).alias("raw"))
    m = F.str_to_map("raw", F.lit("\n"), F.lit(": "))
    return e.select("event_id", m["TYPE"].alias("type"), m["USER"].alias("user"))


def queries() -> dict:
    with_b = lambda sql: f"WITH {BLOCKS_SQL}\n{sql}"
    return {
        "c12_4_chunks": (chunked, None),
        "c12_5_chunk_totals": (chunk_totals, None),
        "c12_6_table_chunks": (lambda s, r: chunked(s, r).where("chunk_type = 'table'").select("chunk_id", "char_start", "char_end", "digest"), with_b("SELECT paper_id || '_table_' || (row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1) AS chunk_id, char_start + page_char_start AS char_start, char_start + page_char_start + length(text) AS char_end, md5(text) AS digest FROM o WHERE type = 'table' AND text <> ''")),
        "c12_4_chunk_check": (chunk_check, "SELECT 0::BIGINT AS mismatches, 0::BIGINT AS outside, 0::BIGINT AS empty"),
        "c2_1_items": (items, """WITH c AS (SELECT DISTINCT paper_id, chunk_id, chunk_type, text, context_line, figure_label, coalesce(page_start, 1) - 1 AS page_idx FROM chunks),
p AS (SELECT paper_id, chunk_id, page_idx, 0 AS k, 'caption' AS type, context_line AS text, CASE WHEN chunk_type = 'abstract' THEN 1 END AS lv FROM c
  UNION ALL SELECT paper_id, chunk_id, page_idx, 1, CASE WHEN chunk_type = 'table' THEN 'table' WHEN chunk_type = 'abstract' THEN 'title' ELSE 'text' END, text, CASE WHEN chunk_type = 'abstract' THEN 1 END FROM c
  UNION ALL SELECT paper_id, chunk_id, page_idx, 2, 'footnote', figure_label, CASE WHEN chunk_type = 'abstract' THEN 1 END FROM c)
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page_idx, chunk_id, k) - 1 AS i, type, md5(text) AS digest, page_idx::BIGINT AS page_idx, 1::BIGINT AS level FROM p WHERE trim(coalesce(text, ''), ' ') <> ''"""),
        "c10_23_line_sections": (line_sections, f"""WITH l AS (SELECT paper_id, length(markdown) AS n, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS k FROM extracts WHERE markdown IS NOT NULL),
s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY paper_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, CASE WHEN length(line) <= 100 THEN {_heading_sql('line')} END AS name FROM l)
SELECT paper_id, name, start, coalesce(lead(start) OVER (PARTITION BY paper_id ORDER BY k), n) AS "end" FROM s WHERE name IS NOT NULL"""),
        "c5_29_coverage": (coverage, """WITH s AS (SELECT DISTINCT paper_id, char_start AS a, char_end AS b FROM chunks WHERE chunk_type = 'fine' AND char_start IS NOT NULL AND char_end IS NOT NULL),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY paper_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s), g AS (SELECT *, sum(fresh) OVER (PARTITION BY paper_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT paper_id, sum(n)::BIGINT AS covered FROM (SELECT paper_id, max(b) - min(a) AS n FROM g GROUP BY paper_id, island) GROUP BY paper_id"""),
        "c10_27_stripped": (stripped, "SELECT DISTINCT chunk_id, md5(regexp_replace(text[1:10] || text[21:40] || text[46:], '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM chunks WHERE length(text) > 60"),
        "c2_33_payloads": (payloads, "SELECT DISTINCT chunk_id, md5(CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END) AS digest, coalesce(page_end > page_start, false) AS spans, array_to_string(list_sort(list_distinct(page_numbers)), ',') AS pages FROM chunks"),
        "c10_61_resolved_questions": (resolved_questions, rf"""WITH {_MESSAGES_SQL.replace('conversation_id IS NOT NULL)', 'conversation_id IS NOT NULL AND content IS NOT NULL)')},
a AS (SELECT *, last_value(CASE WHEN role IN ('assistant', 'Assistant', 'ai', 'bot') THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer FROM msg),
s AS (SELECT id, content, nullif(regexp_extract(answer, '(?i)(?:the|a|an)\s+([A-Za-z0-9-]+(?:\s+[A-Za-z0-9-]+)?)\s+(?:is|was|are|were)(?:\s|$)', 1), '') AS subject FROM a WHERE answer IS NOT NULL),
r AS (SELECT id, content, CASE WHEN subject IS NULL THEN content ELSE regexp_replace(content, '(?i)\b(it|this|that)\b', subject, 'g') END AS said FROM s)
SELECT id, md5(said) AS digest, said <> content AS changed FROM r"""),
        "c4_13_expanded_questions": (expanded_questions, "SELECT item_id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM eval_items JOIN (VALUES ('kinase', 'enzyme'), ('uptake', 'internalisation'), ('binding', 'affinity'), ('half-life', 'stability')) k(term, alias) ON contains(lower(text), term) GROUP BY item_id"),
        "c5_31_median_sizes": (median_sizes, "SELECT chunk_type, quantile_cont(n, 0.5)::DOUBLE AS median, round(quantile_cont(n, 0.9)::DOUBLE, 6) AS p90, sum(n)::BIGINT AS chars FROM (SELECT DISTINCT chunk_id, chunk_type, length(text) AS n FROM chunks) GROUP BY chunk_type"),
        "c6_23_next_tasks": (next_tasks, "SELECT o_orderstatus, place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority[1:1]::INT, o_orderdate, o_orderkey)::BIGINT AS place FROM orders) WHERE place <= 3"),
        "c6_24_best_reasons": (best_reasons, "SELECT source, doc_type, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents WHERE source IS NOT NULL) WHERE n = 1"),
        "c8_6_unprocessed": (unprocessed, "SELECT DISTINCT paper_id, 'chunks' AS lacks FROM papers p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.paper_id = p.paper_id) UNION ALL SELECT DISTINCT paper_id, 'sections' FROM extracts e WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.paper_id = e.paper_id)"),
        "c1_10_merged_metadata": (merged_metadata, r"""WITH cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY indexed_at DESC NULLS LAST, num_pages DESC NULLS LAST, file_name) AS n FROM papers) WHERE n = 1)
SELECT coalesce(c.paper_id, e.paper_id) AS paper_id, coalesce(c.title, e.title, regexp_replace(file_name, '(?i)\.pdf$', '')) AS title, coalesce(c.num_pages, e.num_pages) AS num_pages FROM cat c FULL JOIN extracts e ON c.paper_id = e.paper_id"""),
        "c6_16_flat_spans": (flat_spans, """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL), z AS (SELECT doc_id, k, len(string_split(line, ' '))::BIGINT AS w FROM l),
r AS (SELECT doc_id, k, w, 0::BIGINT AS bin, w AS total FROM z WHERE k = 1 UNION ALL SELECT z.doc_id, z.k, z.w, bin + CASE WHEN total + z.w > 200 THEN 1 ELSE 0 END, CASE WHEN total + z.w > 200 THEN z.w ELSE total + z.w END FROM r JOIN z ON z.doc_id = r.doc_id AND z.k = r.k + 1)
SELECT doc_id, bin, count(*)::BIGINT AS lines, sum(w)::BIGINT AS words FROM r GROUP BY doc_id, bin"""),
        "c10_47_response_fields": (response_fields, "SELECT event_id, event_type AS type, user_id::VARCHAR AS \"user\" FROM events"),
    }
