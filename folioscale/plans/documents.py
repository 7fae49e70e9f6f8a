"""Registered queries over records, offsets, sections, packing and context, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators import packing, records
from folioscale.session import table

#: Blocks of all extracts and their pages.
BLOCKS_SQL = """
l AS (SELECT paper_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS i FROM extracts WHERE markdown IS NOT NULL),
b AS (SELECT paper_id, i::BIGINT AS i, CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 'title' WHEN regexp_matches(line, '^(\\||<t|<T|<html)') THEN 'table' ELSE 'text' END AS type,
  regexp_replace(line, '^#{1,6} +', '') AS text, (i // 10)::BIGINT AS page_idx, greatest(length(regexp_extract(line, '^(#{1,6}) ', 1)), 1)::BIGINT AS level FROM l),
p AS (SELECT paper_id, page_idx, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (text <> ''), '') AS page_text, count(*)::BIGINT AS n_blocks FROM b GROUP BY ALL),
pages AS (SELECT *, coalesce(sum(length(page_text) + 2) OVER (PARTITION BY paper_id ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM p),
f AS (SELECT paper_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_idx) AS full_text FROM p GROUP BY paper_id),
o AS (SELECT b.*, char_start, CASE WHEN text = '' THEN greatest(before - 2, 0) ELSE before END AS page_char_start FROM (
  SELECT *, coalesce(sum(CASE WHEN text <> '' THEN length(text) + 2 ELSE 0 END) OVER (PARTITION BY paper_id, page_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b) AS b
  JOIN pages USING (paper_id, page_idx))"""


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return records.blocks_of(table(spark, root, "extracts"), "paper_id", "markdown")


def block_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Offsets of every block in its page and in its document."""
    return records.with_offsets(_blocks(spark, root)).select("paper_id", "i", "type", "page_idx", "page_char_start", "page_char_end", "doc_char_start", "doc_char_end")


def page_index(spark: SparkSession, root: str) -> DataFrame:
    return records.page_index(_blocks(spark, root))


def full_texts(spark: SparkSession, root: str) -> DataFrame:
    return records.full_texts(_blocks(spark, root))


def body_texts(spark: SparkSession, root: str) -> DataFrame:
    return records.body_texts(_blocks(spark, root))


def offset_check(spark: SparkSession, root: str) -> DataFrame:
    """Mismatches of all blocks against their slices; there must be none."""
    return records.verify(_blocks(spark, root)).agg(F.sum("blocks_checked").alias("blocks_checked"), F.sum("mismatches").alias("mismatches"))


def located(spark: SparkSession, root: str) -> DataFrame:
    """The block at every fiftieth character of every document, and at its first separator."""
    blocks = _blocks(spark, root)
    ends = records.full_texts(blocks).select("paper_id", F.length("full_text").cast("bigint").alias("n"))
    offsets = ends.where("n > 0").select("paper_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(50).cast("bigint"))).alias("offset"))
    return records.locate(blocks, offsets)


def sections(spark: SparkSession, root: str) -> DataFrame:
    return records.sections(_blocks(spark, root))


def section_texts(spark: SparkSession, root: str) -> DataFrame:
    """Length and digest of the heading and body of every section (blocks matched to sections by their sorted order)."""
    blocks = _blocks(spark, root)
    begun = records.sections(blocks).select("paper_id", "id", F.coalesce("title_block", F.lit(0)).alias("at"))
    from pyspark.sql import Window

    walk = begun.withColumn("k", F.lit(0)).unionByName(blocks.select("paper_id", F.col("i").alias("at"), F.lit(1).alias("k"), "i", "type", "text"), allowMissingColumns=True)
    of = F.last("id", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0))
    rows = walk.withColumn("id", of).where(F.col("k").eqNullSafe(1) & F.col("type").isin(*records.BODY) & (F.length("text") > 0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda b: b["text"]), "\n")
    return rows.groupBy("paper_id", "id").agg(F.length(said).cast("bigint").alias("chars"), F.md5(said).alias("digest"))


def record_statistics(spark: SparkSession, root: str) -> DataFrame:
    return records.statistics(_blocks(spark, root))


def body_runs(spark: SparkSession, root: str) -> DataFrame:
    return records.body_runs(_blocks(spark, root)).select("paper_id", "i", "run")


def guessed_titles(spark: SparkSession, root: str) -> DataFrame:
    return records.guessed_titles(_blocks(spark, root))


def headings(spark: SparkSession, root: str) -> DataFrame:
    """Canonical names and depths of all section names."""
    s = table(spark, root, "sections").select("name").distinct()
    return s.select("name", records.normalize_heading(F.col("name")).alias("normalized"), records.heading_depth(F.col("name")).alias("depth"))


def table_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Rows and first-row cells of all chunks with an HTML table."""
    rows, cells = records.table_shape(F.col("text"))
    chunks = table(spark, root, "chunks").where(F.col("text").rlike("(?i)<tr[ >]"))
    return chunks.select("chunk_id", rows.alias("n_rows"), cells.alias("n_cells")).distinct()


def paper_ids(spark: SparkSession, root: str) -> DataFrame:
    """Catalog ids that are, or are not, those of their file names."""
    p = table(spark, root, "papers").select("paper_id", "file_name", records.paper_id(F.col("file_name")).alias("expected")).distinct()
    return p.select("paper_id", "file_name", "expected", F.col("paper_id").eqNullSafe(F.col("expected")).alias("same"))


def point_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("chunk_id", records.point_id(F.col("chunk_id")).alias("point_id")).distinct()


def packed(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of each paper packed into requests of at most 2,000 estimated tokens and eight chunks."""
    c = table(spark, root, "chunks").select("paper_id", "chunk_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size")).distinct()
    return packing.pack(c, "paper_id", "chunk_id", "size", 2000, 8)


def spans(spark: SparkSession, root: str) -> DataFrame:
    """Lines of each section packed into overlapping spans of about 120 words; held by a test against brute force."""
    s = table(spark, root, "sections").where("text is not null").select(F.concat("paper_id", F.lit("_"), "id").alias("section"), "text").distinct()
    units = s.select("section", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "unit"))
    return packing.pack_overlapping(units.select("section", "at", F.size(F.split("unit", " ")).alias("words")), "section", "at", "words", 120, 25, 15)


def section_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of chunks of one section name, in order of the chunk id, within each paper."""
    c = table(spark, root, "chunks").select("paper_id", "chunk_id", "section_name").distinct()
    return packing.runs(c, "paper_id", "chunk_id", "section_name")


def context_lines(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").select("chunk_id", "paper_id", "section_name", "page_start", "page_end").distinct()
    titles = table(spark, root, "extracts").select("paper_id", "title")
    line = packing.context_line(F.col("title"), F.col("section_name"), F.col("page_start"), F.col("page_end"))
    return c.join(titles, "paper_id", "left").select("chunk_id", line.alias("line"))


def fine_with_parents(spark: SparkSession, root: str) -> DataFrame:
    """Fine chunks with the digest of the window of their parent section."""
    c = table(spark, root, "chunks")
    fine = c.where("chunk_type = 'fine'").select("chunk_id", "parent_chunk_id", "text").distinct()
    out = packing.with_parents(fine, c.where("chunk_type = 'section'"), 800)
    return out.select("chunk_id", "parent_chunk_id", F.length("parent_context").cast("bigint").alias("chars"), F.md5("parent_context").alias("digest"))


def _heading_sql(text: str) -> str:
    tries = []
    clean = f"regexp_replace(trim(regexp_replace(coalesce({text}, ''), '[#*_`]', '', 'g')), '^[IVXLC]+\\.\\s*', '')"
    bare = f"regexp_replace({clean}, '^\\d{{1,2}}(\\.\\d{{1,2}})*\\.?\\s+', '')"
    for c in (clean, bare):
        tries += [f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for p, n in records.SECTIONS]
    return f"CASE WHEN {clean} = '' OR length({clean}) > 160 OR regexp_matches({clean}, '(?i){records.NO_SECTION}') THEN NULL {' '.join(tries)} END"


def queries() -> dict:
    with_b = lambda sql, more="": f"WITH {BLOCKS_SQL}{more}\n{sql}"
    depth = r"CASE WHEN regexp_matches({0}, '^\s*\d{{1,2}}(\.\d{{1,2}})*\.?\s+\S') THEN len(string_split(regexp_extract({0}, '^\s*(\d{{1,2}}(?:\.\d{{1,2}})*)', 1), '.')) END"
    heads = f""",
h AS (SELECT paper_id, i, trim(text) AS name, coalesce({depth.format('text')}, level)::BIGINT AS level FROM b WHERE type = 'title'),
e AS (SELECT paper_id, count(*)::BIGINT AS n, min(i) FILTER (type = 'title') AS first FROM b GROUP BY paper_id),
s0 AS (SELECT paper_id, NULL::BIGINT AS i, CASE WHEN first IS NULL THEN 'Document' ELSE 'Front matter' END AS name, 1::BIGINT AS level FROM e WHERE first IS NULL OR first > 0 UNION ALL SELECT * FROM h),
s AS (SELECT *, row_number() OVER w - 1 AS id, coalesce(lead(i) OVER w, n) AS block_end, coalesce(i + 1, 0) AS block_start,
  CASE WHEN i IS NULL THEN CASE WHEN name = 'Document' THEN 'body' ELSE 'frontmatter' END ELSE {_heading_sql('name')} END AS own FROM s0 JOIN e USING (paper_id) WINDOW w AS (PARTITION BY paper_id ORDER BY i NULLS FIRST)),
par AS (SELECT a.paper_id, a.id, max(c.id) AS parent_id FROM s a JOIN s c ON a.paper_id = c.paper_id AND c.id < a.id AND c.level < a.level AND c.i IS NOT NULL AND a.i IS NOT NULL GROUP BY ALL)"""
    return {
        "c2_5_block_offsets": (block_offsets, with_b("SELECT paper_id, i, type, page_idx, page_char_start, page_char_start + length(text) AS page_char_end, char_start + page_char_start AS doc_char_start, char_start + page_char_start + length(text) AS doc_char_end FROM o")),
        "c2_7_page_index": (page_index, with_b("SELECT paper_id, page_idx, char_start, length(page_text)::BIGINT AS char_len, n_blocks, md5(page_text)[1:8] AS md5 FROM pages")),
        "c2_8_full_texts": (full_texts, with_b("SELECT paper_id, full_text FROM f")),
        "c2_9_body_texts": (body_texts, with_b("SELECT paper_id, string_agg(CASE WHEN type = 'title' THEN chr(10) || chr(10) || text || chr(10) ELSE text END, chr(10) ORDER BY i) AS body_text FROM b WHERE type <> 'table' AND text <> '' GROUP BY paper_id")),
        "c2_10_section_texts": (section_texts, with_b("SELECT b.paper_id, s.id, length(string_agg(text, chr(10) ORDER BY b.i))::BIGINT AS chars, md5(string_agg(text, chr(10) ORDER BY b.i)) AS digest FROM b JOIN s ON b.paper_id = s.paper_id AND b.i >= coalesce(s.i, 0) AND b.i < s.block_end WHERE type <> 'table' AND text <> '' GROUP BY ALL", heads)),
        "c2_13_located": (located, with_b("""SELECT q.paper_id, q."offset", o.i, o.type, o.page_idx, q."offset" - (o.char_start + o.page_char_start) + o.page_char_start AS page_char_offset
FROM (SELECT paper_id, unnest(range(0, length(full_text), 50))::BIGINT AS "offset" FROM f WHERE full_text <> '') q
LEFT JOIN o ON o.paper_id = q.paper_id AND o.char_start + o.page_char_start <= q."offset" AND q."offset" < o.char_start + o.page_char_start + length(o.text)""")),
        "c2_14_offset_check": (offset_check, with_b("SELECT count(*)::BIGINT AS blocks_checked, count(*) FILTER (page_text[page_char_start + 1 : page_char_start + length(text)] <> text OR full_text[o.char_start + page_char_start + 1 : o.char_start + page_char_start + length(text)] <> text)::BIGINT AS mismatches FROM o JOIN pages USING (paper_id, page_idx) JOIN f USING (paper_id)")),
        "c2_15_record_statistics": (record_statistics, with_b("SELECT paper_id, max(page_idx) + 1 AS n_pages, count(*)::BIGINT AS n_blocks, count(*) FILTER (type = 'title')::BIGINT AS n_titles, count(*) FILTER (type = 'table')::BIGINT AS n_tables, coalesce(sum(length(text)) FILTER (type <> 'table'), 0)::BIGINT AS body_chars, sum(length(text))::BIGINT AS total_chars FROM b GROUP BY paper_id")),
        "c2_16_table_shapes": (table_shapes, r"SELECT DISTINCT chunk_id, len(regexp_extract_all(text, '(?i)<tr\b'))::BIGINT AS n_rows, len(regexp_extract_all(regexp_extract(text, '(?is)<tr\b[^>]*>(.*?)(?:</tr>|$)', 1), '(?i)<t[dh]\b'))::BIGINT AS n_cells FROM chunks WHERE regexp_matches(text, '(?i)<tr[ >]')"),
        "c2_17_guessed_titles": (guessed_titles, with_b("SELECT paper_id, arg_min(text, i) FILTER (type = 'title' AND page_idx = 0 AND length(text) BETWEEN 8 AND 300) AS title FROM b GROUP BY paper_id")),
        "c2_21_paper_ids": (paper_ids, "SELECT DISTINCT paper_id, file_name, md5(file_name)[1:12] AS expected, paper_id IS NOT DISTINCT FROM md5(file_name)[1:12] AS same FROM papers"),
        "c1_18_point_ids": (point_ids, """SELECT DISTINCT chunk_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', d[17:17]) - 1) % 4 + 1, 1) || d[18:20] || '-' || d[21:32] AS point_id
FROM (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS d FROM chunks)"""),
        "c6_9_sections": (sections, with_b("""SELECT s.paper_id, s.id, s.name, coalesce(s.own, pp.own, 'body') AS normalized, s.level, s.i AS title_block, s.block_start, s.block_end, par.parent_id,
  (SELECT count(*) FROM b WHERE b.paper_id = s.paper_id AND b.i >= s.block_start AND b.i < s.block_end AND type = 'text')::BIGINT AS n_body_blocks,
  coalesce((SELECT sum(length(text)) FROM b WHERE b.paper_id = s.paper_id AND b.i >= s.block_start AND b.i < s.block_end AND type = 'text'), 0)::BIGINT AS char_len
FROM s LEFT JOIN par USING (paper_id, id) LEFT JOIN s pp ON pp.paper_id = s.paper_id AND pp.id = par.parent_id""", heads)),
        "c6_13_body_runs": (body_runs, with_b("SELECT paper_id, i, run FROM (SELECT *, sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY i)::BIGINT AS run FROM b) WHERE type <> 'table' AND text <> ''")),
        "c10_19_headings": (headings, f"SELECT name, {_heading_sql('name')} AS normalized, {depth.format('name')}::BIGINT AS depth FROM (SELECT DISTINCT name FROM sections)"),
        "c6_19_packed_requests": (packed, """WITH RECURSIVE c AS (SELECT paper_id, chunk_id, size, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id, size) AS k FROM (SELECT DISTINCT paper_id, chunk_id, coalesce(length(text), 0)::BIGINT AS size FROM chunks)),
w AS (SELECT paper_id, chunk_id, size, k, 0::BIGINT AS bin, size AS total, 1 AS n FROM c WHERE k = 1
  UNION ALL SELECT c.paper_id, c.chunk_id, c.size, c.k, w.bin + CASE WHEN total + c.size > 2000 OR n >= 8 THEN 1 ELSE 0 END, CASE WHEN total + c.size > 2000 OR n >= 8 THEN 0 ELSE total END + c.size, CASE WHEN total + c.size > 2000 OR n >= 8 THEN 0 ELSE n END + 1
  FROM w JOIN c ON c.paper_id = w.paper_id AND c.k = w.k + 1)
SELECT paper_id, chunk_id, size, bin FROM w"""),
        "c6_14_spans": (spans, None),
        "c6_18_section_runs": (section_runs, """SELECT paper_id, chunk_id, section_name, (sum(CASE WHEN coalesce(before = section_name, false) THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY chunk_id) - 1)::BIGINT AS run
FROM (SELECT *, lag(section_name) OVER (PARTITION BY paper_id ORDER BY chunk_id) AS before FROM (SELECT DISTINCT paper_id, chunk_id, section_name FROM chunks))"""),
        "c10_28_context_lines": (context_lines, """WITH c AS (SELECT DISTINCT chunk_id, paper_id, section_name, page_start, page_end FROM chunks),
x AS (SELECT chunk_id, nullif(replace(trim(coalesce(title, '')), chr(10), ' ')[1:120], '') AS head,
  nullif(array_to_string(list_transform(string_split(lower(replace(coalesce(section_name, ''), '_', ' ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' '), '') AS named,
  CASE WHEN page_start IS NULL THEN NULL WHEN page_end <> page_start THEN 'p.' || page_start || '-' || page_end ELSE 'p.' || page_start END AS page FROM c LEFT JOIN extracts USING (paper_id))
SELECT chunk_id, coalesce('[' || nullif(concat_ws(' — ', head, nullif(concat_ws(', ', named, page), '')), '') || ']', '') AS line FROM x"""),
        "c4_1_fine_with_parents": (fine_with_parents, """WITH p AS (SELECT DISTINCT chunk_id AS parent_chunk_id, text AS parent FROM chunks WHERE chunk_type = 'section'),
f AS (SELECT DISTINCT chunk_id, parent_chunk_id, text, trim(coalesce(text, '')[1:400]) AS probe FROM chunks WHERE chunk_type = 'fine'),
x AS (SELECT f.chunk_id, f.parent_chunk_id, parent, probe, length(parent) AS n, CASE WHEN probe = '' THEN -1 WHEN strpos(parent, probe) > 0 THEN strpos(parent, probe) - 1 WHEN length(probe) > 80 THEN strpos(parent, probe[41:200]) - 1 ELSE -1 END AS found FROM f LEFT JOIN p USING (parent_chunk_id)),
y AS (SELECT *, greatest(0, least(n, greatest(0, found + length(probe) // 2 - 400) + 800) - 800) AS begin, least(n, greatest(0, found + length(probe) // 2 - 400) + 800) AS stop FROM x),
z AS (SELECT chunk_id, parent_chunk_id, CASE WHEN parent IS NULL THEN NULL WHEN parent = '' THEN '' WHEN n <= 800 THEN parent WHEN found < 0 THEN parent[1:800]
  ELSE CASE WHEN begin > 0 THEN '...' ELSE '' END || parent[begin + 1 : stop] || CASE WHEN stop < n THEN '...' ELSE '' END END AS w FROM y)
SELECT chunk_id, parent_chunk_id, length(w)::BIGINT AS chars, md5(w) AS digest FROM z"""),
    }
