"""Registered queries over figures, tables, abstracts and names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators import objects as O
from folioscale.operators import records
from folioscale.plans.collections import _messages
from folioscale.plans.documents import _blocks
from folioscale.session import table


def figure_objects(spark: SparkSession, root: str) -> DataFrame:
    """Captions and tables as objects: a caption chunk is a figure, a table chunk a table with its label as footnote."""
    c = table(spark, root, "chunks").where("chunk_type in ('caption', 'table')").select("paper_id", "chunk_id", "chunk_type", "text", "figure_label", F.coalesce("page_start", F.lit(1)).alias("p")).distinct()
    row = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("text"))
    kind = F.when(F.col("chunk_type") == "table", "table").otherwise("figure")
    parts = F.when(F.col("chunk_type") == "table", F.array(row("body", F.col("text")), row("footnote", F.col("figure_label")))).otherwise(F.array(row("caption", F.col("text"))))
    rows = c.select("paper_id", F.col("chunk_id").alias("owner"), F.lit(0).alias("i"), kind.alias("kind"), (F.col("p") - 1).cast("bigint").alias("page_idx"), F.inline(parts))
    return O.objects(rows).select("paper_id", "object_id", "kind", "page", F.md5("caption").alias("caption"), F.md5("body").alias("body"), "footnote")


def object_ids(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "chunks").select(F.regexp_replace("chunk_id", "^[0-9a-f]+_(caption|table)_", "$1_").alias("name")).distinct()
    named = names.select(F.replace("name", F.lit("caption"), F.lit("figure")).alias("name")).distinct()
    return named.select("name", O.parse_object_id(F.col("name")).alias("o")).where("o is not null").select("name", "o.kind", "o.number")


def abstracts(spark: SparkSession, root: str) -> DataFrame:
    blocks = _blocks(spark, root)
    out = O.abstracts(blocks, records.sections(blocks))
    return out.select("paper_id", F.length("abstract").cast("bigint").alias("chars"), "route")


def section_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("chunk_id", O.section_key(F.col("context_line")).alias("section")).distinct()


def header_names(spark: SparkSession, root: str) -> DataFrame:
    """Names found in headers made of the catalog: a title line and a line of authors."""
    p = table(spark, root, "papers").where("title is not null").select("paper_id", "title", F.array_join("authors", ", ").alias("a")).distinct()
    return p.select("paper_id", F.array_join(O.header_names(F.concat("title", F.lit("\n"), F.coalesce("a", F.lit("")), F.lit("\nAbstract\nText"))), "; ").alias("names")).distinct()


def term_indices(spark: SparkSession, root: str) -> DataFrame:
    from folioscale.operators.lexical import tokens

    t = table(spark, root, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return t.select("term", O.term_index(F.col("term")).alias("place"))


def asset_reports(spark: SparkSession, root: str) -> DataFrame:
    """Figure labels as references against caption chunks as files."""
    c = table(spark, root, "chunks")
    refs = c.where("figure_label is not null and chunk_type = 'caption'").select("paper_id", O.image_ref(F.concat("figure_label", F.lit(".png"))).alias("ref"))
    listing = c.where("chunk_type = 'caption' and figure_label like '%1%'").select("paper_id", O.image_ref(F.concat("figure_label", F.lit(".png"))).alias("ref"), F.lit(7).alias("size")).distinct()
    return O.asset_report(refs, listing)


def recent_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources that each conversation's answers cited last, by their number."""
    v = _messages(spark, root).select("id", "conversation_id", "created_at", F.try_parse_json("message_metadata").alias("v"))
    s = v.where("v is not null").select("id", F.inline(F.try_variant_get("v", "$.sources", "array<struct<n:bigint,score:double>>"))).select("id", "n", F.concat(F.lit("source "), F.col("n").cast("string")).alias("paper_id")).distinct()
    return O.recent_sources(v.select("id", "conversation_id", "created_at"), s, 3, 4)


def queries() -> dict:
    return {
        "c2_27_figure_objects": (figure_objects, """WITH c AS (SELECT DISTINCT paper_id, chunk_id, chunk_type, text, figure_label, coalesce(page_start, 1)::BIGINT AS page FROM chunks WHERE chunk_type IN ('caption', 'table')),
k AS (SELECT *, CASE WHEN chunk_type = 'table' THEN 'table' ELSE 'figure' END AS kind FROM c)
SELECT paper_id, kind || '_' || (row_number() OVER (PARTITION BY paper_id, kind ORDER BY page, chunk_id) - 1) AS object_id, kind, page, md5(CASE WHEN kind = 'figure' THEN coalesce(text, '') ELSE '' END) AS caption, md5(CASE WHEN kind = 'table' THEN coalesce(text, '') ELSE '' END) AS body, CASE WHEN kind = 'table' THEN coalesce(figure_label, '') ELSE '' END AS footnote FROM k"""),
        "c2_28_object_ids": (object_ids, "SELECT DISTINCT name, regexp_extract(name, '^(figure|table)_(\\d+)$', 1) AS kind, regexp_extract(name, '^(figure|table)_(\\d+)$', 2)::BIGINT AS number FROM (SELECT replace(regexp_replace(chunk_id, '^[0-9a-f]+_(caption|table)_', '\\1_'), 'caption', 'figure') AS name FROM chunks) WHERE regexp_matches(name, '^(figure|table)_\\d+$')"),
        "c10_20_abstracts": (abstracts, None),
        "c10_68_section_keys": (section_keys, r"SELECT DISTINCT chunk_id, nullif(trim(regexp_replace(regexp_extract(context_line, '^\[([^\]\n]+)\]', 1), ',?\s*p\.\d+(?:-\d+)?$', ''), ' '), '') AS section FROM chunks"),
        "c10_33_header_names": (header_names, r"""SELECT DISTINCT paper_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i)[1:15], '; ') AS names FROM (SELECT paper_id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(array_to_string(list_slice(string_split(trim(regexp_extract(substr(title || chr(10) || coalesce(array_to_string(authors, ', '), '') || chr(10) || 'Abstract', 1, 2000), '(?is)^(.*?)(?:\babstract\b|$)', 1), ' '), chr(10)), 2, 5), chr(10)), '\([^)]*\)', '', 'g'), '[\d*†‡§#]+', '', 'g'),
  '(\p{Lu}\p{Ll}+(?:[-'']\p{Lu}?\p{Ll}+)?(?: \p{Lu}\.?)? \p{Lu}\p{Ll}+(?:[-'']\p{Lu}?\p{Ll}+)?)', 1), lambda x: NOT regexp_matches(x, '^(?:The|This|That|These|From|With|University|Department|Institute|Center|Laboratory|School) ')) AS n FROM papers WHERE title IS NOT NULL)"""),
        "c9_3_term_indices": (term_indices, None),
        "c2_24_asset_reports": (asset_reports, """WITH r AS (SELECT DISTINCT paper_id, 'figures/' || figure_label || '.png' AS ref FROM chunks WHERE figure_label IS NOT NULL AND chunk_type = 'caption')
SELECT paper_id, count(*)::BIGINT AS referenced, count(*) FILTER (contains(ref, '1'))::BIGINT AS present, (7 * count(*) FILTER (contains(ref, '1')))::BIGINT AS bytes, 0::BIGINT AS unreferenced FROM r GROUP BY paper_id"""),
        "c11_19_recent_sources": (recent_sources, """WITH m AS (SELECT DISTINCT id, conversation_id, created_at, message_metadata FROM messages WHERE conversation_id IS NOT NULL AND json_valid(message_metadata)),
s AS (SELECT DISTINCT id, conversation_id, created_at, s.n AS n FROM (SELECT *, unnest(from_json(json_extract(message_metadata, '$.sources'), '[{"n": "BIGINT"}]')) AS s FROM m) WHERE s.n <= 3),
l AS (SELECT conversation_id, n, created_at, id, row_number() OVER (PARTITION BY conversation_id, n ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM s)
SELECT conversation_id, 'source ' || n AS paper_id, place FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC, n)::BIGINT AS place FROM l WHERE k = 1) WHERE place <= 4"""),
    }
