"""Documents as blocks with exact offsets.

A block is (paper_id, i, type, text, page_idx, level). Blocks of a page are joined by a blank line, pages likewise; an empty
block has a span of no length and a page without text still takes its separator. Offsets are running sums, so a record
of any size is one sort by paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"
BODY = ("text", "title", "equation")
#: Headings and the sections that they open, first match wins. Fixed values, those of the reference.
SECTIONS = (
    (r"^(?:\d+\.?\s*)?results?\s*(?:and|&)\s*discussion", "results_discussion"), (r"^(?:\d+\.?\s*)?materials?\s*(?:and|&)\s*methods?", "methods"),
    (r"^(?:1\.?\s*)?(?:introduction|background)", "introduction"), (r"^(?:2\.?\s*)?(?:methods?|experimental\s*(?:section|procedures?)?)", "methods"),
    (r"^(?:3\.?\s*)?(?:results?)", "results"), (r"^(?:4\.?\s*)?(?:discussion)", "discussion"),
    (r"^(?:5\.?\s*)?(?:conclusion|conclusions|summary|concluding\s*remarks)", "conclusion"), (r"^abstract", "abstract"),
    (r"^(?:\d+\.?\s*)?(?:synthesis|synthetic\s*procedures?|general\s*synthesis)", "synthesis"),
    (r"^(?:\d+\.?\s*)?(?:characterization|compound\s*characterization)", "characterization"),
    (r"^(?:\d+\.?\s*)?(?:biological\s*evaluation|bioactivity|biological\s*activity)", "bioactivity"),
    (r"^(?:\d+\.?\s*)?(?:molecular\s*docking|docking\s*studies|computational)", "computational"),
    (r"^(?:\d+\.?\s*)?(?:structure[- ]activity|SAR|structure-activity\s*relationship)", "sar"),
    (r"^(?:references?|bibliography|literature\s*cited)", "references"), (r"^(?:acknowledg|funding|support|author\s*contributions)", "acknowledgments"),
    (r"^(?:supplementa|supporting\s*information|appendix|SI\s)", "supplementary"), (r"^(?:abbreviations?|glossary)", "abbreviations"),
)
NO_SECTION = r"^\s*(?:figure|fig\.?|table|scheme|chart|eq(?:uation)?)\s*\d"


def paper_id(file_name: Column) -> Column:
    """The first twelve digits of the MD5 of the file name as given."""
    return F.substring(F.md5(file_name), 1, 12)


def point_id(chunk_id: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """UUID version 5 of the chunk id in a namespace (hex, DNS by default)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def blocks_of(texts: DataFrame, key: str, text: str, lines_per_page: int = 10) -> DataFrame:
    """Blocks out of plain or Markdown texts, one a line: titles by ``#``, tables by ``|`` or ``<t``, else text.

    Null texts have no blocks; an empty text has one empty block. ``level`` is the number of ``#``, at least 1.
    """
    line = F.col("line")
    kind = F.when(line.rlike("^#{1,6} "), "title").when(line.rlike("^(?:\\||<t|<T|<html)"), "table").otherwise("text")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("paper_id"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    return rows.select(
        "paper_id", F.col("i").cast("bigint").alias("i"), kind.alias("type"), F.regexp_replace(line, "^#{1,6} +", "").alias("text"),
        F.floor(F.col("i") / lines_per_page).cast("bigint").alias("page_idx"),
        F.greatest(F.length(F.regexp_extract(line, "^(#{1,6}) ", 1)), F.lit(1)).cast("bigint").alias("level"),
    )


def reordered(blocks: DataFrame) -> DataFrame:
    """Blocks by page, then by their old number, numbered anew; ``was`` is the old number."""
    order = Window.partitionBy("paper_id").orderBy("page_idx", "i")
    return blocks.withColumn("was", F.col("i")).withColumn("i", (F.row_number().over(order) - 1).cast("bigint"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """Blocks with page_char_start, page_char_end, doc_char_start, doc_char_end.

    Within a page each text after the first non-empty one is preceded by a separator; each page after the first likewise,
    pages that have no block at all included.
    """
    size = F.length("text").cast("bigint")
    step = F.when(size > 0, size + len(SEPARATOR)).otherwise(0)
    page = Window.partitionBy("paper_id", "page_idx").orderBy("i")
    # an empty block stands at the end of the text before it, without a separator
    before = F.coalesce(F.sum(step).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.when(size > 0, before).otherwise(F.greatest(before - len(SEPARATOR), F.lit(0)))
    rows = blocks.withColumns({"page_char_start": start}).withColumn("page_char_end", F.col("page_char_start") + size)
    pages = page_index(blocks).select("paper_id", "page_idx", "char_start")
    rows = rows.join(pages, ["paper_id", "page_idx"])
    return rows.withColumns(
        {"doc_char_start": F.col("char_start") + F.col("page_char_start"), "doc_char_end": F.col("char_start") + F.col("page_char_end")}
    ).drop("char_start")


def page_index(blocks: DataFrame) -> DataFrame:
    """paper_id, page_idx, char_start, char_len, n_blocks, md5 (8 digits) of every page from 0 to the last, empty ones too."""
    spine = blocks.groupBy("paper_id").agg(F.max("page_idx").alias("last")).select("paper_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("page_idx"))
    texts = page_texts(blocks)
    rows = spine.join(texts, ["paper_id", "page_idx"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    order = Window.partitionBy("paper_id").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("page_text").cast("bigint")
    return rows.select(
        "paper_id", "page_idx", F.coalesce(F.sum(size + len(SEPARATOR)).over(order), F.lit(0)).alias("char_start"), size.alias("char_len"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.substring(F.md5("page_text"), 1, 8).alias("md5"),
    )


def page_texts(blocks: DataFrame) -> DataFrame:
    """paper_id, page_idx, page_text, n_blocks of every page with blocks."""
    said = F.transform(F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("i", "text")))), lambda b: b["text"])
    return blocks.groupBy("paper_id", "page_idx").agg(F.array_join(said, SEPARATOR).alias("page_text"), F.count("*").alias("n_blocks"))


def full_texts(blocks: DataFrame) -> DataFrame:
    """paper_id, full_text: all pages, empty ones included, joined."""
    spine = page_index(blocks).select("paper_id", "page_idx")
    rows = spine.join(page_texts(blocks), ["paper_id", "page_idx"], "left")
    said = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", F.coalesce("page_text", F.lit("")).alias("t")))), lambda b: b["t"])
    return rows.groupBy("paper_id").agg(F.array_join(said, SEPARATOR).alias("full_text"))


def body_texts(blocks: DataFrame) -> DataFrame:
    """paper_id, body_text: running prose in order, titles set off by blank lines."""
    said = F.when(F.col("type") == "title", F.concat(F.lit("\n\n"), "text", F.lit("\n"))).otherwise(F.col("text"))
    rows = blocks.where(F.col("type").isin(*BODY) & (F.length("text") > 0))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("t")))), lambda b: b["t"])
    return rows.groupBy("paper_id").agg(F.array_join(joined, "\n").alias("body_text"))


def verify(blocks: DataFrame) -> DataFrame:
    """paper_id, blocks_checked, mismatches of blocks against the slices of their page and of the whole text."""
    placed = with_offsets(blocks)
    rows = placed.join(page_texts(blocks).select("paper_id", "page_idx", "page_text"), ["paper_id", "page_idx"]).join(full_texts(blocks), "paper_id")
    part = lambda whole, a, b: F.substring(whole, F.col(a) + 1, F.col(b) - F.col(a))
    wrong = (part("page_text", "page_char_start", "page_char_end") != F.col("text")) | (part("full_text", "doc_char_start", "doc_char_end") != F.col("text"))
    return rows.groupBy("paper_id").agg(F.count("*").alias("blocks_checked"), F.count_if(wrong).alias("mismatches"))


def locate(blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """paper_id, offset, i, type, page_idx, page_char_offset: the block in which each offset lies; i is null in separators.

    offsets: paper_id, offset. Blocks and offsets are sorted together and each offset takes the last block begun, so no
    range join is needed. Blocks without text are nowhere.
    """
    b = with_offsets(blocks).where(F.length("text") > 0)
    place = F.struct("i", "type", "page_idx", "page_char_start", "doc_char_start", "doc_char_end")
    starts = b.select("paper_id", F.col("doc_char_start").alias("at"), F.lit(0).alias("asked"), place.alias("b"))
    asked = offsets.select("paper_id", F.col("offset").cast("bigint").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast(starts.schema["b"].dataType).alias("b"))
    last = F.last("b", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0))
    rows = starts.unionByName(asked).withColumn("b", last).where("asked = 1")
    inside = F.col("at") < F.col("b.doc_char_end")
    return rows.select(
        "paper_id", F.col("at").alias("offset"), *(F.when(inside, F.col(f"b.{c}")).alias(c) for c in ("i", "type", "page_idx")),
        F.when(inside, F.col("at") - F.col("b.doc_char_start") + F.col("b.page_char_start")).alias("page_char_offset"),
    )


def normalize_heading(text: Column) -> Column:
    """The canonical section that a heading opens, or null; tried as it is, without its number, and without letter spacing."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[#*_`]", "")), r"^[IVXLC]+\.\s*", "")
    spaced = F.regexp_replace(clean, r"(?<=\b\w) (?=\w\b)", "")
    found = F.lit(None).cast("string")
    for candidate in (spaced, F.regexp_replace(clean, r"^\d{1,2}(?:\.\d{1,2})*\.?[\s ]+", ""), clean):
        for pattern, name in reversed(SECTIONS):
            found = F.when(candidate.rlike("(?i)" + pattern), name).otherwise(found)
    return F.when((clean != "") & (F.length(clean) <= 160) & ~clean.rlike("(?i)" + NO_SECTION), found)


def heading_depth(text: Column) -> Column:
    """Depth by a heading's own number: 3 for ``3.1.4 ...``; null without one."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d{1,2}(?:\.\d{1,2})*)\.?[\s ]+\S", 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).cast("bigint")


def sections(blocks: DataFrame) -> DataFrame:
    """paper_id, id, name, normalized, level, title_block, block_start, block_end, parent_id, n_body_blocks, char_len.

    Blocks before the first heading are the front matter; a record without headings is one section. A section's parent is
    the last heading before it of a smaller level; a heading of no canonical name takes its parent's.
    """
    heads = blocks.where(F.col("type") == "title").select("paper_id", "i", F.trim("text").alias("name"), F.coalesce(heading_depth(F.col("text")), F.col("level")).alias("level"))
    ends = blocks.groupBy("paper_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("type") == "title", F.col("i"))).alias("first"))
    front = ends.where("first is null or first > 0").select(
        "paper_id", F.lit(None).cast("bigint").alias("i"), F.when(F.col("first").isNull(), "Document").otherwise("Front matter").alias("name"), F.lit(1).cast("bigint").alias("level"),
    )
    order = Window.partitionBy("paper_id").orderBy(F.asc_nulls_first("i"))
    rows = front.unionByName(heads).join(ends.select("paper_id", "n"), "paper_id")
    rows = rows.withColumns({"id": (F.row_number().over(order) - 1).cast("bigint"), "block_end": F.coalesce(F.lead("i").over(order), F.col("n"))})
    rows = rows.withColumn("block_start", F.coalesce(F.col("i") + 1, F.lit(0)))
    own = F.when(F.col("i").isNull(), F.when(F.col("name") == "Document", "body").otherwise("frontmatter")).otherwise(normalize_heading(F.col("name")))
    rows = rows.withColumn("own", own)
    # headings of one paper, in order, looked up from the end; the front matter is nobody's parent
    all_ = F.collect_list(F.when(F.col("i").isNotNull(), F.struct("id", "level", "own"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("parent", F.when(F.col("i").isNotNull(), F.try_element_at(F.filter(all_, lambda s: s["level"] < F.col("level")), F.lit(-1))))
    counted = blocks.where(F.col("type").isin(*BODY)).select("paper_id", F.col("i").alias("b"), F.length("text").cast("bigint").alias("size"), (F.col("type") == "title").alias("is_head"))
    # each body block belongs to the section last begun: the same sort of heads and blocks as in locate
    begun = rows.select("paper_id", F.col("block_start").alias("b"), F.lit(0).alias("k"), "id")
    walk = begun.unionByName(counted.where("not is_head").select("paper_id", "b", F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("id"), "size"), allowMissingColumns=True)
    of = F.last("id", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("b", "k").rowsBetween(Window.unboundedPreceding, 0))
    sizes = walk.withColumn("id", of).where("k = 1").groupBy("paper_id", "id").agg(F.count("*").alias("n_body_blocks"), F.sum("size").alias("char_len"))
    return rows.join(sizes, ["paper_id", "id"], "left").select(
        "paper_id", "id", "name", F.coalesce("own", "parent.own", F.lit("body")).alias("normalized"), "level", F.col("i").alias("title_block"), "block_start", "block_end",
        F.col("parent.id").alias("parent_id"), F.coalesce("n_body_blocks", F.lit(0)).alias("n_body_blocks"), F.coalesce("char_len", F.lit(0)).alias("char_len"),
    )


def statistics(blocks: DataFrame) -> DataFrame:
    """paper_id, n_pages, n_blocks, n_titles, n_tables, body_chars, total_chars."""
    size = F.length("text").cast("bigint")
    return blocks.groupBy("paper_id").agg(
        (F.max("page_idx") + 1).alias("n_pages"), F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "title").alias("n_titles"),
        F.count_if(F.col("type") == "table").alias("n_tables"), F.sum(F.when(F.col("type").isin(*BODY), size).otherwise(0)).alias("body_chars"), F.sum(size).alias("total_chars"),
    )


def body_runs(blocks: DataFrame) -> DataFrame:
    """Body blocks with ``run``: a new run begins after each block that is none (gaps and islands)."""
    order = Window.partitionBy("paper_id").orderBy("i")
    breaks = F.sum(F.when(F.col("type").isin(*BODY), 0).otherwise(1)).over(order)
    return blocks.withColumn("run", breaks.cast("bigint")).where(F.col("type").isin(*BODY) & (F.length("text") > 0))


def guessed_titles(blocks: DataFrame) -> DataFrame:
    """paper_id, title: the first title of page 0 that has 8 to 300 characters, else null."""
    fits = (F.col("type") == "title") & (F.col("page_idx") == 0) & F.length("text").between(8, 300)
    return blocks.groupBy("paper_id").agg(F.min_by("text", F.when(fits, F.col("i"))).alias("title"), F.count_if(fits).alias("n")).select("paper_id", F.when(F.col("n") > 0, F.col("title")).alias("title"))


def table_shape(html: Column) -> tuple[Column, Column]:
    """Rows, and cells of the first row, of an HTML table."""
    first = F.regexp_extract(html, r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|$)", 1)
    return F.regexp_count(html, F.lit(r"(?i)<tr\b")).cast("bigint"), F.regexp_count(first, F.lit(r"(?i)<t[dh]\b")).cast("bigint")
