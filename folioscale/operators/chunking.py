"""From records to chunks, and the small shapes around blocks and chunks.

A chunk's text is a slice of its record's full text, so its offsets are exact by construction. Sizes are packed by a fold that
stays in the JVM; only sizes are gathered by section, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.operators import packing, records
from folioscale.session import ensure_checkpoint_dir

#: Sections that are not cut into chunks. Fixed values, those of the reference.
LEFT_OUT = ("references", "acknowledgments", "abbreviations")


def flattened(items: DataFrame) -> DataFrame:
    """Blocks out of content items: captions, body and footnotes of an item, in this order, blank ones left out.

    items: paper_id, seq, type, text, text_level, page_idx, captions, footnotes. A text with a level is a title.
    """
    part = lambda kind, text, k: F.struct(F.lit(k).alias("k"), kind.alias("type"), text.alias("text"))
    kind = F.when((F.col("type") == "text") & (F.col("text_level") > 0), "title").otherwise(F.col("type"))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.transform(F.coalesce("captions", none), lambda c: part(F.lit("caption"), c, 0)), F.array(part(kind, F.col("text"), 1)),
        F.transform(F.coalesce("footnotes", none), lambda c: part(F.lit("footnote"), c, 2)),
    )
    kept = F.filter(parts, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    rows = items.select("paper_id", "seq", "page_idx", F.greatest(F.coalesce("text_level", F.lit(1)), F.lit(1)).cast("bigint").alias("level"), F.posexplode(kept).alias("pos", "p"))
    order = Window.partitionBy("paper_id").orderBy("page_idx", "seq", "pos")
    return rows.select("paper_id", (F.row_number().over(order) - 1).cast("bigint").alias("i"), "p.type", "p.text", F.col("page_idx").cast("bigint").alias("page_idx"), "level")


def chunk_records(blocks: DataFrame, budget: int = 500, overlap: int = 100, least: int = 50, least_section: int = 100) -> DataFrame:
    """chunk_id, paper_id, chunk_type, text, char_start, char_end, page_start, page_end (from 1), parent_chunk_id, words.

    One section chunk a section of ``least_section`` characters or more, from its first to its last body block; fine chunks
    of about ``budget`` words with ``overlap`` inside it, one run of body blocks at a time, never across a table; one table
    chunk a table block; one full chunk a paper, its first section. A section whose only fine chunk is all of it has
    no fine chunk. Left-out sections give none.
    """
    placed = records.with_offsets(blocks)
    sections = records.sections(blocks).where(~F.col("normalized").isin(*LEFT_OUT)).select("paper_id", "id", F.coalesce("title_block", F.lit(-1)).alias("at"))
    # blocks take the section last begun; sections left out still end the one before
    begun = records.sections(blocks).select("paper_id", F.coalesce("title_block", F.lit(-1)).alias("at"), F.lit(0).alias("k"), "id")
    walk = begun.unionByName(placed.withColumns({"at": F.col("i"), "k": F.lit(1)}), allowMissingColumns=True)
    order = Window.partitionBy("paper_id").orderBy("at", "k")
    walk = walk.withColumn("id", F.last("id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    walk = walk.withColumn("run", F.sum(F.when((F.col("k") == 0) | ~F.col("type").isin(*records.BODY), 1).otherwise(0)).over(order))
    body = walk.where((F.col("k") == 1) & F.col("type").isin("text", "equation") & (F.length("text") > 0)).join(sections.select("paper_id", "id"), ["paper_id", "id"], "left_semi")

    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")
    # read five times below: written once, so neither offsets nor sections are derived again
    ensure_checkpoint_dir(blocks.sparkSession)
    body = body.withColumn("words", words).drop("text").checkpoint()
    whole = body.groupBy("paper_id", "id").agg(
        F.min("doc_char_start").alias("char_start"), F.max("doc_char_end").alias("char_end"), F.min("page_idx").alias("p0"), F.max("page_idx").alias("p1"), F.sum("words").alias("words"),
    ).where(F.col("char_end") - F.col("char_start") >= least_section)
    sections_ = whole.select("paper_id", F.concat("paper_id", F.lit("_section_"), "id").alias("chunk_id"), F.lit("section").alias("chunk_type"), "char_start", "char_end", "p0", "p1", F.lit(None).cast("string").alias("parent_chunk_id"), "words")

    units = body.join(whole.select("paper_id", "id"), ["paper_id", "id"], "left_semi").withColumn("key", F.concat_ws("|", "paper_id", "id", "run"))
    units = units.withColumn("place", (F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1).cast("bigint"))
    spans = packing.pack_overlapping(units, "key", "place", "words", budget, overlap, least)
    ends = units.select("key", "place", "paper_id", "id", "run", "doc_char_start", "doc_char_end", "page_idx")
    first = ends.select("key", F.col("place").alias("first"), "paper_id", "id", "run", F.col("doc_char_start").alias("char_start"), F.col("page_idx").alias("p0"))
    last = ends.select("key", F.col("place").alias("last"), F.col("doc_char_end").alias("char_end"), F.col("page_idx").alias("p1"))
    fine = spans.join(first, ["key", "first"]).join(last, ["key", "last"])
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("char_start", "char_end")) - 1
    parent = F.concat("paper_id", F.lit("_section_"), "id")
    fine = fine.select("paper_id", F.concat("paper_id", F.lit("_fine_"), number).alias("chunk_id"), F.lit("fine").alias("chunk_type"), "char_start", "char_end", "p0", "p1", parent.alias("parent_chunk_id"), F.col("tokens").alias("words"))
    same = sections_.select(F.col("chunk_id").alias("parent_chunk_id"), "char_start", "char_end")
    fine = fine.join(same, ["parent_chunk_id", "char_start", "char_end"], "left_anti").select(sections_.columns)

    tables = placed.where((F.col("type") == "table") & (F.length("text") > 0)).withColumn("words", words)
    at = F.row_number().over(Window.partitionBy("paper_id").orderBy("i")) - 1
    tables = tables.select("paper_id", F.concat("paper_id", F.lit("_table_"), at).alias("chunk_id"), F.lit("table").alias("chunk_type"), F.col("doc_char_start").alias("char_start"), F.col("doc_char_end").alias("char_end"), F.col("page_idx").alias("p0"), F.col("page_idx").alias("p1"), F.lit(None).cast("string").alias("parent_chunk_id"), "words")
    firsts = F.row_number().over(Window.partitionBy("paper_id").orderBy("char_start"))
    full = sections_.withColumn("n", firsts).where("n = 1").drop("n").withColumns({"chunk_id": F.concat("paper_id", F.lit("_full")), "chunk_type": F.lit("full")})

    out = sections_.unionByName(fine).unionByName(tables).unionByName(full)
    out = out.join(records.full_texts(blocks), "paper_id")
    return out.select(
        "chunk_id", "paper_id", "chunk_type", F.substring("full_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"), "char_start", "char_end",
        (F.col("p0") + 1).alias("page_start"), (F.col("p1") + 1).alias("page_end"), "parent_chunk_id", "words",
    )


def line_sections(texts: DataFrame, key: str, text: str, longest: int = 100) -> DataFrame:
    """key, name, start, end: sections of plain texts whose headings are known lines of at most ``longest`` characters.

    Offsets are running sums of line lengths; a section ends where the next begins.
    """
    rows = texts.where(F.col(text).isNotNull()).select(key, F.length(text).cast("bigint").alias("n"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no")
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    name = F.when(F.length("line") <= longest, records.normalize_heading(F.col("line")))
    heads = rows.withColumns({"start": before, "name": name}).where("name is not null")
    return heads.select(key, "name", "start", F.coalesce(F.lead("start").over(order), F.col("n")).alias("end"))


def covered(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered: characters in at least one of the spans, overlaps once (islands of a running maximum)."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return spans.where(f"{start} is not null and {end} is not null").withColumn("__n", fresh).groupBy(key).agg(F.sum("__n").alias("covered"))


def without_holes(text: Column, start: Column, holes: Column) -> Column:
    """The text, which begins at ``start`` of its document, without the holes (from, to; sorted, apart, inside it); blank lines squeezed."""
    cuts = F.transform(holes, lambda h: F.struct((h["from"] - start).alias("a"), (h["to"] - start).alias("b")))
    kept = F.aggregate(
        cuts, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, c: F.struct(F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (c["a"] - s["at"]).cast("int"))).alias("out"), c["b"].cast("bigint").alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))),
    )
    return F.regexp_replace(kept, r"\n{3,}", "\n\n")


def answer_payload(text: Column, limit: int = 500) -> Column:
    """The text's first ``limit`` characters, with dots where more follows."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
