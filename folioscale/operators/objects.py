"""Figures, tables and abstracts of records, names in headers, and hashed terms."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions.text import is_prose


def clean_box(box: Column) -> Column:
    """A box of exactly four numbers as integers, toward zero; null for any other."""
    return F.when(F.size(box) == 4, F.transform(box, lambda x: x.cast("int")))


def image_ref(path: Column, folder: str = "figures") -> Column:
    """Where an image is kept: the file's name under ``folder``; null for null and empty paths."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"{folder}/"), name))


def captions(blocks: DataFrame, kind: str | None = None) -> DataFrame:
    """paper_id, i, text of caption blocks, of one kind of object if named."""
    wanted = (F.col("type") == "caption") & (F.lit(True) if kind is None else F.col("kind") == kind)
    return blocks.where(wanted & (F.length("text") > 0)).select("paper_id", "i", "text")


def objects(parts: DataFrame) -> DataFrame:
    """paper_id, object_id, kind, page (from 1), caption, body, footnote: one row a figure or table, in order of page and block.

    parts: paper_id, owner (the object's block), i, part (caption, body, footnote), kind, page_idx, text. Texts of a part are
    joined in order; ids count from 0 within paper and kind.
    """
    said = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("i", "text")))), lambda s: s["text"]), "\n")
    rows = parts.groupBy("paper_id", "owner", "kind").agg(
        (F.min("page_idx") + 1).alias("page"), said("caption").alias("caption"), said("body").alias("body"), said("footnote").alias("footnote")
    )
    number = F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy("page", "owner")) - 1
    return rows.withColumn("object_id", F.concat("kind", F.lit("_"), number)).drop("owner")


def parse_object_id(name: Column) -> Column:
    """(kind, number) of ``figure_3`` or ``table_0``; null for others."""
    kind = F.regexp_extract(name, r"^(figure|table)_(\d+)$", 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.regexp_extract(name, r"^(figure|table)_(\d+)$", 2).cast("bigint").alias("number")))


def asset_report(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """paper_id, referenced, present, bytes, unreferenced: assets that records point to against the files there are.

    refs: paper_id, ref; listing: paper_id, ref, size.
    """
    r, there = refs.select("paper_id", "ref").distinct().withColumn("__r", F.lit(1)), listing.withColumn("__l", F.lit(1))
    both = r.join(there, ["paper_id", "ref"], "full_outer")
    hit = F.col("__r").isNotNull() & F.col("__l").isNotNull()
    return both.groupBy("paper_id").agg(
        F.count("__r").alias("referenced"), F.count_if(hit).alias("present"), F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("__r").isNull()).alias("unreferenced")
    )


def unreferenced(refs: DataFrame, listing: DataFrame, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """Files that no record points to and that have an image's suffix: the plan of what may be deleted."""
    image = F.lower(F.element_at(F.split("ref", r"\."), -1)).isin(*suffixes)
    return listing.where(image).join(refs.select("paper_id", "ref").distinct(), ["paper_id", "ref"], "left_anti")


def abstracts(blocks: DataFrame, sections: DataFrame, shortest: int = 150, longest: int = 6000) -> DataFrame:
    """paper_id, abstract, route: the text under an Abstract heading, else a block that begins with the word, else the longest
    prose block of the first two pages before the introduction; papers without any have no row.

    sections: as records.sections gives them. Keyword tails and the word itself are cut off.
    """
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)^\s*abstract\s*[:.\-]?\s*", ""), r"(?is)\s*key\s*words?\s*[:.\-].*$", ""), r"[ \t]+", " "))
    fits = lambda t: F.length(t).between(shortest, longest)
    text = blocks.where((F.col("type") == "text") & (F.trim("text") != "")).select("paper_id", "i", "page_idx", "text")
    named = sections.where("normalized = 'abstract'").select("paper_id", "block_start", "block_end")
    under = text.join(named, "paper_id").where("i >= block_start and i < block_end")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), " ")
    one = under.groupBy("paper_id").agg(clean(joined).alias("t")).select("paper_id", F.lit(1).alias("n"), F.lit("heading").alias("route"), F.lit(0).cast("bigint").alias("rank"), "t")
    body = sections.where("normalized in ('introduction', 'methods', 'results', 'results_discussion', 'discussion', 'conclusion') and title_block is not null")
    limit = body.groupBy("paper_id").agg(F.min("title_block").alias("stop"))
    lead = text.join(limit, "paper_id", "left").where("page_idx <= 1 and i < 60 and (stop is null or i < stop)")
    two = lead.where(F.col("text").rlike(r"(?i)^\s*abstract\b")).select("paper_id", F.lit(2).alias("n"), F.lit("marker").alias("route"), F.col("i").alias("rank"), clean(F.col("text")).alias("t"))
    three = lead.where(is_prose(F.col("text"))).select("paper_id", F.lit(3).alias("n"), F.lit("longest").alias("route"), (-F.length("text")).cast("bigint").alias("rank"), clean(F.col("text")).alias("t"))
    found = one.unionByName(two).unionByName(three).where(fits(F.col("t")))
    best = found.groupBy("paper_id").agg(F.min_by(F.struct("t", "route"), F.struct("n", "rank", "t")).alias("b"))
    return best.select("paper_id", F.col("b.t").alias("abstract"), "b.route")


def section_key(text: Column) -> Column:
    """The header ``[Title — Section, p.N]`` of a chunk without its page; null without header."""
    head = F.regexp_extract(text, r"^\[([^\]\n]+)\]", 1)
    bare = F.trim(F.regexp_replace(head, r",?\s*p\.\d+(?:-\d+)?$", ""))
    return F.when(bare != "", bare)


def header_names(text: Column, most: int = 15) -> Column:
    """Names in the lines after a text's first, up to the abstract: given name, middle initial, family name; once each."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    before = F.element_at(F.split(head, r"(?i)\babstract\b", 2), 1)
    lines = F.array_join(F.slice(F.split(F.trim(before), "\n"), 2, 4), "\n")
    clean = F.regexp_replace(F.regexp_replace(lines, r"\([^)]*\)", ""), r"[\d*†‡§#]+", "")
    found = F.regexp_extract_all(clean, F.lit(r"(\p{Lu}\p{Ll}+(?:[-']\p{Lu}?\p{Ll}+)?(?: \p{Lu}\.?)? \p{Lu}\p{Ll}+(?:[-']\p{Lu}?\p{Ll}+)?)"), F.lit(1))
    skip = F.lit(r"^(?:The|This|That|These|From|With|University|Department|Institute|Center|Laboratory|School) ")
    return F.slice(F.array_distinct(F.filter(found, lambda n: ~F.regexp_like(n, skip))), 1, most)


def term_index(term: Column, bits: int = 22) -> Column:
    """Place of a term in a space of 2 ** ``bits``: its 8-byte BLAKE2b digest, most significant byte first, modulo the size."""

    @F.pandas_udf("bigint")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % (1 << bits)).astype("Int64")

    return run(term)


def recent_sources(messages: DataFrame, sources: DataFrame, top: int = 5, most: int = 50) -> DataFrame:
    """conversation_id, paper_id, place: papers that answers cited, the ``top`` sources of each, newest first, ``most`` in all.

    messages: conversation_id, id, created_at; sources: id, n (its place in the answer), paper_id.
    """
    used = messages.join(sources.where(F.col("n") <= top), "id")
    last = used.groupBy("conversation_id", "paper_id").agg(F.max(F.struct("created_at", "id", (-F.col("n")).alias("n"))).alias("last"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("last"), "paper_id")).cast("bigint")
    return last.withColumn("place", place).where(F.col("place") <= most).select("conversation_id", "paper_id", "place")
