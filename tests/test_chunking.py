import pytest
from pyspark.sql import functions as F

from folioscale.operators import chunking, records
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def words(n, word="word"):
    return " ".join([word] * n)


def test_chunks_of_a_record(spark):
    texts = [("title", "# Introduction"), ("text", words(60)), ("text", words(60)), ("table", "| a | b |"), ("text", words(30)), ("title", "Results"), ("text", words(40)), ("title", "References"), ("text", words(90))]
    rows = [("p", i, kind, text, i // 3, 1) for i, (kind, text) in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "paper_id string, i bigint, type string, text string, page_idx bigint, level bigint")
    got = {r.chunk_id: r for r in chunking.chunk_records(blocks, 70, 10, 5, 50).collect()}
    full = records.full_texts(blocks).first().full_text
    assert all(full[r.char_start : r.char_end] == r.text for r in got.values())
    # the second section's only fine chunk would be all of it, so it has none; references give no chunk
    assert {k: r.words for k, r in got.items()} == {
        "p_section_0": 150, "p_section_1": 40, "p_fine_0": 60, "p_fine_1": 60, "p_fine_2": 30, "p_table_0": 5, "p_full": 150,
    }
    assert {r.parent_chunk_id for r in got.values() if r.chunk_type == "fine"} == {"p_section_0"}
    assert (got["p_section_0"].page_start, got["p_section_0"].page_end) == (1, 2)
    assert chunking.chunk_records(blocks.limit(0)).count() == 0


def test_items_flatten_in_order(spark):
    schema = "paper_id string, seq int, type string, text string, text_level int, page_idx int, captions array<string>, footnotes array<string>"
    rows = [("p", 0, "text", "Head", 2, 0, None, None), ("p", 2, "table", "<t>", None, 0, ["cap", " "], ["foot"]), ("p", 1, "text", " ", None, 1, None, None), ("p", 3, "image", None, None, 1, ["pic"], None)]
    got = chunking.flattened(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    assert [(r.i, r.type, r.text, r.level) for r in got] == [(0, "title", "Head", 2), (1, "caption", "cap", 1), (2, "table", "<t>", 1), (3, "footnote", "foot", 1), (4, "caption", "pic", 1)]


def test_coverage_counts_overlaps_once(spark):
    spans = spark.createDataFrame([("p", 0, 10), ("p", 5, 12), ("p", 6, 8), ("p", 20, 25), ("q", 3, 3), ("q", None, 4)], "k string, a bigint, b bigint")
    assert {r.k: r.covered for r in chunking.covered(spans, "k", "a", "b").collect()} == {"p": 17, "q": 0}


def test_holes(spark):
    hole = F.array(F.struct(F.lit(12).cast("bigint").alias("from"), F.lit(14).cast("bigint").alias("to")))
    assert spark.range(1).select(chunking.without_holes(F.lit("abXXcd"), F.lit(10).cast("bigint"), hole)).first()[0] == "abcd"
