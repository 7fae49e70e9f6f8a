import hashlib

import pytest
from pyspark.sql import functions as F

from folioscale.operators import objects as O
from folioscale.operators import records
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


PROSE = "The labelled protein was purified and kept cold until it was used. " * 6
BLOCKS = "paper_id string, i bigint, type string, text string, page_idx bigint, level bigint"


def test_the_abstract_is_found_on_each_route(spark):
    papers = {
        "heading": [("title", "Title of it"), ("title", "Abstract"), ("text", PROSE + "Keywords: a, b"), ("title", "Introduction"), ("text", PROSE * 2)],
        "marker": [("text", "Authors"), ("text", "Abstract: " + PROSE), ("title", "1. Introduction"), ("text", PROSE * 2)],
        "longest": [("text", "short"), ("text", PROSE), ("title", "Results"), ("text", PROSE * 2)],
        "none": [("text", "short"), ("title", "Methods"), ("text", PROSE)],
    }
    rows = [(p, i, kind, text, 0, 1) for p, blocks in papers.items() for i, (kind, text) in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {r.paper_id: (r.route, r.abstract) for r in O.abstracts(blocks, records.sections(blocks)).collect()}
    assert got == {p: (p, PROSE.strip()) for p in ("heading", "marker", "longest")}


def test_hashed_places(spark):
    terms = ["kinase", "β-sheet", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(O.term_index(F.col("t"))).collect()]
    assert got == [None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 2**22 for t in terms]


def test_boxes_paths_and_files(spark):
    row = spark.createDataFrame([([1.9, -2.9, 3.0, 4.0], [1.0], "a\\b/c.png", "")], "a array<double>, b array<double>, p string, q string")
    assert tuple(row.select(O.clean_box(F.col("a")), O.clean_box(F.col("b")), O.image_ref(F.col("p")), O.image_ref(F.col("q"))).first()) == ([1, -2, 3, 4], None, "figures/c.png", None)
    refs = spark.createDataFrame([("p", "a.png"), ("p", "gone.png")], "paper_id string, ref string")
    listing = spark.createDataFrame([("p", "a.png", 5), ("p", "b.PNG", 6), ("p", "notes.txt", 7)], "paper_id string, ref string, size int")
    assert [r.ref for r in O.unreferenced(refs, listing).collect()] == ["b.PNG"]
    assert tuple(O.asset_report(refs, listing).first()) == ("p", 2, 1, 5, 2)


def test_objects_keep_their_parts_in_order(spark):
    rows = [("p", 5, 1, "caption", "figure", 1, "b"), ("p", 5, 0, "caption", "figure", 1, "a"), ("p", 2, 0, "body", "table", 0, "t"), ("p", 9, 0, "caption", "figure", 0, "first")]
    parts = spark.createDataFrame(rows, "paper_id string, owner int, i int, part string, kind string, page_idx bigint, text string")
    got = {r.object_id: (r.page, r.caption, r.body) for r in O.objects(parts).collect()}
    assert got == {"figure_0": (1, "first", ""), "figure_1": (2, "a\nb", ""), "table_0": (1, "", "t")}
    blocks = spark.createDataFrame([("p", 0, "caption", "x", "figure"), ("p", 1, "caption", "", "figure"), ("p", 2, "caption", "y", "table")], "paper_id string, i int, type string, text string, kind string")
    assert [r.text for r in O.captions(blocks, "table").collect()] == ["y"] and O.captions(blocks).count() == 2
