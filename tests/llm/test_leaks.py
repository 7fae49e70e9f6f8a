import random

import pytest

from folioscale.llm.leaks import find_leaks, leaks_of
from folioscale.session import local_session

RNG = random.Random(5)
WORD = lambda: "".join(RNG.choice("abcdefghijklmnoprstuvwz") for _ in range(6))
ITEMS = {i: [WORD() for _ in range(30 + 20 * i)] for i in range(4)}
NOISE = lambda n: [WORD() for _ in range(n)]


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def changed(words, every):
    return [WORD() if k % every == every - 1 else w for k, w in enumerate(words)]


DOCS = {
    1: (NOISE(50) + ITEMS[0] + NOISE(9), 0), 2: (NOISE(50) + ITEMS[1][:20] + NOISE(9), 1), 3: (NOISE(50) + ITEMS[1][:19] + NOISE(9), None),
    4: (changed(ITEMS[2], 11), 2), 5: (changed(ITEMS[2], 6), None), 6: (ITEMS[0][:6] + NOISE(6) + ITEMS[0][15:21], 0),
    7: (ITEMS[3][:20] + NOISE(200) + ITEMS[3][40:60], None), 8: (ITEMS[3][:20] + NOISE(20) + ITEMS[3][40:60], 3), 9: ([], None),
    10: (ITEMS[2][40:60] + NOISE(4) + ITEMS[2][:20], None),
}


def frame(spark):
    rows = [(d, " ".join(w), "x") for d, (w, _) in DOCS.items()] + [(11, None, "x"), (12, " ".join(ITEMS[0]).upper().replace(" ", ",  "), "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")


@pytest.mark.parametrize("slice_chars", [10**6, 200])
def test_whole_partial_changed_and_split_items(spark, slice_chars):
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()] + [(7, None), (None, "x y z"), (8, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks_of(frame(spark), items, slice_chars=slice_chars).collect()}
    assert got == {(d, i) for d, (_, i) in DOCS.items() if i is not None} | {(12, 0)}


def test_numbers_citations_and_offsets(spark):
    item = "the value of 0.04 nM rose to 1,200 in two of nine runs [3, 4] after day six"
    doc = "Before.  The value of 004 nM rose to 1200, in two of nine runs after day six. After"
    row = find_leaks(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), "doc_id", "text", [(5, item)]).collect()[0]
    assert row.share == 1.0 and doc[row.char_start : row.char_end] == doc[9:-6]


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks_of(frame(spark), none).count() == 0
    assert leaks_of(frame(spark).limit(0), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")).count() == 0
