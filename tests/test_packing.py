import random

import pytest
from pyspark.sql import functions as F

from folioscale.operators import packing, records
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def greedy(sizes, budget, overlap, least):
    spans, group = [], []
    for k, n in enumerate(sizes):
        if group and sum(sizes[j] for j in group) + n > budget:
            spans.append(group)
            back, used = [], 0
            for j in range(k - 1, -1, -1):
                if used + sizes[j] > overlap:
                    break
                back.insert(0, j)
                used += sizes[j]
            group = back
        group = [*group, k]
    spans.append(group)
    out = [[g[0], g[-1], sum(sizes[j] for j in g)] for g in spans]
    if len(out) > 1 and out[-1][2] < least:
        tail = out.pop()
        out[-1] = [out[-1][0], tail[1], out[-1][2] + tail[2]]
    return [tuple(x) for x in out]


def test_overlapping_spans_agree_with_a_loop(spark):
    rng = random.Random(1)
    groups = {f"g{i}": [rng.randint(0, 60) for _ in range(rng.randint(1, 25))] for i in range(60)}
    rows = spark.createDataFrame([(g, k, n) for g, ns in groups.items() for k, n in enumerate(ns)], "g string, at int, n int")
    got = {}
    for r in packing.pack_overlapping(rows, "g", "at", "n", 100, 25, 15).orderBy("g", "span").collect():
        got.setdefault(r.g, []).append((r["first"], r["last"], r.tokens))
    assert got == {g: greedy(ns, 100, 25, 15) for g, ns in groups.items()}
    assert packing.pack_overlapping(rows.limit(0), "g", "at", "n", 100, 25).count() == 0


def test_parent_windows(spark):
    parent = "".join(chr(97 + i % 26) for i in range(500)) + "NEEDLE in the stack" + "z" * 500
    rows = spark.createDataFrame([(parent, "NEEDLE in the stack"), (parent, "absent"), ("short", "x"), ("", "x"), (None, "x"), (parent, None)], "p string, c string")
    got = [r[0] for r in rows.select(packing.parent_window(F.col("p"), F.col("c"), 100)).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "NEEDLE in the stack" in got[0] and len(got[0]) == 106
    assert got[1] == got[5] == parent[:100] and got[2:5] == ["short", "", ""]


def test_offsets_hold_on_empty_blocks_and_astral_characters(spark):
    rows = [("p", 0, "text", "a😀b", 0, 1), ("p", 1, "text", "", 0, 1), ("p", 2, "table", "xy", 0, 1), ("p", 3, "text", "", 2, 1), ("p", 4, "text", "end", 3, 1), ("q", 0, "text", "", 0, 1)]
    blocks = spark.createDataFrame(rows, "paper_id string, i bigint, type string, text string, page_idx bigint, level bigint")
    got = {(r.paper_id, r.i): (r.doc_char_start, r.doc_char_end) for r in records.with_offsets(blocks).collect()}
    # page 0 is 'a😀b\n\nxy'; pages 1 and 2 are empty and still take their separators
    assert got == {("p", 0): (0, 3), ("p", 1): (3, 3), ("p", 2): (5, 7), ("p", 3): (11, 11), ("p", 4): (13, 16), ("q", 0): (0, 0)}
    assert records.verify(blocks).agg(F.sum("mismatches")).first()[0] == 0
    at = spark.createDataFrame([("p", 4), ("p", 5), ("p", 13), ("p", 15), ("p", 16)], "paper_id string, offset bigint")
    assert {r.offset: r.i for r in records.locate(blocks, at).collect()} == {4: None, 5: 2, 13: 4, 15: 4, 16: None}
