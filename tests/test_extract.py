import pytest
from pyspark.sql import functions as F

from folioscale.functions import extract as E
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


@pytest.mark.parametrize("text, found", [
    ("see Figures 3 and 4", [("figure", "3", None), ("figure", "4", None)]), ("Fig. 3a,b", [("figure", "3", "a"), ("figure", "3", "b")]), ("Table II", [("table", "2", None)]),
    ("Figure S1", [("figure", "S1", None)]), ("Fig1abc", []), ("Fig. 3(A) and 50:50 for", [("figure", "3", "a")]), ("Figs. 2–4", [("figure", "2", None), ("figure", "4", None)]),
    ("Scheme 13.1", [("scheme", "13.1", None)]), ("figment 3", []), (None, []), ("", []),
])
def test_mentions(text, found):
    got = E.mentions(text)
    assert [(m["kind"], m["number"], m["panel"]) for m in got] == found
    assert all(0 <= m["start"] < m["end"] <= len(text) for m in got)


def test_label_numbers():
    assert [E.label_number(x) for x in ("10.0", "XXXIX", "ESI-3", "S2", "IV", "A", "1234", "10")] == ["10", "39", "S3", "S2", "4", None, None, "10"]


@pytest.mark.parametrize("text, found", [
    ("an IC50 of 12 nM", ("ic50", 12.0, "nM")), ("stirred at 80 °C", ("temperature", 80.0, "°C")), ("MIC < 0.5 µg/mL", ("mic", 0.5, "µg/mL")), ("85% yield was", ("yield", 85.0, "%")),
    ("1.2 x 10^3 nM", ("concentration", 1200.0, "nM")), ("after 3 h", ("time", 3.0, "h")), ("a wavelength of 488 nm", ("wavelength", 488.0, "nm")),
])
def test_facts(text, found):
    got = E.facts(text)
    assert [(f["property"], pytest.approx(f["value"]), f["unit"]) for f in got] == [found]


def test_facts_are_told_once_with_their_entity():
    assert [f["entity"] for f in E.facts("Api137 has a Kd of 3 nM. Api137 has a Kd of 3 nM. SRC-2 has a Kd of 3 nM")] == ["Api137", "SRC-2"]
    assert E.facts("12 apples") == E.facts(None) == []


def test_table_grids():
    html = "<table><tr><th rowspan=2>Name</th><th colspan=2>Assay</th></tr><tr><th>A</th><th>B</th></tr><tr><td>x</td><td>1.5 nM</td><td>2</td></tr><tr><td>y<td>3</table>"
    assert E.grid(html) == [["Name", "Assay", "Assay"], ["Name", "A", "B"], ["x", "1.5 nM", "2"], ["y", "3", ""]]
    assert E.header_depth(E.grid(html)) == 2
    assert E.table_facts(html)[0] == {"entity": "x", "column": "Assay A", "value_text": "1.5 nM"} and len(E.table_facts(html)) == 3
    assert E.grid(None) == E.table_facts("") == [] and E.rendered(html, 2).endswith("(2 more rows)")


def test_sequences_of_labels(spark):
    cases = {"gap": [2, None, None, 5], "wrong": [2, None, None, 4], "blank": [None] * 3, "ends": [None, 3, None], "low": [None, None, 2]}
    rows = [(p, k, n) for p, ns in cases.items() for k, n in enumerate(ns)]
    got = E.labels_by_sequence(spark.createDataFrame(rows, "paper_id string, at int, number bigint")).orderBy("at").collect()
    filled = {p: [r.filled for r in got if r.paper_id == p] for p in cases}
    assert filled == {"gap": [2, 3, 4, 5], "wrong": [2, None, None, 4], "blank": [1, 2, 3], "ends": [2, 3, 4], "low": [None, 1, 2]}


def test_mentions_meet_their_objects(spark):
    said = spark.createDataFrame([("p", "figure", "1"), ("p", "scheme", "2"), ("p", "table", "3"), ("q", "figure", "1")], "paper_id string, kind string, number string")
    labels = spark.createDataFrame([("p", "figure", "1", "f1"), ("p", "figure", "2", "f2"), ("p", "figure", "3", "f3")], "paper_id string, kind string, number string, target string")
    got = {(r.paper_id, r.kind): (r.target, r.how) for r in E.resolved_mentions(said, labels).collect()}
    assert got == {("p", "figure"): ("f1", "exact"), ("p", "scheme"): ("f2", "family"), ("p", "table"): (None, None), ("q", "figure"): (None, None)}


def test_columns(spark):
    rows = spark.createDataFrame([("Figure 1. x", "ＡＢ  –₂"), (None, None)], "a string, b string")
    got = rows.select(E.label_of(F.col("a")).alias("l"), E.folded_text(F.col("b")).alias("f"), F.size(E.mentions_of(F.col("a"))).alias("n")).collect()
    assert (got[0].l.kind, got[0].l.number, got[0].f, got[0].n) == ("figure", "1", "ab -2", 1) and got[1].l.kind is None and got[1].f == ""
