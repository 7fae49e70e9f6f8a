import pytest

from folioscale.llm import scans
from folioscale.llm.scans import repair_scans, unpaged, unwrapped
from folioscale.session import local_session

WORDS = ["The tissue was cross-linked before binding of the labelled precursor.", "Uptake of the precursor by cells was measured in the tissue.",
         "Correlated binding of cross-linked tissue was required for uptake."]
SCAN = "Uptake of the precursor by cells was mea-\nsured in the ti5sue and bincling of the\nMEMBRANE TRANSPORT\n[334]\nlabelled pre¬\ncursor was cross-\nlinked before it was requirecl again."


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"w{i}", WORDS[i % 3]) for i in range(90)]
    rows += [("scan", SCAN), ("null", None), ("empty", ""), ("plain", "Line one of a poem\nline two of it"), ("twice", "ti5sue"), ("twice", "ti5sue")]
    return spark.createDataFrame([(a, b, "k") for a, b in rows], "rec_id string, text string, key string")


@pytest.mark.parametrize("most", [200_000, 0])
def test_all_repairs(records, monkeypatch, most):
    monkeypatch.setattr(scans, "MAX_BROADCAST", most)
    rows = repair_scans(records, ["rec_id"], "text").collect()
    assert len(rows) == 96
    got = {r.rec_id: r for r in rows}
    assert got["scan"].repaired == (
        "Uptake of the precursor by cells was measured in the tissue and binding of the labelled precursor was cross-linked before it was required again."
    )
    assert (got["scan"].edge_lines, got["scan"].cut_words, got["scan"].misread) == (2, 2, 3)
    assert got["null"].repaired is None and got["empty"].repaired == "" and got["twice"].repaired == "tissue"
    assert all(r.repaired == WORDS[int(r.rec_id[1:]) % 3] and not r.misread for r in rows if r.rec_id[0] == "w")


def test_an_empty_table(records):
    assert repair_scans(records.limit(0), ["rec_id"], "text").count() == 0


def test_edge_lines():
    prose = "any measured value of the long assay was below\n"
    for mark in ("12", "[12]", "(12)", "– 12 –", "• 12 •", "p. 12", "Page 12 of 30", "12    Crystal Growth", "Crystal Growth  |  12", "Crystal Growth 27 (2005) 167-176"):
        assert unpaged(f"{prose}{mark}\nthe level of all other values in it")[1] == 1, mark
    for other in ("[84].", "3).", "12.5 mg"):
        assert unpaged(f"{prose}{other}\nthe level of all other values in it")[1] == 0, other
    assert unpaged("1\n2\n3\n4") == ("1\n2\n3\n4", 0)


def test_lists_and_paragraphs_stay():
    text = "- wash the cells with cold buffer\n- elute the bound protein twice\n\nA new paragraph of the text that runs on\nfor two lines."
    assert unwrapped(text) == "- wash the cells with cold buffer\n- elute the bound protein twice\n\nA new paragraph of the text that runs on for two lines."


def test_confusions_are_found_by_their_difference(spark):
    known = [("tissue", 500), ("binding", 400), ("modern", 50), ("reduced", 300), ("farm", 90), ("form", 95)]
    wrong = [("ti5sue", 9, "tissue"), ("bincling", 3, "binding"), ("modem", 2, "modern"), ("reclucecl", 1, "reduced"), ("rcduccd", 1, "reduced"), ("tisue", 1, None)]
    vocabulary = spark.createDataFrame([*known, *((a, b) for a, b, _ in wrong)], "key string, df bigint")
    assert dict(scans.corrections(vocabulary).collect()) == {a: c for a, _, c in wrong if c}


def test_a_very_long_text_ends():
    import time

    begin = time.time()
    text, gone = scans.body_of("Uptake of the precursor by cells was mea-\nsured in the tissue and binding of the\n12\n" * 20_000)
    assert gone == 20_000 and text.count("mea\x01sured") == 20_000
    assert time.time() - begin < 10 and "\n" not in text.strip()
