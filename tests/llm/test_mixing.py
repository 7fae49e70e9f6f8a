import pytest

from folioscale.llm.mixing import count_tokens, mix, shares, water_fill
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def test_water_fill_gives_what_a_full_source_cannot_take_to_the_others():
    assert water_fill([0.5, 0.3, 0.2], [10, 1000, 1000], 110) == pytest.approx([10, 60, 40])
    assert water_fill([0.5, 0.5], [10, 20], 100) == pytest.approx([10, 20])
    assert water_fill([0.5, 0.3, 0.2], [0, 30, 100]) == pytest.approx([0, 30, 20])


def test_shares_are_reached_within_a_record(spark):
    text = "binding of the labelled protein was measured twice"
    docs = [(i, text, s) for s, a, b in (("a", 0, 400), ("b", 400, 500), ("none", 500, 600)) for i in range(a, b)] + [(600, text, None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mix(docs, targets)
    rows = chosen.collect()
    one = count_tokens([text])[0]
    tokens = {s: sum(r.tokens * r.uses for r in rows if r.source == s) for s in ("a", "b")}
    assert {r.source for r in rows} == {"a", "b"}
    assert max(r.uses for r in rows if r.source == "a") == 1 and max(r.uses for r in rows if r.source == "b") <= 3
    # b is full at three uses of 100 records, and a keeps 5 to 4 of it: 375 records
    assert tokens == {"a": 375 * one, "b": 300 * one}
    assert len(rows) == len({r.doc_id for r in rows})
    found = {r.source: r.share for r in shares(chosen, targets).collect()}
    assert found["gone"] == 0 and found["a"] == pytest.approx(5 / 9, abs=0.01)


def test_a_full_source_leaves_its_share_to_the_others(spark):
    text = "binding of the labelled protein was measured twice"
    docs = spark.createDataFrame([(i, text, "a" if i < 50 else "b") for i in range(450)] + [(900, None, "a"), (901, "", "b")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mix(docs, targets, epochs=1.0).collect()
    # 450 records are wanted: a gives its 50 twice, b the 350 that are left, of its 400
    assert sum(r.uses for r in rows if r.source == "a") == 100 and max(r.uses for r in rows) == 2
    assert sum(r.uses for r in rows if r.source == "b") == 350
    same = {(r.doc_id, r.uses) for r in mix(docs, targets, epochs=1.0).collect()}
    other = {(r.doc_id, r.uses) for r in mix(docs, targets, epochs=1.0, seed=7).collect()}
    assert same == {(r.doc_id, r.uses) for r in rows} and len(other) == len(same) and other != same


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.0, None)], "source string, target_share double, max_repeats int")
    assert mix(docs, targets).count() == 0
    assert [(r.source, r.tokens) for r in shares(mix(docs, targets), targets).collect() if r.source] == [("a", 0)]


def test_the_vocabulary_is_a_parameter():
    import public_tokenizers

    texts = ["Die Bindung wurde gemessen", None, ""]
    many = count_tokens(texts, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert many[1:] == [0, 0] and 0 < many[0] < count_tokens(texts)[0]
