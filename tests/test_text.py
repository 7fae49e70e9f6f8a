import pytest
from pyspark.sql import functions as F

from folioscale.functions import text as T
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, words, kept", [
    ("One two. Three four five", 4, "One two. Three four"), ("One two three. Four five six", 4, "One two three."), ("Short one.", 9, "Short one."), ("a b c d", 2, "a b"),
    ("Is it so? Yes it is. No more", 6, "Is it so? Yes it is."), ("", 3, ""),
])
def test_truncation_at_a_sentence(spark, text, words, kept):
    assert one(spark, T.truncated(F.lit(text), words)) == kept


def test_notes_and_types(spark):
    assert one(spark, T.with_note(F.lit("A"), F.lit(0.5), F.lit(2))).startswith("A\n\nNote: 2") and one(spark, T.with_note(F.lit("A"), F.lit(0.9), F.lit(2))) == "A"
    assert one(spark, T.merged_types([F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))])) == ["a", "b", "c"]


def test_citations_and_support(spark):
    got = one(spark, T.citations(F.lit("First claim [1]. Second holds [Source 2, 3]! First claim [1]. No mark. [4]")))
    assert [(c.source, c.claim) for c in got] == [(1, "First claim ."), (2, "Second holds !"), (3, "Second holds !")]
    assert one(spark, T.support(F.lit("Kinase binds the buffer"), F.lit("kinase and buffers"))) == pytest.approx(2 / 3)
    assert one(spark, T.support(F.lit("it is"), F.lit("x"))) == 0 and one(spark, T.support(F.lit("word"), F.lit(None).cast("string"))) == 0


def test_rewriting(spark):
    assert one(spark, T.corrected(F.lit("Flourescence of protien and PROTIENS"))) == "fluorescence of protein and proteins"
    assert one(spark, T.expanded(F.lit("NMR and the PCR of it"))) == "NMR and the PCR of it (polymerase chain reaction, nuclear magnetic resonance)"
    assert one(spark, T.sub_questions(F.lit("compare A and B"))) == ["What is A?", "What is B?", "compare A and B"]
    assert one(spark, T.sub_questions(F.lit("how does heat affect growth"))) == ["What is heat?", "How does heat affect growth?"]
    assert one(spark, T.sub_questions(F.lit("plain"))) == []
    assert one(spark, T.question_kind(F.lit("Which buffer?"))) == "methods" and one(spark, T.question_kind(F.lit("Hello"))) == "general"
    assert one(spark, T.is_ambiguous(F.lit("What about it now then please"))) and not one(spark, T.is_ambiguous(F.lit("The kinase binds four buffers here")))
