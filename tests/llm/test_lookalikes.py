import unicodedata

import pytest

from folioscale.llm.lookalikes import one_form
from folioscale.session import local_session


@pytest.mark.parametrize("latin, other", [("ö", "ӧ"), ("ä", "ӓ"), ("è", "ѐ"), ("ó", "ό"), ("v́", "ν́")])
def test_an_accented_look_alike_meets_its_latin_twin(latin, other):
    spark = local_session(2, 2, "1g")
    names = [latin, other, unicodedata.normalize("NFC", other)]
    rows = spark.createDataFrame([(str(i), f"x{n}y.pdf") for i, n in enumerate(names)], "key string, text string")
    assert {r.form for r in one_form(rows, "key", "text").collect()} == {unicodedata.normalize("NFC", f"x{latin}y.pdf")}


def test_blanks_are_kept_invisible_signs_are_not():
    spark = local_session(2, 2, "1g")
    same = ["report 1.pdf", "report\t1.pdf", "report\n1.pdf", "report 1.pdf", "re​port 1.pdf", "ｒeport 1.pdf", "rероrt 1.pdf"]
    other = ["report1.pdf", "Report 1.pdf", "réport 1.pdf", "report_1.pdf"]
    rows = spark.createDataFrame([(str(i), n, "f") for i, n in enumerate([*same, *other, None, "​"])], "key string, text string, form string")
    got = {r.key: r.form for r in one_form(rows, "key", "text").collect()}
    assert {got[str(i)] for i in range(len(same))} == {"report 1.pdf"}
    assert [got[str(len(same) + i)] for i in range(4)] == other and got["11"] is None and got["12"] == ""
    assert one_form(rows.limit(0), "key", "text").count() == 0
