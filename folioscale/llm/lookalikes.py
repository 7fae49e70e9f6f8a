"""Problem 3: text that reads the same is brought to one form.

Each Arrow partition is handed to an embedded DuckDB, whose SQL drops invisible characters, maps compatibility forms
(full-width, mathematical and presentation letters, ligatures, blanks of every width) and look-alike letters of other
scripts with ``regexp_replace``, ``replace`` and ``translate``, and composes accents with ``nfc_normalize``. What
visibly differs (case, accents, superscripts, dashes of other lengths) stays different.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.pairs import pairs_within
from folioscale.session import table

#: Letters of other scripts and the Latin letters that they look like. Fixed values.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ё": "ë", "ї": "ï", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ё": "Ë", "Ї": "Ï",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "µ": "μ",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ɑ": "a", "ɡ": "g", "օ": "o", "‐": "-", "‑": "-",
}
#: Presentation ligatures. Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Compatibility decompositions that keep the look.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>")
#: What shows nothing and takes no room; the controls that are blanks (tab, line ends) are none of these. Fixed values.
INVISIBLE = r"[\p{Cf}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"


@cache
def single_forms() -> dict[str, str]:
    """Code points to translate one for one: look-alikes, and by rule all compatibility forms that look the same."""
    found = dict(ALIKE)
    for n in range(0xA0, min(sys.maxunicode, 0x1FFFF) + 1):
        tag, _, rest = unicodedata.decomposition(chr(n)).partition(" ")
        # letters that stand for numbers (small roman one and so on) are drawn with the letters they decompose to
        if (tag in SAME_LOOK or (tag == "<compat>" and unicodedata.category(chr(n)) == "Nl")) and " " not in rest:
            one = chr(int(rest, 16))
            found.setdefault(chr(n), ALIKE.get(one, one))
    return {a: b for a, b in found.items() if a != b and not b.isspace()}


@cache
def accented_forms() -> dict[str, str]:
    """Composed letters whose base is a look-alike, and the Latin letter with the same accents that each looks like."""
    found = {}
    for n in range(0xA0, 0x1FFFF + 1):
        base, *accents = unicodedata.normalize("NFD", chr(n))
        if accents and base in ALIKE and chr(n) not in ALIKE:
            found[chr(n)] = unicodedata.normalize("NFC", ALIKE[base] + "".join(accents))
    return found


def latin_accents_sql(text: str) -> str:
    """The DuckDB expression of ``text``, composed, with accented look-alike letters as Latin ones."""
    sql = f"nfc_normalize({text})"
    one = {a: b for a, b in accented_forms().items() if len(b) == 1}
    for a, b in accented_forms().items():
        if a not in one:
            sql = f"replace({sql}, '{a}', '{b}')"
    return f"translate({sql}, '{''.join(one)}', '{''.join(one.values())}')"


def form_sql(text: str) -> str:
    """The DuckDB expression that gives the one form of the SQL expression ``text``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"regexp_replace(nfc_normalize({text}), '{INVISIBLE}', '', 'g')"
    for a, b in LIGATURES.items():
        sql = f"replace({sql}, '{a}', '{b}')"
    forms = single_forms()
    sql = f"translate({sql}, {quoted(''.join(forms))}, {quoted(''.join(forms.values()))})"
    return rf"trim(regexp_replace(nfc_normalize({sql}), '[\p{{Zs}}\t\n\r]', ' ', 'g'))"


def one_form(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form) of all rows; the form of null is null, that of invisible text is empty.

    Only the two named columns are read, so other columns may have any names. Rows are neither dropped nor merged.
    """
    source = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    query = f"SELECT key, text, {form_sql(latin_accents_sql('text'))} AS form FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:") as con:
            con.execute("SET threads = 1")
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                out = con.sql(query).to_arrow_table()
                con.unregister("batch")
                yield from out.cast(pa.schema([(c, pa.string()) for c in ("key", "text", "form")])).to_batches()

    return source.mapInArrow(run, "key string, text string, form string")


def token_name(token: Column) -> Column:
    """The file name that a token stands for: its last path component without outer blanks, with .pdf if missing."""
    last = F.regexp_replace(F.regexp_extract(token, r"[^/\\]*$", 0), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(F.lower(last).endswith(".pdf"), last).otherwise(F.concat(last, F.lit(".pdf")))


def alike_pairs(forms: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different keys of one non-empty form; each pair once."""
    members = forms.where("key is not null and form <> '' and form <> '.pdf'").select("form", "key").distinct()
    return pairs_within(members, ["form"], "key").select("a", "b").distinct()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of ids whose names read the same, and of id tokens with the catalog ids that they read as."""
    papers, resolved = table(spark, root, "papers"), table(spark, root, "resolved")
    is_id = F.col("token") == F.col("paper_id")
    names = papers.select("paper_id", F.col("file_name").alias("name")).unionByName(
        resolved.where(~is_id).select("paper_id", token_name(F.col("token")).alias("name"))
    )
    # formed where they are read, made distinct after: a distinct before would bring a small table into one task
    by_name = alike_pairs(one_form(names, "paper_id", "name"))
    typed = one_form(resolved.where(is_id), "paper_id", "paper_id").select("key", "form").distinct()
    catalog = papers.select(F.col("paper_id").alias("id")).where("id is not null").distinct()
    by_id = typed.join(catalog, F.col("form") == F.col("id")).where("key <> id")
    return (
        by_name.unionByName(by_id.select(F.least("key", "id").alias("a"), F.greatest("key", "id").alias("b")))
        .distinct()
        .select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))
    )


#: An independent statement of the form: code points one by one, by arithmetic on their blocks and a spelled-out list.
_ONE = """CASE
  WHEN u BETWEEN 65281 AND 65374 THEN chr(u - 65248)
  WHEN u = 12288 OR u = 160 OR u = 8239 OR u = 8287 OR u BETWEEN 8192 AND 8202 OR u IN (9, 10, 11, 12, 13, 133) THEN ' '
  WHEN u IN (173, 847, 4447, 4448, 8288, 12644, 65279, 65440) OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238
    OR u BETWEEN 8289 AND 8303 OR u BETWEEN 65024 AND 65039 OR u BETWEEN 917505 AND 917631 THEN ''
  WHEN u BETWEEN 119808 AND 120483 THEN chr(CASE WHEN (u - 119808) % 52 < 26 THEN 65 ELSE 71 END + ((u - 119808) % 52)::INT)
  WHEN u BETWEEN 120822 AND 120831 OR u BETWEEN 120782 AND 120821 THEN chr(48 + ((u - 120782) % 10)::INT)
  WHEN u = 8208 OR u = 8209 THEN '-'
  ELSE coalesce(MAP {'а':'a','е':'e','о':'o','р':'p','с':'c','у':'y','х':'x','і':'i','ј':'j','ѕ':'s','һ':'h','ԁ':'d','ԛ':'q','ԝ':'w','ѵ':'v','ӏ':'l',
    'А':'A','В':'B','Е':'E','К':'K','М':'M','Н':'H','О':'O','Р':'P','С':'C','Т':'T','У':'Y','Х':'X','І':'I','Ј':'J','Ѕ':'S','ο':'o','ν':'v','ρ':'p','ϲ':'c',
    'Α':'A','Β':'B','Ε':'E','Ζ':'Z','Η':'H','Ι':'I','Κ':'K','Μ':'M','Ν':'N','Ο':'O','Ρ':'P','Τ':'T','Υ':'Y','Χ':'X','ɑ':'a','ɡ':'g','օ':'o',
    'ﬀ':'ff','ﬁ':'fi','ﬂ':'fl','ﬃ':'ffi','ﬄ':'ffl','ﬅ':'ft','ﬆ':'st','µ':'μ','ё':'ë','ї':'ï','Ё':'Ë','Ї':'Ï'}[c], c) END"""


def p3_sql() -> str:
    last = r"regexp_replace(regexp_extract(token, '[^/\\]*$'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    one = _ONE.replace("u ", "unicode(c) ").replace("(u ", "(unicode(c) ")
    form = lambda text: f"trim(nfc_normalize(array_to_string(list_transform(string_split(nfc_normalize({text}), ''), lambda c: {one}), '')))"
    return rf"""
WITH named AS (
  SELECT DISTINCT paper_id, file_name AS name FROM papers UNION
  SELECT paper_id, CASE WHEN lower({last}) LIKE '%.pdf' THEN {last} ELSE {last} || '.pdf' END FROM resolved WHERE token <> paper_id),
formed AS (SELECT DISTINCT paper_id, {form('name')} AS form FROM named),
typed AS (SELECT DISTINCT paper_id, {form('paper_id')} AS form FROM resolved WHERE token = paper_id),
pairs AS (
  SELECT a.paper_id AS a, b.paper_id AS b FROM formed a JOIN formed b USING (form)
  WHERE a.paper_id < b.paper_id AND form NOT IN ('', '.pdf')
  UNION
  SELECT least(t.paper_id, p.paper_id), greatest(t.paper_id, p.paper_id)
  FROM typed t JOIN papers p ON p.paper_id = t.form WHERE t.paper_id <> p.paper_id)
SELECT a AS paper_id_a, b AS paper_id_b FROM pairs
"""
