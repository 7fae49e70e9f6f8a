"""Facts, figure mentions, labels and table grids out of texts.

These need a parser or a state that column expressions do not have; each is a plain function of one text, run over Arrow
batches, and returns rows that are joined and ranked in the engine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions.text import DASHES, SPACES

_WIDTH = str.maketrans(SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))

#: Label words and the kind of object they name, and the kinds that may stand for one another. Fixed values, those of the reference.
KINDS = {
    "fig": "figure", "figs": "figure", "figure": "figure", "figures": "figure", "figur": "figure", "tab": "table", "tabs": "table", "table": "table", "tables": "table",
    "scheme": "scheme", "schemes": "scheme", "chart": "chart", "charts": "chart", "plate": "plate", "plates": "plate", "box": "box", "boxes": "box", "panel": "figure",
    "panels": "figure", "exhibit": "figure", "exhibits": "figure", "graph": "figure", "graphs": "figure",
}
FAMILY = {
    "figure": ("scheme", "chart", "plate", "box"), "scheme": ("figure", "chart"), "chart": ("figure", "scheme"), "plate": ("figure",), "box": ("figure",), "table": (),
}
_NUMBER = r"(?:(?:ESI|SI|S)[ .\-]?)?(?:\d{1,3}(?:\.\d{1,3})?|[IVX]{1,6})"
_PANEL = r"(?: ?\(\s*[a-z]\s*\)|(?<=\d)[a-h](?![a-z0-9]))"
_HEAD = re.compile(rf"(?<![a-z])({'|'.join(sorted(KINDS, key=len, reverse=True))})\.?[ ]{{0,2}}({_NUMBER})({_PANEL})?", re.I)
_NEXT = re.compile(rf"[ ]{{0,2}}(?:,|and|&|to|-|/|or)[ ]{{0,2}}(?:({_NUMBER})({_PANEL})?|([a-h])(?![a-z0-9]))", re.I)
_ROMAN = {"I": 1, "V": 5, "X": 10}


def label_number(raw: str) -> str | None:
    """``3``, ``13.1`` or ``S2``: Roman numerals to 39 as Arabic, any supplementary mark as S; a closing ``.0`` goes."""
    token = re.sub(r"[ \-]", "", raw.translate(_WIDTH)).upper()
    mark = re.match(r"(?:ESI|SI|S)(?=.)", token)
    token = token[mark.end() :].lstrip(".") if mark else token
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3})?", token):
        return ("S" if mark else "") + (token[:-2] if token.endswith(".0") else token)
    if re.fullmatch(r"X{0,3}(?:IX|IV|V?I{0,3})", token) and token:
        values = [_ROMAN[c] for c in token]
        total = sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))
        return f"{'S' if mark else ''}{total}"
    return None


def _letter(panel: str | None) -> str | None:
    found = re.search(r"[a-z]", panel or "", re.I)
    return found.group().lower() if found else None


def mentions(text: str | None) -> list[dict]:
    """kind, number, panel, start, end of every object that the text points to: one row a number, offsets into the text."""
    if not text:
        return []
    source, out, after = text.translate(_WIDTH), [], 0
    for m in _HEAD.finditer(source):
        if m.start() < after:
            continue
        number = label_number(m.group(2))
        if number is None or re.match(r"[A-Za-z0-9]", source[m.end() : m.end() + 1]):
            continue
        kind = KINDS[m.group(1).lower()]
        out.append({"kind": kind, "number": number, "panel": _letter(m.group(3)), "start": m.start(), "end": m.end()})
        at = m.end()
        while more := _NEXT.match(source, at):
            at = more.end()
            if more.group(3):
                out.append({"kind": kind, "number": number, "panel": more.group(3).lower(), "start": more.start(3), "end": at})
            elif (said := label_number(more.group(1))) and not re.match(r"[A-Za-z0-9]|[:/]\s*\d", source[at : at + 3]):
                number = said
                out.append({"kind": kind, "number": number, "panel": _letter(more.group(2)), "start": more.start(1), "end": at})
        after = at
    return out


def caption_label(text: str | None) -> dict | None:
    """kind and number of the label that a caption begins with."""
    found = _HEAD.match((text or "").translate(_WIDTH).lstrip())
    number = label_number(found.group(2)) if found else None
    return {"kind": KINDS[found.group(1).lower()], "number": number} if number else None


#: Units as printed and as stored; the case of nM and nm tells them apart. Fixed values, after the reference.
UNITS = {
    "%": "%", "°C": "°C", "K": "K", "µM": "µM", "μM": "µM", "uM": "µM", "nM": "nM", "mM": "mM", "pM": "pM", "µmol/L": "µmol/L", "μmol/L": "µmol/L", "umol/L": "µmol/L", "nmol/L": "nmol/L",
    "mmol/L": "mmol/L", "mol/L": "mol/L", "µg/mL": "µg/mL", "μg/mL": "µg/mL", "ug/mL": "µg/mL", "mg/mL": "mg/mL", "ng/mL": "ng/mL", "mg/kg": "mg/kg", "g/L": "g/L", "mg/L": "mg/L",
    "mol%": "mol%", "equiv.": "equiv", "equiv": "equiv", "eq.": "equiv", "nm": "nm", "kDa": "kDa", "Da": "Da", "kcal/mol": "kcal/mol", "kJ/mol": "kJ/mol", "MPa": "MPa", "bar": "bar",
    "psi": "psi", "rpm": "rpm", "h": "h", "min": "min",
}
#: What a unit speaks of where no property is named. Fixed values, those of the reference.
IMPLIED = {"°C": "temperature", "equiv": "equivalents", "h": "time", "min": "time", "mol%": "loading", "nm": "wavelength", "Da": "molecular_weight", "kDa": "molecular_weight"}
CONCENTRATION = frozenset("µM nM mM pM µmol/L nmol/L mmol/L mol/L µg/mL mg/mL ng/mL g/L mg/L".split())
#: Properties and the words that name them, in order of preference. Fixed values, those of the reference.
PROPERTIES = (
    (r"IC\s?-?\s?50", "ic50"), (r"EC\s?-?\s?50", "ec50"), (r"LD\s?-?\s?50", "ld50"), (r"CC\s?-?\s?50", "cc50"), (r"GI\s?-?\s?50", "gi50"), (r"ED\s?-?\s?50", "ed50"), (r"MBC", "mbc"),
    (r"MIC(?:\s?-?\s?[59]0)?", "mic"), (r"K_?\{?d\}?", "kd"), (r"K_?\{?i\}?", "ki"), (r"K_?\{?m\}?", "km"), (r"k_?\{?cat\}?", "kcat"), (r"ee|enantiomeric\s+excess", "ee"), (r"yield", "yield"),
    (r"conversion", "conversion"), (r"selectivity", "selectivity"), (r"loading", "loading"), (r"temperature", "temperature"), (r"equivalents?", "equivalents"), (r"time", "time"), (r"pH", "ph"),
    (r"concentrations?", "concentration"), (r"limit\s+of\s+detection|LOD", "lod"), (r"molecular\s+weight|MW", "molecular_weight"), (r"wavelength|λ(?:max)?", "wavelength"), (r"TOF", "tof"), (r"TON", "ton"),
)
_PROPERTY = re.compile(r"(?<![^\W\d_])(?:" + "|".join(f"(?P<p{i}>{p})" for i, (p, _) in enumerate(PROPERTIES)) + r")(?![^\W\d_])", re.I)
_QUANTITY = re.compile(
    r"(?<![\w.])(?P<qual>[<>≤≥~≈]?)\s?(?P<num>\d{1,6}(?:[.,]\d+)?(?:\s?[x×]\s?10\s?\^?\s?-?\d+)?)(?:\s?±\s?\d+(?:\.\d+)?)?\s*(?P<unit>"
    + "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True)) + r")(?!\w)"
)
_NAME = re.compile(r"\b(?:[A-Z][A-Za-z]{1,14}\s?-?\d{1,4}[A-Za-z]?|[A-Z][a-z]?\([A-Za-z0-9()]{2,20}\)\d?[A-Za-z0-9]{0,6}|[A-Z]{2,8}|compound\s+\d+[a-z]?)\b")
_NO_NAME = frozenset("the and with for was were this that figure table fig eq si nmr hplc ms using from after about approximately".split())


def quantity(number: str) -> float | None:
    """``1.2 x 10^3``, ``2,5`` and plain numbers."""
    clean = number.replace(",", ".").replace(" ", "")
    found = re.fullmatch(r"([\d.]+)(?:[x×]10\^?(-?\d+))?", clean)
    try:
        return float(found.group(1)) * 10.0 ** int(found.group(2) or 0) if found else None
    except ValueError:
        return None


def _property(text: str) -> str | None:
    found = _PROPERTY.search(text)
    return PROPERTIES[int(found.lastgroup[1:])][1] if found else None


def facts(text: str | None) -> list[dict]:
    """property, value, unit, qualifier, entity of the quantities of a text, each fact once, in order.

    A quantity takes the property named in the 40 characters before it in its sentence, else the one right after it, else
    what its unit implies; without any it is no fact. The entity is the last name in the 90 characters before.
    """
    out, seen, last = [], set(), 0
    for m in _QUANTITY.finditer(text or ""):
        unit, value = UNITS[m.group("unit")], quantity(m.group("num"))
        before = re.split(r"[.;:\n](?:\s|$)", text[max(last, m.start() - 40) : m.start()])[-1]
        last = m.end()
        named = list(_PROPERTY.finditer(before))
        what = _property(named[-1].group()) if named else None
        after = re.match(r"\s{0,2}(?:of\s+)?(\S+(?:\s\S+)?)", text[m.end() : m.end() + 40])
        if what is None and after and (found := _PROPERTY.match(after.group(1))):
            what = _property(found.group())
        what = what or IMPLIED.get(unit) or ("concentration" if unit in CONCENTRATION else None)
        if what is None or value is None:
            continue
        names = [n.group().strip() for n in _NAME.finditer(text[max(0, m.start() - 90) : m.start()])]
        entity = names[-1][:80] if names and names[-1].lower() not in _NO_NAME else None
        key = (what, round(value, 6), unit, (entity or "").lower())
        if key not in seen:
            seen.add(key)
            out.append({"property": what, "value": value, "unit": unit, "qualifier": m.group("qual"), "entity": entity})
    return out


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[int, str]] = []
        self.carried: dict[int, tuple[int, str]] = {}
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self._close()
            self.rows.append({c: t for c, (n, t) in self.carried.items() if n > 0})
            self.carried = {c: (n - 1, t) for c, (n, t) in self.carried.items() if n > 1}
        elif tag in ("td", "th") and self.rows:
            self._close()
            span = {k: int(v) if (v or "").isdigit() and 0 < int(v) < 1000 else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.cell = [[], span.get("rowspan", 1), span.get("colspan", 1)]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0].append(data)

    def _close(self) -> None:
        if self.cell is None:
            return
        said, down, across = " ".join("".join(self.cell[0]).split()), self.cell[1], self.cell[2]
        row, at = self.rows[-1], 0
        while at in row:
            at += 1
        for c in range(at, at + across):
            row[c] = said
            if down > 1:
                self.carried[c] = (down - 1, said)
        self.cell = None


def grid(html: str | None) -> list[list[str]]:
    """The cells of an HTML table as a rectangle; spanned cells repeat, missing ones are empty."""
    parser = _Grid()
    parser.feed(html or "")
    parser.close()
    parser._close()
    width = max((max(r, default=-1) + 1 for r in parser.rows), default=0)
    return [[r.get(c, "") for c in range(width)] for r in parser.rows]


_VALUE = re.compile(r"^\s*[<>≤≥~≈]?\s*\d{1,6}(?:[.,]\d+)?(?:\s?[x×]\s?10\s?\^?\s?-?\d+)?(?:\s*±\s*\d+(?:[.,]\d+)?)?(?:\s*\S{1,8}(?: \S{1,8})?)?\s*$")


def header_depth(rows: list[list[str]], most: int = 3) -> int:
    """Leading rows of which under half the filled cells are values; one at least."""
    depth = 0
    for row in rows[:most]:
        filled = [c for c in row if c]
        if filled and 2 * sum(bool(_VALUE.match(c)) for c in filled) >= len(filled):
            break
        depth += 1
    return max(depth, 1)


def table_facts(html: str | None) -> list[dict]:
    """entity, column, value_text of every filled cell under a table's header, with the row's first cell as entity."""
    rows = grid(html)
    depth = header_depth(rows)
    names = [" ".join(dict.fromkeys(r[c] for r in rows[:depth] if r[c])) for c in range(len(rows[0]))] if rows else []
    return [{"entity": r[0], "column": names[c], "value_text": r[c]} for r in rows[depth:] for c in range(1, len(r)) if r[c]]


def rendered(html: str | None, most: int = 40) -> str:
    """The table as lines of cells between bars; of more than ``most`` rows the number left out is told."""
    rows = grid(html)
    lines = [" | ".join(r) for r in rows[:most]]
    return "\n".join([*lines, *([f"... ({len(rows) - most} more rows)"] if len(rows) > most else [])])


_FOLD = str.maketrans({**dict(zip("₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹", "01234567890123456789")), **dict.fromkeys(DASHES + "⁃", "-"), **dict.fromkeys("‘’ʼ´", "'")})


def folded(text: str | None) -> str:
    """One form for literal comparison: compatibility forms, digits, dashes and quotes folded, lower case, single blanks."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").translate(_FOLD).lower())


def _rows(function: Callable[[str | None], list[dict]], schema: str) -> Callable[[Column], Column]:
    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run


def mentions_of(text: Column) -> Column:
    return _rows(mentions, "kind:string,number:string,panel:string,start:bigint,end:bigint")(text)


def facts_of(text: Column) -> Column:
    return _rows(facts, "property:string,value:double,unit:string,qualifier:string,entity:string")(text)


def table_facts_of(html: Column) -> Column:
    return _rows(table_facts, "entity:string,column:string,value_text:string")(html)


def label_of(caption: Column) -> Column:
    @F.pandas_udf("struct<kind:string,number:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([caption_label(t) or {"kind": None, "number": None} for t in texts], columns=["kind", "number"])

    return run(caption)


def folded_text(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(folded)

    return run(text)


def resolved_mentions(mentions: DataFrame, labels: DataFrame, paper: str = "paper_id") -> DataFrame:
    """mentions with target and how: the labelled object of the paper, exact or else the only one of its family.

    mentions: ``paper``, kind, number and more; labels: ``paper``, kind, number, target (the first of a label wins).
    """
    first = labels.groupBy(paper, "kind", "number").agg(F.min("target").alias("target"))
    family = mentions.sparkSession.createDataFrame([(k, o) for k, os in FAMILY.items() for o in os], "kind string, other string")
    exact = mentions.join(first, [paper, "kind", "number"], "left")
    near = (
        mentions.select(paper, "kind", "number").distinct().join(F.broadcast(family), "kind")
        .join(first.withColumnRenamed("kind", "other").withColumnRenamed("target", "stand_in"), [paper, "other", "number"])
        .groupBy(paper, "kind", "number").agg(F.min("stand_in").alias("stand_in"), F.count("*").alias("n")).where("n = 1").drop("n")
    )
    out = exact.join(near, [paper, "kind", "number"], "left")
    how = F.when(F.col("target").isNotNull(), "exact").when(F.col("stand_in").isNotNull(), "family")
    return out.withColumn("how", how).withColumn("target", F.coalesce("target", "stand_in")).drop("stand_in")


def labels_by_sequence(objects: DataFrame, paper: str = "paper_id", order: str = "at") -> DataFrame:
    """objects with ``filled``: numbers of unlabelled objects where they follow from their neighbours.

    A run of unlabelled objects between two numbers is filled if the numbers are as far apart as the run is long; at an end it
    is carried on from its one neighbour, not below 1; objects without any label are numbered from 1. objects: paper,
    order, number (bigint or null).
    """
    by = Window.partitionBy(paper).orderBy(order)
    up, down = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    place = F.row_number().over(by).cast("bigint")
    rows = objects.withColumn("__p", place)
    known = F.when(F.col("number").isNotNull(), F.struct("number", "__p"))
    rows = rows.withColumns({"__a": F.last(known, ignorenulls=True).over(up), "__b": F.first(known, ignorenulls=True).over(down)})
    a, b = F.col("__a"), F.col("__b")
    after, before = a["number"] + F.col("__p") - a["__p"], b["number"] - b["__p"] + F.col("__p")
    filled = (
        F.when(F.col("number").isNotNull(), F.col("number"))
        .when(a.isNotNull() & b.isNotNull(), F.when(after == before, after))
        .when(a.isNotNull(), after).when(b.isNotNull(), F.when(before >= 1, before)).otherwise(F.col("__p"))
    )
    return rows.withColumn("filled", filled).drop("__p", "__a", "__b")
