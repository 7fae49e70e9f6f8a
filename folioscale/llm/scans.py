"""Problem 6: text of scanned pages becomes continuous paragraphs again.

Three repairs, each on evidence. Edge lines: a line that is a page number, or a running head beside one, between lines
of prose is taken out. Hyphens: a word cut at a line end is joined; its hyphen stays only where the corpus knows the
word with it better than without. Misread characters: every word has an anagram value, the sum of the cubes of
its code points, so a confusion (``d`` read as ``cl``) shifts the value by one fixed difference wherever it happens. In
SQL, rare words are joined to the frequent words that lie one or two such differences away, verified character by
character, ranked by frequency and corrected.

The vocabulary counts records, not occurrences, over all of them, after a map-side count. The corrections found are
broadcast only if their number is at most ``MAX_BROADCAST``; beyond it they are joined by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import ensure_checkpoint_dir, table

#: Characters as printed and as misread. Fixed values.
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("i", "l"), ("l", "i"), ("i", "1"), ("t", "f"), ("f", "t"),
    ("t", "l"), ("d", "cl"), ("m", "rn"), ("rn", "m"), ("a", "ə"), ("e", "c"), ("c", "e"), ("g", "q"), ("n", "ri"), ("n", "ii"),
    ("h", "b"), ("u", "ii"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ti", "h"), ("r", "i"), ("li", "h"), ("y", "v"),
)
#: Most corrections that are sent to all tasks at once.
MAX_BROADCAST = 200_000
HARD, SOFT = "\x01", "\x02"

_PAGE = re.compile(
    r"^(?:[-–—•|*~]{1,3}\s*)?(?:\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|(?:p(?:age|p?\.)?\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,5})?)(?:\s*[-–—•|*~]{1,3})?$", re.I
)
_HEAD = re.compile(
    r"^\d{1,4}(?: {2,}|\t|\s*\|\s*)\S.{0,80}$|^\S.{0,80}(?: {2,}|\t|\s\|\s*)\d{1,4}$|^\S.{0,80}\s\d{1,4}\s\((?:1[89]|20)\d\d\)\s\d{1,5}[-–]\d{1,5}$"
)
_BREAK = re.compile(r"(?<=[^\W\d_])([-‐­¬])[ \t]*\n[ \t]*(?=[^\W\d_A-ZÀ-Þ])")
_ENDED = re.compile(r"[.!?:;][)\]\"'”’]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•|#>=:;]|\d{1,3}[.)]\s)|\|\s*$|\\\\$")
_STRAY = re.compile(r"(?<=\s)[~|.'`^_](?:\s+|$)|(?<=[^\W\d_])['`^](?=\s|$)")


def _is_prose(line: str) -> bool:
    words = re.findall(r"[^\W\d_]{2,}", line)
    return len(words) >= 3 and sum(map(len, words)) >= 0.5 * len(line)


def _may_head(line: str) -> bool:
    return len(line) <= 60 and line[-1:] not in "-‐\xad¬" and not _ENDED.search(line.replace(" et al.", "")) and not line[:1].islower() and not _ITEM.match(line)


def unpaged(text: str) -> tuple[str, int]:
    """The text without edge lines, and how many there were.

    A line is at an edge if it is a page number (alone or with a title) and prose stands before or after it; a short
    line beside a lone page number is its running head if it stands in capitals, comes again, or parts a sentence.
    """
    lines = text.split("\n")
    marks = [bool(s) and (1 if _PAGE.match(s) else 2 if _HEAD.match(s) else 0) for s in map(str.strip, lines)]
    if not any(marks):
        return text, 0
    full = [i for i, s in enumerate(lines) if s.strip()]
    place = {i: k for k, i in enumerate(full)}
    again: dict[str, int] = {}
    for i in full:
        k = lines[i].strip().lower()
        again[k] = again.get(k, 0) + 1
    gone: set[int] = set()
    for i in full:
        if not marks[i]:
            continue
        k = place[i]
        before = next((lines[j] for j in reversed(full[max(0, k - 2) : k]) if _is_prose(lines[j])), None)
        after = next((lines[j] for j in full[k + 1 : k + 3] if _is_prose(lines[j])), None)
        if before is None and after is None:
            continue
        if marks[i] == 2 and (before is None or after is None) and lines[i].count("|") > 1:
            continue
        gone.add(i)
        if marks[i] == 2:
            continue
        for j, beyond in ((k - 1, k - 2), (k + 1, k + 2)):
            if not 0 <= j < len(full):
                continue
            head = lines[full[j]].strip()
            if full[j] in gone or not _may_head(head):
                continue
            outer = (lines[full[beyond]] if 0 <= beyond < len(full) else "").strip()
            inner = (lines[full[2 * k - j]] if 0 <= 2 * k - j < len(full) else "").strip()
            first, then = (outer, inner) if j < k else (inner, outer)
            parted = bool(first and then) and not _ENDED.search(first) and len(head) < 0.8 * max(len(first), len(then))
            if head.isupper() or again[head.lower()] > 1 or parted or " et al." in head:
                gone.add(full[j])
                break
    if not gone:
        return text, 0
    kept: list[list[str]] = []  # lines as pieces, so one that is torn at every page is put together once
    torn = False
    for i, line in enumerate(lines):
        if i in gone or not line.strip() and any(j in gone for j in (i - 1, i + 1)):
            torn |= i in gone
            continue
        last = kept[-1][-1].rstrip() if kept else ""
        if torn and last and not _ENDED.search(last[-20:]) and last[-1] not in "-‐\xad¬" and line.strip():
            kept[-1][-1] = last
            kept[-1].append(line.lstrip())
        else:
            kept.append([line])
        torn = False
    return "\n".join(" ".join(pieces) for pieces in kept), len(gone)


def unwrapped(text: str) -> str:
    """Lines of one paragraph in one; a word cut at a line end has HARD, or SOFT after a soft hyphen, at the cut."""
    text = _BREAK.sub(lambda m: HARD if m.group(1) in "-‐" else SOFT, text)
    if "\n" not in text:
        return text
    out: list[str] = []
    for part in re.split(r"\n\s*\n", text):
        lines = [s.rstrip() for s in part.split("\n")]
        long = max(map(len, lines)) if lines else 0
        joined = [lines[:1]]
        for a, b in zip(lines, lines[1:]):
            flows = (_is_prose(a) or _is_prose(b)) and not _ITEM.match(a) and not _ITEM.match(b) and (len(a) >= 0.6 * long or (b[:1].islower() and not _ENDED.search(a)))
            if flows:
                joined[-1].append(b.lstrip())
            else:
                joined.append([b])
        out.append("\n".join(" ".join(pieces) for pieces in joined))
    return "\n\n".join(out)


def body_of(text: str | None) -> tuple[str | None, int]:
    """The text without edge lines and line wraps, cut words marked, and the number of edge lines."""
    if text is None:
        return None, 0
    gone = 0
    if HARD in text or SOFT in text:
        text = text.replace(HARD, " ").replace(SOFT, " ")
    if "\n" in text:
        text, gone = unpaged(text.replace("\r\n", "\n"))
        text = unwrapped(text)
    return text, gone


_PART, _HYPHENED = re.compile(r"[^\W_]{4,}"), re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_CUT = re.compile(rf"[^\W\d_]+[{HARD}{SOFT}][^\W\d_]+")


@lru_cache(maxsize=1 << 17)
def keys_of(raw: str) -> tuple[str, ...]:
    """Keys of one string between blanks: plain words, words with inner hyphens, and words cut at a line end; lower case."""
    low = raw.lower()
    cut: list[str] = []
    if HARD in low or SOFT in low:
        cut = _CUT.findall(low)
        low = low.replace(HARD, "").replace(SOFT, "")
    return tuple({*_PART.findall(low), *(_HYPHENED.findall(low) if "-" in low else ()), *cut})


def _keyed(bodies: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (text number, key number) of the keys of all texts, and the keys."""
    split = pc.utf8_split_whitespace(pa.array([b or "" for b in bodies], pa.string()))
    coded = split.flatten().dictionary_encode()
    place: dict[str, int] = {}
    found = [[place.setdefault(k, len(place)) for k in keys_of(raw)] for raw in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((k for ks in found for k in ks), np.int64, int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    raw = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(bodies)), np.diff(split.offsets.to_numpy()))
    many = sizes[raw] if len(raw) else np.zeros(0, np.int64)
    total = int(many.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    keys = flat[np.repeat(starts[raw], many) + inside] if total else np.zeros(0, np.int64)
    pairs = np.unique(np.repeat(doc, many) * max(len(place), 1) + keys)
    return pairs // max(len(place), 1), pairs % max(len(place), 1), list(place)


def count_keys(records: DataFrame, text: str, block: int = 2048) -> DataFrame:
    """key, df: in how many of the records each key occurs; counted by blocks first, so little is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                _, keys, names = _keyed([body_of(t)[0] for t in batch.column(0).slice(at, block).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(np.bincount(keys, minlength=len(names)), pa.int64())], names=["key", "df"]
                )

    return records.select(F.col(text).cast("string")).mapInArrow(run, "key string, df bigint").groupBy("key").agg(F.sum("df").alias("df"))


def _value(text: str) -> int:
    return sum(ord(c) ** 3 for c in text)


#: Anagram value of the SQL expression {0}.
ANAGRAM = "aggregate(transform(split({0}, ''), c -> cast(ascii(c) as bigint)), 0L, (s, n) -> s + n * n * n)"
#: All texts that {0} becomes by one replacement of {1} by {2}.
ONCE = (
    "transform(filter(sequence(1, length({0})), k -> substr({0}, k, length({1})) = {1}), "
    "k -> concat(substr({0}, 1, k - 1), {2}, substr({0}, k + length({1}))))"
)


def corrections(vocabulary: DataFrame, frequent: int = 8, ratio: int = 8) -> DataFrame:
    """key, right: for each misread word its correction, for each cut word its whole form.

    vocabulary: key, df. A word is corrected to the most frequent word one or two confusions away that occurs in at
    least ``frequent`` records and ``ratio`` times as many; ties go to the first in order of bytes.
    """
    spark = vocabulary.sparkSession
    one = [(a, b, "", "", _value(b) - _value(a)) for a, b in CONFUSIONS]
    two = [(a, b, c, d, _value(b) - _value(a) + _value(d) - _value(c)) for (a, b), (c, d) in combinations_with_replacement(CONFUSIONS, 2)]
    shifts = F.broadcast(spark.createDataFrame(one + two, "a string, b string, c string, d string, shift bigint"))
    words = vocabulary.where(F.col("key").rlike(r"^[\p{L}\p{N}]+$") & F.col("key").rlike(r"\p{L}.*\p{L}") & (F.length("key") <= 40))
    ahead = spark.sql(
        f"""
        WITH right AS (SELECT key AS right, df AS right_df, {ANAGRAM.format('key')} AS value FROM {{words}}
                       WHERE df >= {frequent} AND key rlike '^\\\\pL+$'),
        wrong AS (SELECT key, df, {ANAGRAM.format('key')} AS value FROM {{words}}),
        moved AS (SELECT key, df, a, b, c, d, value - shift AS value FROM wrong JOIN {{shifts}}
                  ON contains(key, b) AND (d = '' OR contains(key, d))),
        met AS (SELECT key, df, right, right_df, a, b, c, d FROM moved JOIN right USING (value)
                WHERE right_df >= {ratio} * df AND key <> right),
        verified AS (SELECT key, df, right, right_df, if(d = '', 1, 2) AS steps FROM met
                     WHERE CASE WHEN d = '' THEN array_contains({ONCE.format('right', 'a', 'b')}, key)
                           ELSE exists({ONCE.format('right', 'a', 'b')}, x -> array_contains({ONCE.format('x', 'c', 'd')}, key))
                             OR exists({ONCE.format('right', 'c', 'd')}, x -> array_contains({ONCE.format('x', 'a', 'b')}, key)) END)
        SELECT key, min_by(right, struct(steps, -right_df, right)) AS right FROM verified GROUP BY key
        """,
        words=words, shifts=shifts,
    )
    cut = vocabulary.where(F.col("key").rlike(f"[{HARD}{SOFT}]")).select(
        "key",
        F.translate("key", HARD + SOFT, "").alias("closed"),
        F.when(F.contains("key", F.lit(HARD)), F.translate("key", HARD, "-")).alias("open"),
    )
    known = vocabulary.select(F.col("key").alias("form"), F.col("df"))
    asked = cut.select("key", F.inline(F.array(F.struct(F.col("closed").alias("form"), F.lit(False).alias("hyphen")), F.struct(F.col("open").alias("form"), F.lit(True).alias("hyphen"))))).where("form is not null")
    chosen = (
        asked.join(known, "form", "left")
        .groupBy("key")
        .agg(F.min_by("form", F.struct(-F.coalesce("df", F.lit(0)), F.col("hyphen"))).alias("right"))
    )
    return ahead.unionByName(chosen)


def repair_scans(records: DataFrame, keys: list[str], text: str, frequent: int = 8, ratio: int = 8) -> DataFrame:
    """keys, edge_lines, cut_words, misread (distinct words corrected), repaired (the text) of each record.

    Null texts stay null, empty ones empty, both without repairs. Repeated rows are repaired each. Columns other than
    ``keys`` and ``text`` are ignored. An empty table gives no rows. Keys come back as strings. A cut word counts if it
    is joined without its hyphen.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    vocabulary = count_keys(records, text).checkpoint()
    right = corrections(vocabulary, frequent, ratio).checkpoint()
    source = records.select(*(F.col(k).cast("string") for k in keys), F.col(text).cast("string").alias("__text"))
    if right.count() <= MAX_BROADCAST:
        known = dict(right.select("key", "right").collect())
        return _repaired(source, keys, spark.sparkContext.broadcast(known))
    # too many corrections for one task: each record meets its own by a join on the keys
    numbered = source.withColumn("__row", F.monotonically_increasing_id()).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found, names = _keyed([body_of(t)[0] for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(names, pa.string()).take(pa.array(found))], names=["__row", "key"])

    own = (
        numbered.select("__row", "__text").mapInArrow(run, "__row bigint, key string").join(right, "key")
        .groupBy("__row").agg(F.map_from_entries(F.collect_set(F.struct("key", "right"))).alias("__right"))
    )
    return _repaired(numbered.join(own, "__row", "left").select(*keys, "__text", "__right"), keys, None)


def _repaired(source: DataFrame, keys: list[str], shared, block: int = 2048) -> DataFrame:  # noqa: ANN001
    """The records mended with the shared corrections, or each with its own in the column after its text."""
    n = len(keys)
    schema = ", ".join([*(f"`{k}` string" for k in keys), "edge_lines bigint, cut_words bigint, misread bigint, repaired string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                bodies, edges = map(list, zip(*(body_of(t) for t in batch.column(n).to_pylist())))
                own: list[dict[str, str]] = [{} for _ in bodies]
                if shared is None:
                    own = [dict(m) if m else {} for m in batch.column(n + 1).to_pylist()]
                else:
                    docs, found, names = _keyed(bodies)
                    hit = np.array([k in shared.value for k in names], dtype=bool)
                    for d, k in zip(*(x[hit[found]].tolist() for x in (docs, found))) if len(found) else ():
                        own[d][names[k]] = shared.value[names[k]]
                cut = [sum((HARD in k or SOFT in k) and "-" not in r for k, r in o.items()) for o in own]
                misread = [sum(HARD not in k and SOFT not in k for k in o) for o in own]
                columns = [pa.array(edges, pa.int64()), pa.array(cut, pa.int64()), pa.array(misread, pa.int64())]
                mended = pa.array([mend(b, o) for b, o in zip(bodies, own)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns, mended], names=[*keys, "edge_lines", "cut_words", "misread", "repaired"])

    return source.mapInArrow(run, schema)


_TOKEN = re.compile(rf"[^\W\d_]+[{HARD}{SOFT}][^\W\d_]+|[^\W_]{{4,}}")


def mend(body: str | None, right: dict[str, str]) -> str | None:
    """The body with its cut words whole and its misread words corrected, in the case they stood in."""
    if body is None:
        return None

    def one(m: re.Match) -> str:
        word = m.group()
        to = right.get(word.lower())
        if to is None:
            return word
        if HARD in word or SOFT in word:
            return re.sub(f"[{HARD}{SOFT}]", "-" if "-" in to else "", word)
        return to.upper() if word.isupper() and len(word) > 1 else to.capitalize() if word[:1].isupper() else to

    if not right:
        return body
    body = re.sub(f"[{HARD}{SOFT}]", "", _STRAY.sub("", _TOKEN.sub(one, body)))
    # a correction may have stood across a cut
    return _TOKEN.sub(one, body)


def p6_records(spark: SparkSession, root: str) -> DataFrame:
    """All texts of problem 6: src, rec_id, text."""
    chunks, sections = table(spark, root, "chunks"), table(spark, root, "sections")
    return chunks.select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("rec_id"), "text").unionByName(
        sections.select(F.lit("section").alias("src"), F.concat("paper_id", F.lit("_section_"), "id").alias("rec_id"), "text")
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Records with at least one trace of scanning."""
    repaired = repair_scans(p6_records(spark, root), ["src", "rec_id"], "text")
    return repaired.where("edge_lines + cut_words + misread > 0").select("src", "rec_id").distinct()


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """The repaired text of every record, each once."""
    return repair_scans(p6_records(spark, root), ["src", "rec_id"], "text").distinct()
