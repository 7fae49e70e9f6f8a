"""Problem 9: the share of a document that is repeated content, and the documents dominated by it.

A decision list over cheap statistics of a document's words names the documents that look dominated: it is learned by
sequential covering from a bounded sample whose labels are the exact measure; each rule is a conjunction of thresholds,
grown by information gain on two thirds of the sample and pruned on the rest. The list is emitted as an ordered Spark
``CASE``. An exact check follows, which follows copies over changed words. A document that no rule covers is checked as
well unless its statistics rule it out: a copy is made of runs of five words at most two words apart, so at least
five sevenths of it lie in such runs, and a document whose share of these runs is under five sevenths of the limit
cannot reach it. So no document depends on the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.words import Words, plain
from folioscale.session import table

FEATURES = ("share_8", "share_5", "most", "longest", "distinct", "words")
SEED, LEAST, CHANGED = 5, 8, 2
_DIGITS = re.compile(r"\d+")
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1 << 16)
def numberless(word: str) -> str:
    """The plain form in one piece, with every number read as 0."""
    return _DIGITS.sub("0", plain(word).replace(" ", ""))


def _later_copies(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words, by its first word, how many equal runs of its document stand before it."""
    number = np.zeros(len(ids), dtype=np.int64)
    runs = len(ids) - n + 1
    if runs < 2:
        return number
    with np.errstate(over="ignore"):
        key = doc[:runs].astype(np.uint64) * _SPREAD
        for k in range(n):
            key = (key ^ (ids[k : k + runs].astype(np.uint64) + np.uint64(1))) * _MIX
            key ^= key >> np.uint64(29)
    at = np.flatnonzero(doc[:runs] == doc[n - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    here = np.arange(len(order))
    number[order] = here - np.maximum.accumulate(np.where(same, 0, here))
    return number


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether each word lies in one of the runs of n words that begin at ``starts``."""
    edge = np.bincount(starts, minlength=size + n) - np.bincount(starts + n, minlength=size + n)[: size + n]
    return np.cumsum(edge[:size]) > 0


def statistics(texts: pa.Array, block: int = 1024) -> dict[str, np.ndarray]:
    """FEATURES of each text; all 0 for texts without words.

    share_5, share_8: share of words in later copies of five words, and in stretches of eight or more such words;
    most: copies of the most frequent run; longest: length of the longest stretch over the number of words; distinct:
    distinct words over all.
    """
    return _joined([_statistics(Words(texts.slice(i, block), numberless)) for i in range(0, len(texts), block)])


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {f: np.concatenate([p[f] for p in parts]) if parts else np.zeros(0) for f in FEATURES}


def _statistics(w: Words) -> dict[str, np.ndarray]:
    n, ids = len(w), w.ids
    sizes = np.diff(w.starts)
    doc = np.repeat(np.arange(n), sizes)
    many = np.maximum(sizes, 1)
    kinds = np.bincount(np.unique(doc * (len(w.forms) + 1) + ids) // (len(w.forms) + 1), minlength=n)
    number = _later_copies(ids, doc, 5)
    later = np.flatnonzero(number)
    # three more runs of five in a row make eight words
    at = later[np.isin(later + 3, later) & np.isin(later + 1, later) & np.isin(later + 2, later)] if len(later) else later
    covered_5, covered_8 = _covered(later, 5, len(ids)), _covered(at, 8, len(ids))
    place = np.arange(len(ids))
    fresh = np.where(covered_8, -1, place)
    if len(ids):
        fresh = np.maximum(np.maximum.accumulate(fresh), np.repeat(w.starts[:-1], sizes) - 1)
    most, longest = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(sizes)
    if len(full):
        most[full] = np.maximum.reduceat(number, w.starts[:-1][full])
        longest[full] = np.maximum.reduceat(np.where(covered_8, place - fresh, 0), w.starts[:-1][full])
    return {
        "share_8": np.bincount(doc, covered_8, n) / many, "share_5": np.bincount(doc, covered_5, n) / many,
        "most": most, "longest": longest / many, "distinct": kinds / many, "words": sizes.astype(float),
    }


def _cover_pairs(words: list[int], places: dict[tuple, list[int]], covered: np.ndarray, seed: int, least: int, changed: int) -> None:
    """Marks the later copies of any earlier source.

    A copy of ``least`` words or more holds two of its runs ``least - seed`` to ``seed + changed`` words apart, so a second
    occurrence of such a pair of runs at the same distance is a copy of the first. Runs of the copy beyond its pairs reach
    less than ``least - seed`` words further: the pair is looked up with these words at either side as well.
    """
    n = len(words)
    run, again = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    many = [seen for seen in places.values() if len(seen) > 1]
    at = np.array([i for seen in many for i in seen], dtype=np.int64)
    run[at] = np.repeat(np.arange(len(many)), [len(seen) for seen in many])
    again[at] = True
    again[[seen[0] for seen in many]] = False
    starts = np.flatnonzero(run >= 0)
    held = np.concatenate(([0], np.cumsum(covered)))
    once_more = np.flatnonzero(again)
    if (held[once_more + seed] - held[once_more] == seed).all():
        return  # every later occurrence of a run is covered, and a copy holds nothing else
    for j in range(max(1, least - seed), seed + changed + 1):
        first = starts[starts + j < n]
        first = first[run[first + j] >= 0]
        later = again[first] & again[first + j]
        if not later.any():
            continue
        pair = run[first] * len(many) + run[first + j]
        held = np.concatenate(([0], np.cumsum(covered)))
        for before in range(least - seed):
            for after in range(least - seed):
                size = before + j + seed + after
                inside = (first >= before) & (first - before + size <= n)
                # only pairs that a later copy not yet covered may hold
                begin = np.where(inside, first - before, 0)
                asked = later & inside & (held[np.minimum(begin + size, n)] - held[begin] < size)
                if not asked.any():
                    continue
                known = set()
                for i, p in zip(first[inside & np.isin(pair, pair[asked])].tolist(), pair[inside & np.isin(pair, pair[asked])].tolist()):
                    begin_, end = i - before, i - before + size
                    key = (p, *words[begin_:i], *words[end - after : end])
                    if key in known:
                        covered[begin_:end] = True
                    known.add(key)


def exact_share(words: list[int], seed: int = SEED, least: int = LEAST, changed: int = CHANGED) -> float:
    """Share of words in second or later copies of a run of at least ``least`` words.

    A copy is followed from its source word by word; stretches that agree in ``seed`` words on one distance and are
    at most ``changed`` words apart are one copy. Sources are all earlier occurrences: first the first and the nearest
    of each run, then, where these leave a repeated run uncovered, all others by _cover_pairs. Time is linear in the text.
    """
    n = len(words)
    if n < least:
        return 0.0
    places: dict[tuple, list[int]] = {}
    at: dict[int, list[int]] = {}
    for i in range(n - seed + 1):
        seen = places.setdefault(tuple(words[i : i + seed]), [])
        if seen:
            for d in {i - seen[0], i - seen[-1]}:
                at.setdefault(d, []).append(i)
        seen.append(i)
    covered = np.zeros(n, dtype=bool)

    def cover(starts: list[int]) -> None:
        begin = end = None
        for i in [*starts, n + seed + changed + 1]:
            if begin is not None and i <= end + changed:
                end = i + seed
                continue
            if begin is not None and end - begin >= least:
                covered[begin:end] = True
            begin, end = i, i + seed

    for starts in at.values():
        cover(starts)
    if any(len(seen) > 2 for seen in places.values()):
        _cover_pairs(words, places, covered, seed, least, changed)
    return float(covered.mean())


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(y), dtype=bool)
    while (y & inside).any() and (~y & inside).any():
        p0, n0 = (y & inside).sum(), (~y & inside).sum()
        best, gain = None, 1e-9
        for f, values in x.items():
            seen = np.unique(values[inside])
            cuts = (seen[1:] + seen[:-1]) / 2
            for cut in cuts if len(cuts) <= 256 else np.quantile(cuts, np.linspace(0, 1, 256)):
                for above in (True, False):
                    c = Condition(f, above, float(cut))
                    now = inside & c.holds(x)
                    p, q = (y & now).sum(), (~y & now).sum()
                    if p and (g := p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def learn_list(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, most_rules: int = 12) -> list[Rule]:
    """Rules in order; a case is positive if any holds. Without positives in the sample, the one rule () lets all through."""
    if not y.any():
        return [()]
    rng = np.random.default_rng(seed)
    left, rules = np.arange(len(y)), []
    while y[left].any() and len(rules) < most_rules:
        mixed = rng.permutation(left)
        grow, prune = mixed[: 2 * len(mixed) // 3 or 1], mixed[2 * len(mixed) // 3 :]
        if not y[grow].any():
            grow = prune = left
        rule = _grow({f: v[grow] for f, v in x.items()}, y[grow])
        part = {f: v[prune] for f, v in x.items()}

        def worth(r: Rule) -> tuple[float, int]:
            on = _holds(r, part, len(prune))
            p, q = (y[prune] & on).sum(), (~y[prune] & on).sum()
            return ((p - q) / (p + q) if p + q else -1.0, int(p))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)
        on = _holds(rule, {f: v[left] for f, v in x.items()}, len(left))
        if not (y[left] & on).any():
            break
        rules.append(rule)
        left = left[~on]
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The decision list as one ordered CASE: the number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled(documents: DataFrame, key: str, text: str, sample: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and exact shares of at most ``sample`` rows, those of the least hashes of the key.

    A bound on the hash that about twice the sample passes comes first, so few texts meet in one task.
    """
    total = documents.count()
    bound = 2**63 - 1 if total <= 2 * sample else int(2 * sample / total * 2**64) - 2**63
    rows = documents.select(F.col(text).cast("string").alias("text"), F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    rows = rows.where(F.col("h") <= bound).orderBy("h", "k").limit(sample).select("text").toArrow()
    texts = pa.concat_arrays(rows.column(0).chunks) if rows.num_rows else pa.array([], pa.string())
    w = Words(texts, numberless)
    return statistics(texts), np.array([exact_share(w.of(i).tolist()) for i in range(len(w))])


def fit(documents: DataFrame, key: str, text: str, share: float, sample: int) -> list[Rule]:
    """A list that names documents of at least ``share``, learned from at most ``sample`` rows."""
    x, exact = labelled(documents, key, text, sample)
    return learn_list(x, exact >= share)


def measure_repetition(
    documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.3, sample: int = 2000, found_only: bool = False
) -> DataFrame:
    """doc_id, rule (of the list, 0 if none), repeated (share of words in later copies) of each document.

    Every share given is exact_share, whatever the rule. found_only: only documents of at least ``share``; the exact
    measure is then taken where a rule or the statistics ask for it. Case, punctuation and numbers never count. Null,
    empty and very short texts have 0. ``sample`` bounds the labelled rows. Columns other than ``key`` and ``text`` are
    ignored; repeated rows are measured each; an empty table gives no rows.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rules = fit(documents, key, text, share, sample)
    floor = share * SEED / (SEED + CHANGED) - 1e-9
    names = ["doc_id", *FEATURES, "repeated"]

    def run(batches: Iterator[pa.RecordBatch], block: int = 1024) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                w = Words(batch.column(1), numberless)
                found = _statistics(w)
                asked = found["share_5"] >= floor if found_only else np.ones(len(w), dtype=bool)
                exact = [exact_share(w.of(i).tolist()) if asked[i] else None for i in range(len(w))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f]) for f in FEATURES), pa.array(exact, pa.float64())], names=names)

    measured = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES) + ", repeated double")
    measured = measured.withColumn("rule", as_column(rules))
    if found_only:
        # what a rule names and what none covers but the statistics cannot rule out; then the exact check
        measured = measured.where(((F.col("rule") > 0) | (F.col("share_5") >= floor)) & (F.col("repeated") >= share))
    return measured.select("doc_id", "rule", "repeated")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents of which at least three tenths are repeated content."""
    return measure_repetition(table(spark, root, "documents"), found_only=True).select("doc_id").distinct()


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """The repeated share of every document."""
    return measure_repetition(table(spark, root, "documents"))


#: The measure by all distances at once: every two equal runs of five words, chained where they keep their distance.
P9_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s\p{Z}]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[\s\p{Z}]+'), 1) AS k FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, k, CASE WHEN regexp_matches(w, '^(?:\[\d+(?:[,;–-]\d+)*[\],;]?|\d+(?:[,;–-]\d+)*\])[.,):;!?]*$') THEN ''
  ELSE regexp_replace(regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g'), '\p{Nd}+', '0', 'g') END AS w FROM raw),
words AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM plain WHERE w <> ''),
runs AS (SELECT doc_id, pos, n, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS run FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT b.doc_id, b.n, b.pos - a.pos AS d, b.pos AS s FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND a.run = b.run AND a.pos < b.pos),
links AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, d ORDER BY s) <= 7 THEN 0 ELSE 1 END AS fresh FROM pairs),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, d ORDER BY s ROWS UNBOUNDED PRECEDING) AS chain FROM links),
copies AS (SELECT doc_id, n, min(s) AS a, max(s) + 5 AS b FROM chained GROUP BY doc_id, n, d, chain HAVING max(s) + 5 - min(s) >= 8),
reach AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM copies)
SELECT doc_id FROM reach GROUP BY doc_id, n HAVING sum(greatest(0, b - greatest(a, coalesce(before, a)))) >= 0.3 * n
"""
