"""Problem 7: evaluation texts inside the corpus.

All runs of ``run_words`` words of all items, normalised, make one Aho-Corasick automaton; each document, normalised
in the same way, is scanned once. The hits of an item in a document are chained along the item's word order into at
most two close passages; the pair is a leak if they span at least ``share`` of the item's words, of which at most the
share ``changed`` differ, and their offsets are mapped back to the original text.

The evaluation set is cut into slices of bounded size, with one automaton each, that every Python worker builds once;
there is no limit to the number of slices. Documents are never shuffled: the result has a row per leak only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.words import CITATION, Words, plain
from folioscale.session import table

#: Characters of the evaluation set in one automaton: under a million runs of words, some hundred MB in a worker.
SLICE_CHARS = 4_000_000
_POINT = re.compile(r"(?<=\d)[.,](?=\d)")


@lru_cache(maxsize=1 << 16)
def leak_form(word: str) -> str:
    """The plain form of a word; the points and commas inside a number are punctuation, not gaps."""
    return plain(_POINT.sub("", word)) if word[:1] != "[" else plain(word)


def item_words(text: str) -> list[str]:
    return [part for word in text.split() for part in leak_form(word).split()]


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...], run_words: int, stock: float):
    """The automaton, the items' words, each pattern's start among the (item, place) pairs, these, and which are stock phrases.

    A stock phrase stands in more than three items and in more than the share ``stock`` of all.
    """
    import ahocorasick

    words = [item_words(text) for _, text in items]
    patterns: dict[str, list[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        n = min(run_words, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(f" {' '.join(w[p : p + n])} ", []).append((i, p))
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, pattern in enumerate(patterns):
        found.add_word(pattern, k)
    if patterns:
        found.make_automaton()
    starts = np.concatenate(([0], np.cumsum([len(p) for p in patterns.values()]))).astype(np.int64)
    places = np.array([x for p in patterns.values() for x in p], dtype=np.int64).reshape(-1, 2)
    spread = np.array([len({i for i, _ in p}) for p in patterns.values()], dtype=np.int64)
    return found, words, starts, places, spread > max(3, stock * len(items))


def passages(hits: list[tuple[int, int]], run: int, drift: int = 2, gap: int = 12) -> list[tuple[int, int, int, int, int]]:
    """Chains of hits (document word, item word) as (item from, item to, document from, document to, words held).

    Two hits are of one chain if both advance, by at most ``gap`` words and by amounts at most ``drift`` apart.
    """
    open_, done = [], []
    for p, q in sorted(hits):
        best = None
        for c in open_:
            dp, dq = p - c[3], q - c[1]
            if dq > 0 and dp > 0 and dq <= gap + run and abs(dp - dq) <= drift and (best is None or c[4] > best[4]):
                best = c
        if best is not None:
            best[4] += min(run, q - best[1])
            best[1], best[3] = q, p
        else:
            open_.append([q, q, p, p, run])
        if len(open_) > 64:
            done += [c for c in open_ if p - c[3] > gap + run + drift]
            open_ = [c for c in open_ if p - c[3] <= gap + run + drift]
    return [(a, b + run, c, d + run, held) for a, b, c, d, held in done + open_]


def _extended(chain, doc: list[str], item: list[str]) -> tuple[int, int, int, int, int]:
    """The chain with the words of either end that a single changed word had cut off."""
    a, b, c, d, held = chain
    for step in (-1, 1):
        while True:
            ahead = 0
            for skip in (0, 1):
                i, j = (a - 1 - skip, c - 1 - skip) if step < 0 else (b + skip, d + skip)
                if 0 <= i < len(item) and 0 <= j < len(doc) and item[i] == doc[j]:
                    ahead = skip + 1
                    break
            if not ahead:
                break
            held += 1
            a, b, c, d = (a - ahead, b, c - ahead, d) if step < 0 else (a, b + ahead, c, d + ahead)
    return a, b, c, d, held


def common(a: list[str], b: list[str]) -> int:
    """Most words that two passages have in common, in order."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best_cover(chains, near: int, least: int, need: float, changed: float, doc: list[str], item: list[str], own=None) -> tuple[int, int, int] | None:  # noqa: ANN001
    """Item words spanned, first and last document word of the widest one or two close passages that make a leak.

    At least ``need`` item words are spanned, and all but ``changed`` of them, rounded up, are held. Of two passages, each
    has at least ``least`` words and is the item's ``own`` (a test of a chain): others are phrases that the field shares.
    """
    chains = sorted(chains, key=lambda c: c[2])
    covers = [((x,), x[1] - x[0]) for x in chains]
    chains = [x for x in chains if x[1] - x[0] >= least and (own is None or own(x))]
    for i, x in enumerate(chains):
        for y in chains[i + 1 :]:
            if y[2] - x[3] <= near and y[0] >= x[1] - 2 and y[2] >= x[3] - 2:
                covers.append(((x, y), x[1] - x[0] + y[1] - y[0]))
    for passed, spanned in sorted(covers, key=lambda c: -c[1]):
        if spanned < need:
            return None
        wanted = (1 - changed) * spanned - 1
        # counted words of the runs first; exactly only where those do not suffice
        if sum(c[4] for c in passed) >= wanted or sum(common(item[c[0] : c[1]], doc[c[2] : c[3]]) for c in passed) >= wanted:
            return spanned, passed[0][2], passed[-1][3]
    return None


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of a text's plain words, in the order of item_words."""
    found = []
    for m in re.finditer(r"\S+", text):
        if not CITATION.match(m.group()):
            found += [m.span()] * len(leak_form(m.group()).split())
    return found


def find_leaks(
    documents: DataFrame, key: str, text: str, items: list[tuple[int, str]],
    share: float = 0.4, changed: float = 0.1, run_words: int = 4, near: int = 40, least_passage: int = 8, stock: float = 0.01,
) -> DataFrame:
    """One row per leak: doc_id, item_id, share (of the item's words), char_start and char_end in the original text.

    items: (item_id, text) pairs; items without a word leak nowhere. Of two passages, each has at least ``least_passage``
    words, or a third of the words that the item must have in the document if that is less, and at least half of its runs
    are no stock phrases, which stand in more than the share ``stock`` of the items and in more than three. Null or empty documents hold
    no leak. Repeated documents give repeated rows; columns other than ``key`` and ``text`` are ignored.
    """
    items = tuple((i, t) for i, t in items if t)
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, share double, char_start bigint, char_end bigint"
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words, starts, places, common_run = _automaton(shared.value, run_words, stock)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        need = np.ceil(share * lengths)
        # a lower bound of the hits of any leak: a changed word spoils run_words runs, and each of two passages ends once
        least = np.maximum(1, need - run_words * (np.ceil(changed * need) + 2) + 1)
        apart = np.minimum(least_passage, np.ceil(need / 3))
        whole = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("char_start", pa.int64()), ("char_end", pa.int64())])
        for batch in batches if len(places) else ():
            out = []
            texts = batch.column(1)
            for n, doc in enumerate(Words(texts, leak_form).joined()):
                hits = np.array(list(automaton.iter(doc)), dtype=np.int64).reshape(-1, 2)
                many = starts[hits[:, 1] + 1] - starts[hits[:, 1]]
                total = int(many.sum())
                if not total:
                    continue
                at = np.repeat(starts[hits[:, 1]], many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                of, place, end, worn = places[at, 0], places[at, 1], np.repeat(hits[:, 0], many), np.repeat(common_run[hits[:, 1]], many)
                found, back, count = np.unique(of, return_inverse=True, return_counts=True)
                likely = np.flatnonzero(count >= least[found])
                if not len(likely):
                    continue
                tokens = doc.split()
                word_at = np.cumsum(np.frombuffer(doc.encode("utf-32-le"), dtype=np.uint32) == 32)
                spans = None
                for k in likely.tolist():
                    i, mine = int(found[k]), back == k
                    r = min(run_words, len(words[i]))
                    from_doc, from_item, stale = word_at[end[mine]] - 1 - r, place[mine], worn[mine]

                    def own(c) -> bool:  # noqa: ANN001
                        inside = (from_item >= c[0]) & (from_item < c[1]) & (from_doc >= c[2]) & (from_doc < c[3])
                        return 2 * int(stale[inside].sum()) <= int(inside.sum())

                    chains = passages(list(zip(from_doc.tolist(), from_item.tolist())), r)
                    chains = [_extended(c, tokens, words[i]) for c in chains]
                    best = best_cover(chains, near, int(apart[i]), share * len(words[i]), changed, tokens, words[i], own)
                    if best is not None:
                        spans = spans or _word_spans(texts[n].as_py())
                        spanned, first, last = best
                        out.append((batch.column(0)[n].as_py(), shared.value[i][0], spanned / len(words[i]), spans[first][0], spans[last - 1][1]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=whole.names), schema=whole, preserve_index=False)

    return rows.mapInArrow(run, schema)


def leaks_of(documents: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", slice_chars: int = SLICE_CHARS, **options) -> DataFrame:
    """find_leaks for an evaluation set of any size: the documents are scanned once for each slice of ``slice_chars`` characters.

    items: ``item`` and ``text``; items without id or text leak nowhere. Slices are made by hash of the id, so no slice
    depends on the order of rows.
    """
    items = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(chars) // slice_chars))
    out = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        found = find_leaks(documents, key, text, [(int(i), t) for i, t in part.collect()], **options)
        out = found if out is None else out.unionByName(found)
    return out


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Leaks with their place in the document."""
    return leaks_of(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the items they leak."""
    return p7_leaks(spark, root).select("doc_id", "item_id").distinct()
