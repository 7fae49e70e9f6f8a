"""Problem 5: items over a size limit are cut at natural boundaries, with an overlap of consecutive pieces.

Every position of a text has a boundary strength: 5 after a blank line, 4 after a line end, 3 after a sentence, 2 after
a clause, 1 after a word, 0 elsewhere, -1 inside a combined character. A sparse table of range maxima over (strength,
position) gives, for each window of permissible lengths, the strongest cut, ties broken rightward; the next piece
starts at the strongest boundary at most ``overlap`` characters back. Strengths are one byte a character; the sparse
tables are built block by block, so they do not grow with the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import table

SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTENCE_ENDS, CLAUSE_ENDS, WIDE_ENDS, CLOSERS = ".!?…", ",;:", "。！？；", ")]}\"'”’»"
BLOCK = 1 << 16
_PLACE = np.int64(1) << 40


@cache
def combining() -> np.ndarray:
    """Code points that belong to the character before them: marks, joiners, variation selectors and skin tones."""
    found = [n for n in range(0x300, 0x20000) if unicodedata.category(chr(n)) in ("Mn", "Mc", "Me")]
    return np.array([*found, 0x200D, *range(0x1F3FB, 0x1F400), *range(0xE0020, 0xE0080), *range(0xE0100, 0xE01F0)], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in chars])


def boundary_strengths(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position 0..n; position i separates codes[i-1] from codes[i]."""
    n = len(codes)
    out = np.zeros(n + 1, dtype=np.int8)
    if n < 2:
        return out
    space, newline = np.isin(codes, SPACES), (codes == 10) | (codes == 0x2029)
    after = np.zeros((n, 4), dtype=bool)  # what the text up to and with i ends on: closer-free sentence, clause, wide end
    closed = _among(codes, CLOSERS)
    ends = _among(codes, SENTENCE_ENDS)
    ends[1:] |= closed[1:] & ends[:-1]
    after[:, 0], after[:, 1], after[:, 2] = ends, _among(codes, CLAUSE_ENDS), _among(codes, WIDE_ENDS)
    cut = out[1:n]
    left, right = space[:-1], ~space[1:]
    cut[left & right] = 1
    before = np.zeros((n - 1, 2), dtype=bool)
    before[1:, 0], before[1:, 1] = after[: n - 2, 0], after[: n - 2, 1]
    cut[left & right & before[:, 1]] = 2
    cut[left & right & before[:, 0]] = 3
    cut[after[:-1, 2]] = 3
    cut[newline[:-1]] = 4
    blank = newline.copy()
    blank[0] = False
    blank[1:] &= newline[:-1]
    cut[blank[:-1]] = 5
    joined = np.isin(codes, combining())
    joined[1:] |= codes[:-1] == 0x200D
    flags = (codes >= 0x1F1E6) & (codes <= 0x1F1FF)
    if flags.any():  # regional letters go in pairs, counted from the start of each run
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(flags, 0, place + 1))
        joined |= flags & ((place - start) % 2 == 1)
    cut[joined[1:]] = -1
    return out


class RangeMaximum:
    """Sparse table over keys: the largest key of any range of at most ``longest`` places in two look-ups."""

    def __init__(self, keys: np.ndarray, longest: int) -> None:
        self.levels = [keys]
        while (1 << len(self.levels)) <= min(longest, len(keys)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def largest(self, start: int, stop: int) -> int:
        level = (stop - start).bit_length() - 1
        row = self.levels[level]
        return int(max(row[start], row[stop - (1 << level)]))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) in code points that cover the text, each of at most ``limit``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    strength = boundary_strengths(_codes(text))
    least = max(limit // 2, overlap + 1)
    found, start, base, index = [], 0, -1, None
    while n - start > limit:
        if index is None or start + limit + 1 > base + BLOCK:
            base = start
            part = strength[base : base + max(BLOCK, limit + 1)].astype(np.int64)
            index = RangeMaximum((part + 1) * _PLACE + np.arange(len(part)), limit)
        end = base + index.largest(start + least - base, start + limit + 1 - base) % int(_PLACE)
        found.append((start, end))
        if overlap:
            back = strength[end - overlap : end]
            strongest = back.max()
            start = end - overlap + (int(back.argmax()) if strongest > 0 else int((back >= 0).argmax()))
        else:
            start = end
    found.append((start, n))
    return found


def split_oversized(
    items: DataFrame, keys: list[str], text: str, limit: int = 2400, overlap: int = 200, with_text: bool = True
) -> DataFrame:
    """Pieces of all items longer than ``limit``: keys, piece, char_start, char_end, and piece_text if wanted.

    Lengths are code points. Items within the limit, null texts included, give no pieces: they stand as they are.
    Columns other than ``keys`` and ``text`` are ignored. Repeated rows give repeated pieces.
    """
    long = items.where(F.length(text) > limit).select(*keys, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields[:-1]]
    schema = ", ".join([*fields, "piece bigint", "char_start bigint", "char_end bigint", *["piece_text string"] * with_text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, spans = [], []
            for i, whole in enumerate(batch["__text"]):
                for k, (a, b) in enumerate(pieces(whole, limit, overlap)):
                    rows.append(i)
                    spans.append((k, a, b, *((whole[a:b],) if with_text else ())))
            out = batch[keys].iloc[rows].reset_index(drop=True)
            names = ["piece", "char_start", "char_end", *["piece_text"] * with_text]
            yield pd.concat([out, pd.DataFrame(spans, columns=names, index=out.index)], axis=1)

    return long.mapInPandas(run, schema)


def p5_items(spark: SparkSession, root: str) -> DataFrame:
    """All texts of problem 5: src, rec_id, text."""
    chunks, sections = table(spark, root, "chunks"), table(spark, root, "sections")
    one = lambda src, col: F.struct(F.lit(src).alias("src"), F.col(col).alias("text"))
    of_chunks = chunks.select(
        F.col("chunk_id").alias("rec_id"),
        F.inline(F.array(one("chunk_text", "text"), one("chunk_embed_body", "embed_body"))),
    )
    of_sections = sections.select(
        F.concat("paper_id", F.lit("_section_"), "id").alias("rec_id"), F.lit("section_text").alias("src"), "text"
    )
    return of_chunks.unionByName(of_sections).select("src", "rec_id", "text")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Items that had to be cut."""
    cut = split_oversized(p5_items(spark, root), ["src", "rec_id"], "text", with_text=False)
    return cut.select("src", "rec_id").distinct()


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces themselves, each once."""
    return split_oversized(p5_items(spark, root).distinct(), ["src", "rec_id"], "text")


P5_SQL = """
SELECT DISTINCT 'chunk_text' AS src, chunk_id AS rec_id FROM chunks WHERE length(text) > 2400 UNION ALL
SELECT DISTINCT 'chunk_embed_body', chunk_id FROM chunks WHERE length(embed_body) > 2400 UNION ALL
SELECT DISTINCT 'section_text', paper_id || '_section_' || id FROM sections WHERE length(text) > 2400
"""
