"""Vectorised words of a batch of texts: one Arrow split, one dictionary, and Python only over distinct words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A citation mark or a part of one, as white space cuts it: ``[12]``, ``[4,``, ``46].``.
CITATION = re.compile(r"^(?:\[\d+(?:[,;–-]\d+)*[\],;]?|\d+(?:[,;–-]\d+)*\])[.,;:!?)]*$")
_NOT_WORD = re.compile(r"[\W_]+")


@lru_cache(maxsize=1 << 16)
def plain(word: str) -> str:
    """Letters and digits of a word in one case, parts separated by single blanks; empty for marks and citations."""
    if word.isascii() and word.isalnum():
        return word.lower()
    if CITATION.match(word):
        return ""
    return _NOT_WORD.sub(" ", unicodedata.normalize("NFKC", word).lower()).strip()


class Words:
    """Words of texts in a row: ``ids`` into ``forms``, and ``starts`` of each text among them.

    Words whose form is empty are left out. Null texts count as empty.
    """

    def __init__(self, texts: pa.Array, form: Callable[[str], str] = plain) -> None:
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        self.raw = coded.dictionary.to_pylist()
        place: dict[str, int] = {}
        to = np.empty(len(self.raw), dtype=np.int64)
        for i, word in enumerate(self.raw):
            f = form(word)
            to[i] = place.setdefault(f, len(place)) if f else -1
        raw_ids = coded.indices.to_numpy(zero_copy_only=False)
        ids = to[raw_ids]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, dtype=np.int64)
        kept = ids >= 0
        before = np.concatenate(([0], np.cumsum(kept)))
        self.starts = before[offsets]
        self.ids = ids[kept]
        self.raw_ids = raw_ids[kept]
        self.forms = list(place)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def joined(self) -> list[str]:
        """Each text as its forms between blanks, with a blank at either end."""
        forms = self.forms
        return [f" {' '.join([forms[w] for w in self.of(i).tolist()])} " for i in range(len(self))]
