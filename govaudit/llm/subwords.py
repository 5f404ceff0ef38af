"""Whole texts to the ids of a public tokenizer, each distinct stretch of text encoded once per worker.

A text is cut before white space that follows other characters. No token of
these tokenizers spans such a cut, so the ids of a text are those of its
stretches one after the other; the tokenizers library encodes each stretch.
"""

from __future__ import annotations

import os
import re

import numpy as np

from govaudit.llm.common import SPACE, byte_hashes, slices, spread

#: White space, then letters below U+0250, then one mark: these are tokens of their own before merging.
_PLAIN = re.compile("(\n?)( ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])+)([.,;:!?|]?)")

#: Stretches that a worker remembers before it starts anew (about 30 bytes each).
REMEMBERED = 2_000_000
#: Words between marks that it remembers as well.
REMEMBERED_WORDS = 200_000
_tables: dict[str, SubwordTable] = {}


def subword_table(path: str) -> SubwordTable:
    """This worker's table for a tokenizer file."""
    if path not in _tables:
        _tables[path] = SubwordTable(path)
    return _tables[path]


def stretch_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text, and at ASCII white space after anything that isn't white space.

    White space of more than one byte never has a cut behind it: a run of
    white space stays together.
    """
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n:
        space = SPACE[data]
        cut[1:] = space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        last, lead = data[at - 1], data[np.maximum(at - 3, 0)]
        two = (data[np.maximum(at - 2, 0)] == 0xC2) & ((last == 0x85) | (last == 0xA0))
        three = (lead >= 0xE1) & (lead <= 0xE3) & (last >= 0x80) & (last < 0xC0)
        cut[at[two | three]] = False
        begins = offsets[:-1]
        cut[begins[begins < offsets[1:]]] = True
    return np.flatnonzero(cut)


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level tokenizer names each byte: printable Latin-1 characters
    name themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class SubwordTable:
    """The ids of every stretch seen so far, by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # a byte-level tokenizer without normaliser: its model can be given words as they are
        from tokenizers.pre_tokenizers import ByteLevel

        plain = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.letters = byte_letters() if plain else None
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.words: dict[str, list[int]] = {}

    def ids_of(self, stretch: str) -> list[int]:
        """The ids of a stretch; letters and marks of plain ones go to the tokenizer's model one by one."""
        plain = self.letters is not None and _PLAIN.fullmatch(stretch)
        if not plain:
            return self.tokenizer.encode(stretch, add_special_tokens=False).ids
        ids: list[int] = []
        for word in plain.groups():
            if word:
                if word not in self.words:
                    if len(self.words) >= REMEMBERED_WORDS:
                        self.words.clear()
                    known = word.encode().decode("latin-1").translate(self.letters)
                    self.words[word] = [x.id for x in self.model.tokenize(known)]
                ids += self.words[word]
        return ids

    def learn(self, hashes: np.ndarray, stretches: list[str]) -> None:
        """Adds stretches that aren't in the table; hashes ascend."""
        encoded = [self.ids_of(x) for x in stretches]
        counts = np.array([len(x) for x in encoded], dtype=np.int64)
        new = np.concatenate([np.array(x, dtype=np.uint32) for x in encoded])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used: self.used + len(new)] = new
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.used += len(new)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and n + 1 offsets into them."""
        ids, lengths = [], []
        for a, b in slices(offsets, 1 << 21):
            part, its = self._encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            ids.append(part)
            lengths.append(its)
        ends = np.zeros(len(offsets), dtype=np.int64)
        if lengths:
            np.cumsum(np.concatenate(lengths), out=ends[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), ends

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = stretch_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        distinct, seen_at, which = np.unique(byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        if not known.all():
            new = seen_at[~known]
            raw = data.tobytes()
            self.learn(distinct[~known], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        at = at[which]
        counts = self.count[at]
        ids = self.flat[spread(counts, self.first[at])]
        running = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(counts, out=running[1:])
        bounds = running[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)
