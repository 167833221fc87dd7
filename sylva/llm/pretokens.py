"""Splitting texts into pre-tokens, the pieces within which merges happen."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


class _Parts(dict):
    """The pre-tokens of parts that follow a space, with that space; remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, part: str) -> list[str]:
        found = self.find(" " + part)
        if "\n" not in part and len(part) < 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = found
        return found


class PreTokenizer:
    """Splits texts by a pattern that never crosses a lone space between two other characters.

    Such a space always begins a pre-token, so the parts between spaces are split one by one and remembered.
    Texts with two white-space characters together, or with a special string, are split whole.
    """

    RUN = re.compile(r"\s\s")

    def __init__(self, pattern: str, special: tuple[str, ...] = ()):
        self.find = regex.compile(pattern).findall
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.parts = _Parts(self.find)

    def whole(self, text: str) -> list[str]:
        if self.cut is None:
            return self.find(text)
        out: list[str] = []
        for x in self.cut.split(text):
            out += [x] if x in self.special else self.find(x)
        return out

    def simple(self, text: str) -> bool:
        return not (self.RUN.search(text) or any(s in text for s in self.special))

    def split(self, text: str) -> list[str]:
        if not self.simple(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return [*self.find(first), *chain.from_iterable(map(self.parts.__getitem__, rest))]

    def counts(self, text: str) -> Counter:
        """How often each pre-token occurs in a text."""
        if not self.simple(text):
            return Counter(self.whole(text))
        first, *rest = text.split(" ")
        out = Counter(self.find(first))
        for x, n in Counter(rest).items():
            for piece in self.parts[x]:
                out[piece] += n
        return out


class Numbered:
    """Texts as numbers of their pre-tokens, for a worker to keep: each part between spaces is split once, whole batches are looked up."""

    #: Parts, and characters in each of so many on average, after which its owner should forget.
    PARTS, CHARACTERS = 1_200_000, 20

    def __init__(self, splitter: PreTokenizer, parts: int | None = None):
        self.splitter, self.most = splitter, parts or self.PARTS
        self.forget()

    def forget(self) -> None:
        #: The numbers of pre-tokens, in order; those of parts, where one that begins a text has a space before it.
        self.pieces: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.characters = 0
        self.content, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open, self.close = np.zeros(0, bool), np.zeros(0, bool)  # parts that begin or end with white space, or are empty

    @property
    def full(self) -> bool:
        return len(self.parts) > self.most or self.characters > self.most * self.CHARACTERS

    def _numbers(self, pieces: Iterable[str]) -> np.ndarray:
        known = self.pieces
        return np.array([known.setdefault(p, len(known)) for p in pieces], np.int32)

    def _learn(self, parts: list[str], first: bool) -> None:
        if not parts:
            return
        find = self.splitter.find
        split = list(map(find, parts)) if first else [find(" " + p) for p in parts]
        content, lengths = self._numbers(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.concatenate([self.starts, len(self.content) + np.cumsum(lengths) - lengths])
        self.content = np.concatenate([self.content, content])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.open = np.concatenate([self.open, [not p or p[0].isspace() for p in parts]])
        self.close = np.concatenate([self.close, [not p or p[-1].isspace() for p in parts]])
        self.parts.update(zip([" " + p for p in parts] if first else parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))
        self.characters += sum(map(len, parts))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pre-tokens, one after the other, and where each text's end, from 0. A null text has none."""
        return self.pieces_of(texts, *self.parts_of(texts))

    def parts_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts, and where each text's end, from 0. New ones are learned."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)])
        flat = lists.flatten()
        parts = flat.dictionary_encode()
        names, firsts = parts.dictionary.to_pylist(), flat.take(pa.array(ends[:-1])).to_pylist()
        self._learn([p for p in names if p not in self.parts], False)
        self._learn([p for p in dict.fromkeys(firsts) if " " + p not in self.parts], True)
        at = np.fromiter(map(self.parts.__getitem__, names), np.int32, len(names))[parts.indices.to_numpy()]
        at[ends[:-1]] = [self.parts[" " + p] for p in firsts]
        return at, ends

    def pieces_of(self, texts: pa.Array, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What cut() returns, from what parts_of() has returned for these texts."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        lengths = self.lengths[at]
        tops = np.cumsum(lengths)
        pieces = self.content[np.repeat(self.starts[at] - (tops - lengths), lengths) + np.arange(tops[-1])]
        piece_ends = np.concatenate([[0], tops])[ends]
        whole = self._whole(texts, at, ends)
        if len(whole):
            each = np.split(pieces, piece_ends[1:-1])
            for i in whole.tolist():
                each[i] = self._numbers(self.splitter.whole(texts[i].as_py()))
            pieces, piece_ends = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return pieces, piece_ends

    def _whole(self, texts: pa.Array, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The texts that aren't split by parts: a space is beside other white space there, or they hold a special string."""
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        found = (self.close[at[:-1]] | self.open[at[1:]]) & (text[:-1] == text[1:])
        special = [np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)) for s in self.splitter.special]
        return np.unique(np.concatenate([text[:-1][found], *special]))
