"""Whole texts to token ids with the public tokenizers, a word at a time.

Both vocabularies cut a text before every single space (and around a single newline), whatever stands next
to it, so the ids of a text are the ids of its words in a row. Words repeat: each batch asks the tokenizer
only for words that it has not met lately. Texts where white space stands in runs or at an end go through
the tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words remembered by one worker (about 150 bytes each); beyond it only the half met first stays, as frequent words come early.
WORDS_KEPT = 1_200_000

#: New words put to the tokenizer in one text.
IN_ONE_TEXT = 100

#: Stands before the first word of a text in the table of words; no text can hold it.
FIRST = "\ud800"


class _Words(dict):
    """The place of each word in the table; a word that is new gets the next place and waits for its ids."""

    def __init__(self, of: dict[str, int] | None = None):
        super().__init__(of or {})
        self.new: list[str] = []
        self.next = len(self)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = self.next
        self.next += 1
        return place


class Encoder:
    """Encodes lists of texts; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` for every text.

    file: a tokenizers JSON file. newline_is_space: the vocabulary turns a newline into a space before it cuts.
    None counts as the empty text, which has no ids.
    """

    def __init__(self, file: str, newline_is_space: bool, words_kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.newline_is_space = newline_is_space
        self.words_kept = words_kept
        #: Stands between new words in one text, as a token of its own that none of them holds.
        self.between = " \x1e " if newline_is_space else "\n"
        (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.words = _Words()
        #: Of the word at a place: its ids are ids[ends[place]:ends[place + 1]]; odd ones cannot be told apart from what stands around them.
        self.ids, self.ends, self.odd = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _forget(self) -> None:
        keep = self.words_kept // 2
        self.words = _Words({w: i for w, i in self.words.items() if i < keep})
        self.ids, self.ends, self.odd = self.ids[: self.ends[keep]].copy(), self.ends[: keep + 1].copy(), self.odd[:keep].copy()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Find the ids of the words that wait."""
        new, self.words.new = self.words.new, []
        got: list[list[int]] = [[]] * len(new)
        odd = np.zeros(len(new), bool)
        plain, alone, lone_texts = [], [], []
        for i, w in enumerate(new):
            if w.strip() == w and w and w[0] != FIRST and "\n" not in w and "\x1e" not in w:
                plain.append(i)
                continue
            body = w.removeprefix(FIRST)
            text = body if body is not w or w[:1] == "\n" else " " + w
            inner = body[1:] if body is w and w[:1] == "\n" and not self.newline_is_space else body
            if inner and inner.strip() == inner:
                alone.append(i)
                lone_texts.append(text)
            else:
                odd[i] = True
        for a in range(0, len(plain), 100 * IN_ONE_TEXT):
            part = plain[a : a + 100 * IN_ONE_TEXT]
            texts = [self.between.join([" " + new[i] for i in part[k : k + IN_ONE_TEXT]]) + self.between for k in range(0, len(part), IN_ONE_TEXT)]
            flat = list(chain.from_iterable(self._ids(texts)))
            cuts = np.flatnonzero(np.array(flat, np.uint32) == self.between_id).tolist()
            if len(cuts) == len(part):
                start = 0
                for i, z in zip(part, cuts, strict=True):
                    got[i] = flat[start:z]
                    start = z + 1
            else:  # a word has the separator's id in it
                alone += part
                lone_texts += [" " + new[i] for i in part]
        for i, ids in zip(alone, self._ids(lone_texts), strict=True):
            got[i] = ids
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])
        self.odd = np.concatenate([self.odd, odd])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        if len(self.words) > self.words_kept:
            self._forget()
        with_newlines = " " if self.newline_is_space else " \n"
        split = [(FIRST + (t or "")).replace("\n", with_newlines).split(" ") for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.words.new:
            self._learn()
        begin = self.ends[rows]
        size = self.ends[rows + 1] - begin
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        first = np.cumsum(counts) - counts
        lengths = np.add.reduceat(size, first) if len(texts) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        strange = np.flatnonzero(np.logical_or.reduceat(self.odd[rows], first)) if len(texts) else []
        if len(strange):
            whole = self._ids([texts[i] or "" for i in strange])
            parts, at = [], 0
            for i, own in zip(strange, whole, strict=True):
                parts += [ids[at : bounds[i]], np.array(own, np.uint32)]
                at = bounds[i + 1]
                lengths[i] = len(own)
            ids, bounds = np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(lengths)])
        return ids, bounds


@lru_cache(maxsize=4)
def encoder(file: str, newline_is_space: bool) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(file, newline_is_space)


def little_batches(texts: list[str | None], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about `most` characters each, so that memory follows the largest text, not the batch."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
