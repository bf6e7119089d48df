"""Token ids of texts, chunk by chunk: a chunk that a worker has met before is not encoded again."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

#: A space between blanks, or before the end after one: there a text must not be cut. Wider than the blanks of the
#: tokenizers' pattern, so a text without any is safe to cut before each space.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_LONGEST = 48
#: Characters that are a piece of their own: marks between a letter and a space, a line's end between no blanks.
_MARKS = ",.;:!?\n"


class _Known(dict):
    """The ids of words with a space before them. A word it does not have is encoded, and kept if it is short."""

    def __init__(self, encode: Callable[[str], bytes], marks: dict[str, bytes], old: _Known | None):
        super().__init__()
        self._encode, self._marks = encode, marks
        self._old: dict[str, bytes] = dict(old) if old else {}
        self._first: dict[str, bytes] = {}  # the same of words at the start of a line

    def __missing__(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            head, line, tail = word.partition("\n")
            if line and head[-1:].strip() and tail[:1].strip():
                ids = self[head] + self._marks["\n"] + self._at_start(tail)
            elif word[-1:] in self._marks and word[-2:-1].isalpha():
                ids = self[word[:-1]] + self._marks[word[-1]]
            else:
                ids = self._encode(" " + word)
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids

    def _at_start(self, word: str) -> bytes:
        ids = self._first.get(word)
        if ids is None:
            ids = self._encode(word)
            if len(word) <= _LONGEST:
                self._first[word] = ids
        return ids


class ChunkEncoder:
    """Encodes texts as little-endian 32-bit ids, by a function over whole strings.

    The pattern that splits text before merging starts a new piece at every space that is followed by something else than
    a blank. So a text may be cut before each space and its parts encoded alone; likewise a mark that ends a part behind a
    letter, and a line's end between no other blanks. The ids of short parts are remembered, in two generations: when the young one is full it becomes the old one, so
    memory stays bounded and frequent parts stay.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 200_000):
        self._encode, self._most = encode, most
        self._marks = {mark: encode(mark) for mark in _MARKS}
        self._known = _Known(encode, self._marks, None)

    def __call__(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._encode(text)
        if len(self._known) > self._most:
            self._known = _Known(self._encode, self._marks, self._known)
        words = iter(text.split(" "))
        return b"".join(chain((self._encode(next(words)),), map(self._known.__getitem__, words)))
