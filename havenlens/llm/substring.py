"""Removal of passages that occur before, by hashes of normalised lines, paragraphs or parts of lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens.llm import spans
from havenlens.llm.common import slices, stored, texts, with_row

#: A part of a line ends behind a word of which 7 × first byte + 13 × last byte + 5 × bytes, modulo 16, is below this.
CUT_CLASSES = 3
#: The fewest words in a run of repeated units that is removed.
LEAST_WORDS = 25
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Units:
    """The units of a text: `words` and `ends`, how many words and bytes there are up to the end of each, and their contents.

    A unit ends with the blanks behind its last word; what stands before the first word belongs to the first one. A "line"
    ends where these blanks hold a line's end, a "paragraph" where they hold two, and a "part" where a line ends or a word of
    the fixed class stands. So where parts end is told by the words themselves, and a passage is cut alike wherever it
    stands, but for its first and last part. A-Z count as a-z.
    """

    def __init__(self, text: bytes, kind: str = "part"):
        self._low = text.lower()
        a = np.frombuffer(self._low, np.uint8)
        self._blank = _BLANK[a]
        edges = np.flatnonzero(np.diff(self._blank, prepend=True, append=True))
        self._starts, self._stops = edges[::2], edges[1::2]
        self._spaces = a == 0x20
        if not len(edges):
            self.words = self.ends = edges
            return
        behind = np.append(self._starts[1:], len(a))
        breaks = np.append(0, np.cumsum(a == 0x0A))
        breaks = breaks[behind] - breaks[self._stops]
        if kind == "part":
            first, last = a[self._starts].astype(np.int64), a[self._stops - 1].astype(np.int64)
            ends = (breaks > 0) | ((7 * first + 13 * last + 5 * (self._stops - self._starts)) % 16 < CUT_CLASSES)
        else:
            ends = breaks >= (2 if kind == "paragraph" else 1)
        ends[-1] = True
        at = np.flatnonzero(ends)
        self.words, self.ends = at + 1, behind[at]

    def contents(self) -> Iterator[bytes]:
        """The words of each unit, with single spaces between them."""
        if not len(self.words):
            return
        from_word = np.append(0, self.words[:-1])
        first, last = self._starts[from_word], self._stops[self.words - 1]
        blanks, spaces = (np.append(0, np.cumsum(x)) for x in (self._blank, self._spaces))
        between = self.words - from_word - 1
        plain = (blanks[last] - blanks[first] == between) & (spaces[last] - spaces[first] == between)
        for a, b, as_is in zip(first.tolist(), last.tolist(), plain.tolist()):
            yield self._low[a:b] if as_is else b" ".join(self._low[a:b].split())


def digests(docs: DataFrame, kind: str = "part", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, digests): the 64-bit digests of the units of each text, in order. Null texts have none."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, sizes = [], [0]
            for text in texts(batch["text"]):
                found += map(xxhash.xxh3_64_intdigest, Units(text, kind).contents())
                sizes.append(len(found))
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_key"], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)],
                ["doc_id", "row_key", "digests"])

    rows = with_row(docs, text_col, id_col).select("doc_id", "row_key", "text")
    return rows.mapInArrow(make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row_key bigint, digests array<bigint>")


def long_runs(hits: list[dict], text: bytes, kind: str, least_words: int) -> list[dict]:
    """(first, last, origin) of the units in runs of neighbours that have that many words together."""
    units = Units(text, kind)
    ends, offsets = units.words.tolist(), units.ends.tolist()
    starts, begins = [0, *ends], [0, *offsets]
    chosen: list[dict] = []
    run: list[dict] = []
    for hit in [*hits, None]:
        if run and (hit is None or hit["place"] > run[-1]["place"] + 1):
            if ends[run[-1]["place"]] - starts[run[0]["place"]] >= least_words:
                chosen += [{"first": begins[h["place"]], "last": offsets[h["place"]], "origin": h["origin"]} for h in run]
            run = []
        run.append(hit)
    return chosen


def without_repeated_passages(docs: DataFrame, kind: str = "part", least_words: int = LEAST_WORDS,
                              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, spans, origins): the rows, their text without passages that occur before, what was removed.

    Units are lines, paragraphs or, by default, parts of lines whose ends the words themselves tell. They are normalised
    and their digests grouped over all documents; the earliest occurrence by (doc_id, place) stays. Neighbouring later
    occurrences form a run, and a run of at least `least_words` words goes, so stock phrases stay. Of a passage inside other
    words its first and last part are not seen, some five words each. spans are byte offsets into the original text. Empty
    and null texts stay as they are; rows equal in id and text rank as one document and lose the same; null ids rank last.
    Two units of equal digest are taken as equal; that two different ones meet in 64 bits and their neighbours repeat too, so
    that they make a run, is not to be expected even among 10**12 units.
    """
    listed = stored(digests(docs, kind, id_col, text_col), "units")
    found = listed.select("doc_id", "row_key", F.posexplode("digests").alias("place", "digest"))
    return spans.without(docs, spans.later_occurrences(found), partial(long_runs, kind=kind, least_words=least_words), id_col, text_col)


def deduplicate(docs: DataFrame, kind: str = "part", least_words: int = LEAST_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows with the input's columns and the text cut; rows of which no word is left are gone."""
    return spans.same_rows(docs, without_repeated_passages(docs, kind, least_words, id_col, text_col), text_col)
