"""Removal of repeated lines, seen through windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from havenlens.llm import spans
from havenlens.llm.common import stored

WINDOW = 3


def line_windows(text: bytes, size: int = WINDOW) -> Iterator[spans.Unit]:
    """Every run of `size` consecutive lines, blank ones left out; A-Z compare as a-z and blanks as one space."""
    lines, start = [], 0
    for line in text.split(b"\n"):
        words = line.lower().split()
        if words:
            lines.append((start, start + len(line) + 1, len(words), b" ".join(words)))
        start += len(line) + 1
    for i in range(len(lines) - size + 1):
        window = lines[i:i + size]
        yield (window[0][0], min(window[-1][1], len(text)), sum(line[2] for line in window),
               spans.digest(b"\n".join(line[3] for line in window)))


def without_repeated_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, spans, origins): the rows, their text without repeated runs of lines, what was removed.

    Windows of `size` lines overlap. A window that also occurs before (in a smaller doc_id, or further up) is a later
    occurrence, and the lines of all of these go, overlapping ones merged. A removed line always has an equal line before
    it that stays, so nothing is lost. Texts of fewer lines, empty and null ones stay as they are. Rows equal in id and
    text rank as one document and lose the same lines; null ids rank last. Other columns are carried along in `row`.
    """
    windows = stored(spans.units(docs, lambda text: line_windows(text, size), id_col, text_col), "windows")
    return spans.without(docs, spans.later_occurrences(windows), lambda hits, _: hits, id_col, text_col)


def deduplicate(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the input's columns and the text cut; rows of which no word is left are gone."""
    return spans.same_rows(docs, without_repeated_lines(docs, size, id_col, text_col), text_col)
