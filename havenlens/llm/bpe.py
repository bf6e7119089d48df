"""Byte-level BPE by backtracking from longest matches, and its inverse."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from havenlens.llm.chunks import ChunkEncoder
from havenlens.llm.common import slices

_REMEMBERED_PAIRS = 200_000


class Vocabulary:
    """A file of ranks: one line per token, its bytes in base 64 and its id. Ids are the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        size = max(ranks.values()) + 1
        self.content = [b""] * size
        for token, rank in ranks.items():
            self.content[rank] = token
        self.length = [len(token) for token in self.content]
        self.left, self.right = list(range(size)), list(range(size))  # the two parts a token is merged from; a byte is its own
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * size  # the longest other token that a token starts with
        self.matcher = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = self._parts(token, rank) if len(token) > 1 else ()
            if parts is None:
                continue  # never the result of merges; it only stands for a piece that equals it
            if parts:
                self.left[rank], self.right[rank] = parts
                self.merged[parts] = rank
            self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()
        text_of = {rank: token for _, (_, rank) in self.matcher.items() for token in [self.content[rank]]}
        for rank, token in text_of.items():
            for end in range(len(token) - 1, 0, -1):
                other = ranks.get(token[:end])
                if other is not None and other in text_of:
                    self.shorter[rank] = other
                    break
        self._fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))})

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts when a token's bytes are merged by all earlier ranks; None if they never get there."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.ids.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= rank:
                return None
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens gives these two again. Remembered, as the pairs recur."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= _REMEMBERED_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges from the latest back. If, at some point, the parts at the seam make a token that would have been
        merged before the part just undone, the seam could not have lasted."""
        before = len(self.content)
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < before:
                return False
            # of the two tokens at the seam the later one was made last; a byte was not made
            undo_left = left > right
            for _ in range(2):
                if undo_left and self.right[left] != left:
                    before, left = left, self.right[left]
                    break
                if not undo_left and self.left[right] != right:
                    before, right = right + 1, self.left[right]
                    break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, in time linear in its length: every position is given up once at most."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (length, token) in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - length] = token  # later ends come later, so the longest stays
        length, shorter, fits = self.length, self.shorter, self.fits
        hopeless = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and (hopeless[at + length[token]] or (last >= 0 and not fits(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:  # nothing can follow: take the last token back and try a shorter one
                hopeless[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.content.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One per worker process, so that what it has met stays known from task to task."""
    vocab, pieces = vocabulary(path), regex.compile(pattern).findall

    def ids_of(text: str) -> bytes:
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():  # one piece
            ids = vocab.encode_piece(text.encode())
        else:
            ids = [i for piece in pieces(text) for i in vocab.encode_piece(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    return ChunkEncoder(ids_of)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text, without a shuffle: each match of `pattern` is merged by itself, no special tokens.

    A null text is empty and has no ids. Rows are encoded one by one, repeated ones too; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            found = [ids_of(t or "") for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *[len(ids) // 4 for ids in found]], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `content`, the bytes that the ids stand for. Null ids decode to null."""
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = vocabulary(ranks_path).decode
        for batch in slices(batches, ids_col):
            lists = batch[ids_col]
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = [content(values[start:end].tolist()) for start, end in zip(at, at[1:])]
            none = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary(), mask=none)], [*columns, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, content binary")
