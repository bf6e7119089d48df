"""Packing of documents into training sequences of several context sizes."""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from havenlens.llm.common import slices
from havenlens.llm.tokens import encoder

#: Context sizes, each a power of two; and the tokens of one training step, a multiple of the largest.
TIERS = (64, 128, 256, 512, 1024, 2048)
STEP_TOKENS = 16 * 2048
#: Tokens that a task gathers before it packs them.
GATHERED = 2_000_000


#: A piece of a document (by its number): where it starts there and how long it is.
Piece = tuple[int, int, int]


def plan(lengths: dict[int, tuple[int, int]], tiers: tuple[int, ...] = TIERS, last: bool = True
         ) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces for documents (number → first token left, number of tokens left), and what is put off.

    A document fills windows of the largest tier by itself as long as it can; its rest is routed to the smallest tier that
    holds it. Longest rests first, each opens a window of its tier, whose gap takes the longest rests of shorter tiers that
    fit. What then remains of the gap takes the head of the shortest rest, whose tail goes back to its own tier. So every
    window is full. Only the last one of all can run out of rests: it is put off, or, if `last`, cut into powers of two.
    """
    most = tiers[-1]
    sequences: list[list[Piece]] = []
    rests: list[tuple[int, int, int]] = []  # tokens, document, first token
    for doc, (start, n) in lengths.items():
        while n >= most:
            sequences.append([(doc, start, most)])
            start, n = start + most, n - most
        if n:
            rests.append((n, doc, start))
    rests.sort()
    while rests:
        n, doc, start = rests.pop()
        window = next(t for t in tiers if t >= n)
        pieces, gap = [(doc, start, n)], window - n
        while gap and rests:
            fit = bisect_right(rests, (gap, float("inf"), 0)) - 1
            if fit >= 0:
                n, doc, start = rests.pop(fit)
                pieces.append((doc, start, n))
                gap -= n
            else:
                n, doc, start = rests.pop(0)
                pieces.append((doc, start, gap))
                insort(rests, (n - gap, doc, start + gap))
                gap = 0
        if not gap:
            sequences.append(pieces)
        elif not last:
            return sequences, pieces
        else:
            sequences += _powers_of_two(pieces)
    return sequences, []


def _powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in order, cut into sequences whose sizes are the powers of two of their sum, largest first."""
    left, out = sum(n for _, _, n in pieces), []
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left, own = left - room, []
        while room:
            doc, start, n = queue.pop()
            used = min(n, room)
            own.append((doc, start, used))
            room -= used
            if n > used:
                queue.append((doc, start + used, n - used))
        out.append(own)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, gathered: int = GATHERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, window, step_group).

    A document is its token ids and `end_id`; a null or empty text is that id alone. ids holds the piece as little-endian
    32-bit integers. Sequences are full windows of one of the `tiers`; only the last of a task are smaller powers of two.
    Whole sequences, longest first, are dealt into step groups of `step_tokens` tokens; as all sizes are powers of two every
    group comes out at exactly that number, but for the last of a task.

    Every task packs its own rows as they come, holding `gathered` tokens at a time, so nothing is shuffled and no key can
    be hot. Ids of sequences and groups carry the task's number. Run it on a stored table: a lost task is then repeated
    with the same rows. Repeated rows are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        texts: dict[int, tuple] = {}  # number → (doc_id, ids)
        open_: dict[int, tuple[int, int]] = {}
        ready: list[tuple[int, list[tuple]]] = []  # whole sequences that wait for their step group to fill
        n_docs = n_sequences = n_tokens = dealt = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences, dealt, open_, n_tokens, ready
            sequences, put_off = plan(open_, tiers, last)
            for sequence in sequences:
                pieces = [(texts[doc][0], start, n, texts[doc][1][4 * start:4 * (start + n)], len(texts[doc][1]) // 4)
                          for doc, start, n in sequence]
                ready.append((sum(p[2] for p in pieces), pieces))
            ready.sort(key=lambda s: -s[0])
            total = sum(size for size, _ in ready)
            room, used, rows = total if last else total - total % step_tokens, 0, []
            while room:
                size, pieces = ready[used]
                offset = 0
                for key, start, n, ids, doc_tokens in pieces:
                    rows.append((key, start, n, ids, doc_tokens, base + n_sequences, offset, size, base + dealt // step_tokens))
                    offset += n
                room, used, dealt, n_sequences = room - size, used + 1, dealt + size, n_sequences + 1
            ready = ready[used:]
            open_ = {doc: (start, n) for doc, start, n in put_off}  # each the whole rest of its document
            n_tokens = sum(n for _, n in open_.values())
            for doc in texts.keys() - open_.keys():
                del texts[doc]
            for at in range(0, len(rows), 5000):
                columns = list(zip(*rows[at:at + 5000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kind), *[pa.array(columns[i], pa.int64()) for i in (1, 2)],
                     pa.array(columns[3], pa.binary()), *[pa.array(columns[i], pa.int64()) for i in (4, 5, 6)],
                     pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())], names)

        kind = pa.int64()
        for batch in slices(batches, "text"):
            kind = batch["doc_id"].type
            found = [ids_of(t or "") for t in batch["text"].to_pylist()]
            for key, ids in zip(batch["doc_id"].to_pylist(), found):
                texts[n_docs] = (key, ids + end)
                open_[n_docs] = (0, len(ids) // 4 + 1)
                n_tokens += len(ids) // 4 + 1
                n_docs += 1
            if n_tokens >= gathered:
                yield from flush(last=False)
        yield from flush(last=True)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, "
             "sequence_id bigint, offset bigint, window int, step_group bigint")
