"""Packing of documents into as few sequences of one size as possible, by minimum bin slack."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from havenlens.llm.common import slices, stored
from havenlens.llm.tokens import encoder

SIZE = 1024


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Of pieces available (length → how many) those that fill the room best: length → how many are taken.

    Subset sums as a bitset: bit s is set if some pieces add up to s. Long pieces come first, so that short ones are left
    to fill what comes later, and it stops once the room can be filled.
    """
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n in available if n <= room), reverse=True):
        many, lot = min(available[length], room // length), 1
        while many:
            lot = min(lot, many)
            steps.append((length, lot, sums))
            sums |= sums << lot * length & mask
            many, lot = many - lot, lot * 2
        if sums >> room:
            break
    left, taken = sums.bit_length() - 1, Counter()
    for length, lot, before in reversed(steps):
        if not before >> left & 1:
            taken[length] += lot
            left -= lot * length
    return dict(taken)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Bins for pieces (length → how many): (length → how many in the bin, how many such bins).

    Every bin holds the longest piece left and the fullest combination for the rest of its room, which are then removed. The
    same search would find the same bin again until one of its lengths runs short, so it is made that often at once. Hence
    the plan has no more than size × (2 + ln size) kinds of bins, however many pieces there are.
    """
    left, bins = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        kind = Counter(fullest(left | {longest: left[longest] - 1}, size - longest))
        kind[longest] += 1
        often = min(left[n] // many for n, many in kind.items())
        bins.append((dict(kind), often))
        for n, many in kind.items():
            left[n] -= many * often
            if not left[n]:
                del left[n]
    return bins


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, task, nth): nth counts the pieces of a length in a task from 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        context, seen = TaskContext.get(), Counter()
        task = context.partitionId() if context else 0
        for batch in slices(batches, "text", 1 << 20):
            of, rows = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = ids_of(text or "") + end
                n = len(ids) // 4
                starts = range(n % size - size if n % size and n > size else 0, n, size)
                for number, start in enumerate(starts):
                    own = ids[4 * max(0, start):4 * (start + size)]
                    length = len(own) // 4
                    of.append(row)
                    rows.append((number, max(0, start), length, own, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, task int, nth bigint")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset), in sequences of at most `size`.

    A document is its token ids and `end_id`; a null or empty text is that id alone. Only a document of more than `size` ids
    is cut: all its pieces have that length but the first, which has the rest. ids are little-endian 32-bit integers.

    All documents are packed together by the numbers of their pieces of each length, at most `size` numbers, which are all
    that the driver sees. It plans bins by minimum bin slack; a length's pieces then take the places of that length in turn,
    by their rank among equals: what the tasks before have of it and the place in the own task. So no piece meets another,
    ids are never shuffled where they aren't asked for, and a frequent length is no hot key. Tokens are made once, in a
    stored table, so a task that is lost does not change ranks. Repeated rows are packed one by one, an empty table gives no
    rows and other columns are ignored.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, end_id, size, id_col, text_col), "pieces")
    counts = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    slots, used, sequence = [], Counter(), 0
    for kind, often in plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size):
        offset = 0
        for length, many in sorted(kind.items(), reverse=True):
            slots.append((length, used[length], used[length] + many * often, many, sequence, offset))
            used[length] += many * often
            offset += many * length
        sequence += often
    places = spark.createDataFrame(slots, "slot_length long, low long, high long, many long, first_sequence long, first_offset long")
    ranked = cut.join(starts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("nth"))
    at = F.col("rank") - F.col("low")
    return ranked.join(
        F.broadcast(places),  # bounded by the plan
        (F.col("length") == F.col("slot_length")) & (F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - low) div many")).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("many") * F.col("length")).alias("offset"))
