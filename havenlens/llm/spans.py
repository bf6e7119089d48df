"""Units of text with their offsets, the global search for repeated ones, and the removal of spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens.llm.common import join_keys, row_columns, slices, stored, texts, with_row

#: A unit: where it starts and ends in the UTF-8 bytes of the text, its number of words, what it is compared by.
Unit = tuple[int, int, int, bytes]
UNITS = "doc_id {id}, row_key bigint, place int, first long, last long, words int, digest binary"


def digest(content: bytes) -> bytes:
    return xxhash.xxh3_128_digest(content)


def units(docs: DataFrame, cut: Callable[[bytes], Iterator[Unit]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of every whole text, numbered by place, with its digest. Null texts have none."""
    names = ["doc_id", "row_key", "place", "first", "last", "words", "digest"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, found = [], []
            for row, text in enumerate(texts(batch["text"])):
                own = [(place, *unit) for place, unit in enumerate(cut(text))]
                of += [row] * len(own)
                found += own
            columns = list(zip(*found)) if found else [[]] * 5
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(rows), batch["row_key"].take(rows), pa.array(columns[0], pa.int32()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()),
                 pa.array(columns[4], pa.binary())], names)

    rows = with_row(docs, text_col, id_col).select("doc_id", "row_key", "text")
    return rows.mapInArrow(make, UNITS.format(id=docs.schema[id_col].dataType.simpleString()))


def later_occurrences(found: DataFrame) -> DataFrame:
    """The units whose digest has an occurrence that ranks before: a smaller doc_id (nulls last), row_key or place.

    Digests are counted with map-side combining, so a unit that a third of all documents hold meets as one row per task;
    only digests that repeat are joined back, the frequent ones by broadcast under a proven bound.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last_"), "doc_id", "row_key", "place")
    repeats = stored(
        found.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("earliest")).where("n > 1"), "repeats")
    later = join_keys(found, repeats, "digest", "n").where(rank != F.col("earliest"))
    return later.withColumn("origin", F.col("earliest.doc_id")).drop("n", "earliest", "digest")


def without(docs: DataFrame, hits: DataFrame, choose: Callable[[list[dict], bytes], list[dict]],
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, spans, origins): every row, its text without the chosen spans, and what was taken from where.

    `choose` gets the hits of one text, in order of place, and the text, and returns what goes: first, last and origin of
    each part. spans are byte offsets in the original text, merged and in order; origins the ids that hold the earliest
    occurrences of what went.
    """
    told = [c for c in hits.columns if c not in ("doc_id", "row_key", "place")]
    listed = hits.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct("place", *told))).alias("hits"))
    listed = listed.withColumnsRenamed({"doc_id": "hit_id", "row_key": "hit_key"})
    rows = with_row(docs, text_col, id_col)
    joined = rows.join(
        listed, rows["doc_id"].eqNullSafe(F.col("hit_id")) & (rows["row_key"] == F.col("hit_key")), "left").select(
        "row", "doc_id", "hits")  # the text is in the row, and is shuffled once

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"row {joined.schema['row'].dataType.simpleString()}, doc_id {kind}, text string, "
              f"spans array<struct<first: bigint, last: bigint>>, origins array<{kind}>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row"):
            kept, spans, origins = batch["row"].field(text_col).to_pylist(), [], []
            for row, hits in enumerate(batch["hits"].to_pylist()):
                text = kept[row].encode() if hits else b""
                gone = choose(hits, text) if hits else []
                own = merged([(h["first"], h["last"]) for h in gone])
                spans.append([{"first": a, "last": b} for a, b in own])
                origins.append(sorted({h["origin"] for h in gone} - {None}))
                if own:
                    ends = [0, *[x for span in own for x in span], len(text)]
                    kept[row] = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])).decode()
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array(origins, pa.list_(batch["doc_id"].type))], ["row", "doc_id", "text", "spans", "origins"])

    return joined.mapInArrow(cut, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def same_rows(docs: DataFrame, cut: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns with the text as cut; rows whose text had a word and has none left are gone."""
    word = r"[^\x20\x09-\x0D]"
    emptied = (F.size("spans") > 0) & ~F.col("text").rlike(word)
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*row_columns(docs.columns, text_col, F.col("text")))
