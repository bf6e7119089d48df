"""Contiguous shards of nearly equal bytes, from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from havenlens.llm.common import stored


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), shards contiguous in doc_id and of nearly equal bytes.

    Rows are ranged by doc_id and stored once with their partition. Each partition's total of bytes and rows gives, by a
    prefix sum over partitions, where it starts in the whole; inside a partition a running sum does the rest. A row whose
    middle byte lies in the k-th of `n_shards` equal parts of all bytes belongs to shard k, so a shard is off its target
    by at most half a row at either end. Only (id, size, crc) are shuffled, never a text.

    A null text has size 1 and crc 0; an empty text too. Null ids come first. Repeated ids are kept apart by their crc
    and place, and a third of all rows under one id still range over many partitions. An empty table gives no rows;
    other columns are ignored. With fewer rows than shards, or one text beyond a shard's share, some shards stay empty.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 1
    narrow = docs.select(
        docs[id_col].alias("doc_id"), size.alias("size"),
        F.coalesce(F.crc32(docs[text_col].cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    order = ("doc_id", "text_crc32", "place")
    ranged = stored(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shards")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before, everything = Window.orderBy("part"), Window.partitionBy()  # as many rows as partitions
    starts = totals.select(
        "part", (F.sum("bytes").over(before) - F.col("bytes")).alias("bytes_before"),
        (F.sum("rows").over(before) - F.col("rows")).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                            "nth": F.row_number().over(inside)})
        .join(F.broadcast(starts), "part")
        .select("doc_id", "size", "text_crc32",
                (F.col("rows_before") + F.col("nth") - 1).alias("index"),
                F.expr(f"least({n_shards - 1}, ((2 * (bytes_before + upto) - size) * {n_shards}) div (2 * all_bytes))")
                .cast("int").alias("shard")))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # at most n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))
