"""What the corpus operators share: reading, stored steps, rows that keep clashing columns apart, hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens.session import scratch_path
from havenlens.sources.versions import drop

#: Where steps lie, for as long as somebody holds them.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers some megabytes at a time, unless the session has been told how many rows or bytes.

    Spark's own 10,000 rows or 64 MB of whole texts would be held several times over on either side of every task.
    """
    for key, usual, ours in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: what follows sees one version, and lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[step] = path
    return step


def done_with(*steps: DataFrame) -> None:
    """Remove stored steps that nothing will read again: all that came of them is stored itself."""
    for step in steps:
        folder = _FOLDERS.pop(step, None)
        if folder:
            drop(step.sparkSession, folder)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, even where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_row(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, text, row_key): all columns of the input in one struct, so that no name can clash with ours.

    row_key tells rows apart that share a doc_id; rows equal in doc_id and text share it and meet one fate.
    """
    return docs.select(
        F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"),
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
        F.xxhash64(F.lit("row"), docs[id_col], docs[text_col]).alias("row_key"))


def row_columns(columns: list[str], text_col: str, text: Column) -> list[Column]:
    """The input's columns again, with another text."""
    return [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text, so that what a task makes of a batch stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(most_bytes * batch.num_rows / max(1, batch.column(text_col).nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    pa.default_memory_pool().release_unused()  # a worker lives on after the task; what it freed should not stay with it


def join_keys(rows: DataFrame, keys: DataFrame, key: str, count: str, shares: int = 1000) -> DataFrame:
    """Inner join of rows with one row per key, whatever share of the rows one key holds.

    `count` is the number of rows of each key. Keys with more than 1/shares of all counted rows are fewer than `shares`,
    so their side has a proven bound and is broadcast; every other key is small enough for one task.
    """
    share = keys.agg(F.sum(count) / shares).scalar()
    hot, cold = keys.where(F.col(count) > share), keys.where(F.col(count) <= share)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cold, key))
