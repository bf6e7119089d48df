"""Tables in buckets by a key: joins and groupings by it exchange nothing, and a lookup reads the key's bucket alone."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a stored layout says of each of its tables.
LAYOUT = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "path", "key", "columns")] + [T.StructField("buckets", T.IntegerType())])


def _table_name(path: str) -> str:
    return "keyed_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def write_keyed(df: DataFrame, path: str, key: str, buckets: int, spread: int = 1, distinct: Iterable[str] = ()) -> DataFrame:
    """Write df below a new path in `buckets` buckets by `key`, sorted by it in each file, and return the stored table.

    The rows are brought to their buckets before they are written, so that a bucket has `spread` files at most: one for a
    table with a row per key, several for facts, so that no task writes all rows of a frequent key. A spread of 0 leaves rows
    where they are: for rows that were read from the files of a table with the same buckets, of which a task holds a few.
    Columns named `distinct` have a value of their own in most rows, so no dictionary is tried on them.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # Spark's own bucket number
    dealt = (df if spread == 0 else df.repartition(buckets, key) if spread == 1 else
             df.repartition(buckets * spread, bucket, F.pmod(F.xxhash64(*df.columns), F.lit(spread))))
    plain = {f"parquet.enable.dictionary#{name}": "false" for name in distinct}
    dealt.write.bucketBy(buckets, key).sortBy(key).options(**plain).option("path", path).format("parquet").saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


def open_keyed(spark: SparkSession, path: str, key: str, buckets: int, columns: str) -> DataFrame:
    """The table that another session wrote: its buckets are made known to this one, no data is read."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_name(path)} ({columns}) USING parquet "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_table_name(path))


def write_layout(spark: SparkSession, tables: Mapping[str, DataFrame], paths: Mapping[str, str], key: str, buckets: int, path: str) -> None:
    """Write what open_layout needs. A run whose layout is not there has not ended."""
    rows = [(name, paths[name], key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), buckets)
            for name, df in tables.items()]
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.parquet(path)


def open_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a layout, a handful of rows."""
    return {r["name"]: open_keyed(spark, r["path"], r["key"], r["buckets"], r["columns"])
            for r in spark.read.schema(LAYOUT).parquet(path).collect()}
