"""A stored vector index: vectors lie by the cell of the centre nearest to them, and a search reads the cells that matter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from havenlens.operators.search import QUERY_ROWS, VECTOR_ROWS, _best_of_block, _ranked
from havenlens.session import scratch_path
from havenlens.sources.versions import whole_versions

#: Centres are learned on about so many vectors, picked by a hash of the id; every vector is put into a cell.
SAMPLE = 65_536
#: An index has about as many cells as the square root of its first load, but no more than this, so that centres stay small.
MOST_CELLS = 4_096
#: Cells that a query reads.
PROBES = 16
#: Rows whose inner products with all centres are held at a time.
ROWS = 1_024
#: What rounding may add to an inner product or an angle.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Unit centres, and for each cell how many vectors it has and the least cosine that one of them has with its centre."""

    centres: np.ndarray
    sizes: np.ndarray
    least: np.ndarray


def _whole(vector: str, length: int | None = None) -> Column:
    """Whether a vector has a direction: no null, NaN or infinite component and not all zero (and a given length)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return known if length is None else known & (F.size(vector) == length)


def _units(vectors: pa.Array) -> np.ndarray:
    data = np.asarray(vectors.flatten(), dtype="float64").reshape(len(vectors), -1)
    data = data / np.abs(data).max(axis=1, keepdims=True)
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def learn_centres(vectors: DataFrame, cells: int | None, id_column: str, vector_column: str) -> np.ndarray:
    """Unit centres of k-means over the directions of about SAMPLE vectors; of few different ones all are centres."""
    n = vectors.count()
    length = F.sqrt(F.aggregate(vector_column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    some = vectors.where(F.pmod(F.xxhash64(id_column), F.lit(max(n, 1))) < SAMPLE).select(vector_column).distinct()
    points = some.select(array_to_vector(F.transform(vector_column, lambda x: x.cast("double") / length)).alias("features"))
    k = max(2, min(MOST_CELLS, cells or round(n ** 0.5)))
    few = points.limit(k + 1).collect()
    found = np.array([r.features.toArray() for r in few] if len(few) <= k else
                     KMeans(k=k, maxIter=10, initMode="random", seed=7).fit(points).clusterCenters())
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    found[norms[:, 0] == 0] = np.eye(1, found.shape[1])  # opposite vectors may average to nothing; any direction will do
    return found / np.where(norms == 0, 1.0, norms)


def append_vectors(vectors: DataFrame, path: str, on: Sequence[str] = (), id_column: str = "vec_id", vector_column: str = "embedding",
                   cells: int | None = None) -> None:
    """Put the vectors whose ids the index at `path` does not hold into its cells; the first call learns the centres.

    `on` names the columns that searches may filter by; all calls name the same. Vectors without a direction or of another
    length than the first ones are left out: no search finds them. A repeated id keeps all its rows of one load. A table
    without any such vector changes nothing. The load's row is written last; what a broken load left is not read.
    """
    spark, load = vectors.sparkSession, uuid.uuid4().hex
    used = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), *on)
    if not whole_versions(spark, path):
        first = used.where(_whole("vector")).select(F.size("vector").alias("n")).head()
        if first is None:
            return
        centres = learn_centres(used.where(_whole("vector", first["n"])), cells, "id", "vector")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/centres")
        empty = spark.createDataFrame([], T.StructType([*used.schema.fields, *_PLACED]))
        empty.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        empty.write.mode("overwrite").parquet(f"{path}/columns")
        spark.createDataFrame([], _SIZES).write.mode("overwrite").parquet(f"{path}/sizes")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/version=1")
    centres = _centres(spark, path)
    held = _stored(spark, path).select("id")
    new = used.where(_whole("vector", centres.shape[1])).join(held, "id", "left_anti")
    placed = _placed(new, centres).withColumn("load", F.lit(load))
    columns = [*(f.name for f in used.schema.fields), "cosine", "load", "cell"]
    placed.select(*columns).hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "id").write.mode("append").partitionBy(
        "cell").parquet(f"{path}/vectors")
    written = _rows(spark, path).where(F.col("load") == load)
    written.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).withColumn("load", F.lit(load)).coalesce(
        1).write.mode("append").parquet(f"{path}/sizes")


_PLACED = [T.StructField("cosine", T.DoubleType()), T.StructField("load", T.StringType()), T.StructField("cell", T.IntegerType())]
_SIZES = "cell int, n bigint, least double, load string"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/vectors")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of loads that ended."""
    ended = spark.read.schema(_SIZES).parquet(f"{path}/sizes").select("load").distinct()
    return _rows(spark, path).join(ended, "load", "left_semi")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    """At most MOST_CELLS rows."""
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])


def _cells(spark: SparkSession, path: str) -> Cells:
    centres = _centres(spark, path)
    sizes, least = np.zeros(len(centres), np.int64), np.ones(len(centres))
    counted = spark.read.schema(_SIZES).parquet(f"{path}/sizes").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    for row in counted.collect():
        sizes[row.cell], least[row.cell] = row.n, row.least
    return Cells(centres, sizes, least)


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the number of the nearest centre and the cosine with it."""
    shape = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    known = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                near = _units(rows["vector"]) @ known.value.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell], pa.float64())],
                    [*rows.schema.names, "cell", "cosine"])

    return vectors.mapInArrow(place, shape)


def _chosen(queries: DataFrame, cells: Cells, k: int, probes: int, further: bool) -> DataFrame:
    """A row per query and cell that it reads: the nearest `probes`, more where these hold fewer than k vectors.

    With `further` the other cells that may hold a vector as near as the `floor` of the query; without a floor all of them.
    A vector of a cell is nowhere nearer to the query than the angle to the centre less the cell's widest angle.
    """
    kept = [f for f in queries.schema.fields if f.name != "floor"]
    shape = T.StructType([*kept, T.StructField("cell", T.IntegerType())])
    sent = queries.sparkSession.sparkContext.broadcast(cells)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        filled = np.flatnonzero(known.sizes)
        widest = np.arccos(np.clip(known.least[filled] - SLACK, -1, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                near = _units(rows["query_vector"]) @ known.centres[filled].T
                order = np.argsort(-near, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(filled))[None, :], axis=1)
                before = np.cumsum(known.sizes[filled][order], axis=1) - known.sizes[filled][order]
                read = np.take_along_axis((np.arange(len(filled)) < probes) | (before < k), place, axis=1)
                if further:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - widest))
                    floor = np.array([-2.0 if f is None else f for f in rows["floor"].to_pylist()])[:, None]
                    read = ~read & (bound >= floor - SLACK)
                row, cell = np.nonzero(read)
                taken = rows.select([f.name for f in kept]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(filled[cell], pa.int32())], [*taken.schema.names, "cell"])

    return queries.mapInArrow(choose, shape)


def _meet(chosen: DataFrame, path: str, cells: Cells, k: int, on: Sequence[str]) -> DataFrame:
    """The k best (query_id, id, score) in every block of a cell's vectors. Only chosen cells are read.

    A cell's vectors and queries are dealt into blocks as in vector_search, so that a cell with a third of all vectors is
    many tasks. What the driver sees is a number of queries per cell, MOST_CELLS at most.
    """
    spark = chosen.sparkSession
    asked = [(r.cell, r.n) for r in chosen.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    layout = F.broadcast(spark.createDataFrame(
        [(cell, -int(-cells.sizes[cell] // VECTOR_ROWS), -(-n // QUERY_ROWS)) for cell, n in asked],
        "cell int, v_blocks int, q_blocks int"))
    vectors = _stored(spark, path).where(F.col("cell").isin([cell for cell, _ in asked])).select("id", "vector", "cell", *on)

    def dealt(rows: DataFrame, column: str, own: str, other: str) -> DataFrame:
        return rows.join(layout, "cell").withColumn(own, F.pmod(F.xxhash64(column), F.col(f"{own}_blocks")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop("v_blocks", "q_blocks")

    types = {f.name: f.dataType.simpleString() for f in (*chosen.schema.fields, *vectors.schema.fields)}
    keys = [*on, "cell", "v", "q"]
    return dealt(vectors, "id", "v", "q").groupBy(*keys).cogroup(dealt(chosen, "query_id", "q", "v").groupBy(*keys)).applyInArrow(
        _best_of_block(k, "id", "vector"), f"query_id {types['query_id']}, id {types['id']}, score double")


def search_vector_index(queries: DataFrame, path: str, k: int = 5, probes: int = PROBES, on: Sequence[str] = (),
                        exact: bool = False) -> DataFrame:
    """(query_id, id, score, rank): cosine top k per row of `queries`, which holds (query_id, query_vector) and the columns in `on`.

    A query reads the `probes` cells nearest to it, and more while these hold fewer than k vectors; scores are exact. With
    `exact` it then reads every other cell that may hold a vector as near as its k-th, so the answer is that of vector_search.
    With filter columns, queries that find fewer than k read all other cells. Queries without a direction find nothing; ties
    go to the smaller id.
    """
    spark = queries.sparkSession
    if not whole_versions(spark, path):
        raise ValueError(f"no vector index at {path}")
    cells = _cells(spark, path)
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"), *on).where(
        _whole("query_vector", cells.centres.shape[1]))
    found = _meet(_chosen(asked, cells, k, probes, False), path, cells, k, on)
    if exact or on:
        kept = scratch_path(spark, "nearest")
        _ranked(found, ["query_id"], "id", k).write.parquet(kept)
        found = spark.read.parquet(kept)
        floors = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        rest = asked.join(floors, "query_id", "left")
        rest = rest if exact else rest.where("floor IS NULL")
        more = _meet(_chosen(rest, cells, k, probes, True), path, cells, k, on)
        found = found.drop("rank").unionByName(more)
    return _ranked(found, ["query_id"], "id", k)


def share_read(queries: DataFrame, path: str, probes: int = PROBES, k: int = 5) -> float:
    """The part of all stored vectors that a query of `queries` (query_id, query_vector) reads without `exact`, on average."""
    cells = _cells(queries.sparkSession, path)
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).where(
        _whole("query_vector", cells.centres.shape[1]))
    read = _chosen(asked, cells, k, probes, False).groupBy("cell").agg(F.count("*").alias("n")).collect()
    return sum(r.n * int(cells.sizes[r.cell]) for r in read) / max(1, asked.count() * int(cells.sizes.sum()))
