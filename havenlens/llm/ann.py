"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from havenlens.llm.common import join_keys, stored

#: Tables, polytopes per table, and cells that a query looks at in each table.
TABLES, AXES, PROBES = 8, 1, 16
#: Vectors and queries of a cell that one task compares at a time.
CELL_VECTORS, CELL_QUERIES = 8192, 2048
#: A query that meets fewer vectors in its cells than this many times what it asks for, all tables together, meets all.
ENOUGH = 10
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two, in n log n steps; it keeps lengths."""
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudo-rotation: three times random signs and a Hadamard transform. Rows are padded to a power of two."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, n))
    for turn in signs:
        x = hadamard(x * turn)
    return x


def best_cells(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The cells of a table nearest to each unit vector, nearest first; the first one is its own.

    A cell is a signed axis of each of `axes` polytopes. Axes are ranked by their inner product with the rotated vector,
    and cells by the sum over polytopes, so a probe gives up as little as it can.
    """
    cells, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for axis in range(axes):
        turned = rotate(x, (SEED, table, axis))
        near = np.concatenate([turned, -turned], axis=1)
        kept = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        joint = value[:, :, None] + np.take_along_axis(near, kept, 1)[:, None, :]
        code = cells[:, :, None] * near.shape[1] + kept[:, None, :]
        joint, code = joint.reshape(len(x), -1), code.reshape(len(x), -1)
        first = np.argsort(-joint, axis=1, kind="stable")[:, :probes]
        cells, value = np.take_along_axis(code, first, 1), np.take_along_axis(joint, first, 1)
    return cells


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of vectors that take part, one per id: not null, not zero, all components finite."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(finite & F.exists(v, lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def search(vectors: DataFrame, is_query: str, k: int = 20, tables: int = TABLES, axes: int = AXES, probes: int = PROBES,
           id_col: str = "vec_id", vector_col: str = "embedding", cell_vectors: int = CELL_VECTORS,
           cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `is_query` (SQL over vec_id) holds, its k nearest found.

    Nearest by inner product in double precision on the vectors as given, ties to the smaller id, never the query itself.
    Every vector, brought to length one, is in one cell of each table; a query looks into its `probes` nearest cells of
    each table and compares exactly with all it finds there. More `axes` make cells smaller: 2n cells for each axis of n
    dimensions, so choose it so that a cell holds some hundred vectors. Vectors of another length are never compared.

    Equal vectors are one: of their ids the k + 1 smallest are kept, which is all that can be among k nearest, and equal
    queries are searched once. A cell with more than `cell_vectors` vectors or `cell_queries` queries is compared in
    blocks, each a task of its own, so that no cell is too large for one. Vectors that are null, zero or hold null or
    non-finite components take no part; of rows with equal ids one vector is kept (the smallest). A query whose cells are
    so empty that it finds fewer than k others, or meets fewer than ENOUGH × k vectors in all tables together, is compared
    with all vectors of its length, in blocks too, so that every query gets k rows or as many as there are candidates.
    """
    rows = stored(usable(vectors, id_col, vector_col).withColumn("is_query", F.coalesce(F.expr(is_query), F.lit(False))), "vectors")
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    ids = few.groupBy("embedding").agg(F.min("vec_id").alias("key"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("embedding").agg(F.min("vec_id").alias("key"), F.count_if("is_query").alias("n")).where("n > 0")
    index = _cells(ids, "ids", tables, axes, 1)
    queries = _cells(asked, "n", tables, axes, probes)

    near = stored(_lists(index, queries, k, cell_vectors, cell_queries), "near")
    length = F.size("embedding").alias("cell")
    full = near.where((F.size("hits") > k) & (F.col("met") >= ENOUGH * k)).select("key")
    short = stored(asked.select(length, "key", "n", "embedding").join(full, "key", "left_anti"), "short")
    every = _lists(ids.select(length, "key", "ids", "embedding"), short, k, cell_vectors, cell_queries)
    lists = near.join(short.select("key"), "key", "left_anti").unionByName(every)
    lists = stored(lists.join(asked.select("key", "n"), "key"), "nearest")
    people = rows.where("is_query").select("vec_id", "embedding").join(
        asked.select("embedding", "key"), "embedding").select(F.col("vec_id").alias("query_id"), "key")
    own = F.slice(F.filter("hits", lambda h: h.getField("vec_id") != F.col("query_id")), 1, k)
    return join_keys(people, lists, "key", "n").select("query_id", F.posexplode(own).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _lists(index: DataFrame, queries: DataFrame, k: int, cell_vectors: int, cell_queries: int) -> DataFrame:
    """(key, hits, met): for each query the k + 1 nearest ids among the vectors of its cells, nearest first.

    met is the number of vectors it was compared with, those of several tables counted in each.
    """
    # blocks of a cell: every block of its vectors meets every block of its queries
    sizes = stored(
        index.groupBy("cell").agg(F.ceil(F.count("*") / cell_vectors).cast("int").alias("v_blocks"))
        .join(queries.groupBy("cell").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("q_blocks")), "cell"), "cells")
    left = index.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("key"), "v_blocks").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
        "key", "ids", "embedding")
    right = queries.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("key"), "q_blocks").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("v"),
        "key", "embedding")
    found = left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInArrow(
        _compare(k), "key bigint, vec_ids array<bigint>, scores array<double>, met bigint")
    found = stored(found, "compared")
    best = found.select("key", F.inline(F.arrays_zip("vec_ids", "scores"))).groupBy("key", F.col("vec_ids").alias("vec_id")).agg(
        F.max("scores").alias("score"))
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    hits = (
        best.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1)
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("hits")))
    return hits.join(found.groupBy("key").agg(F.sum("met").alias("met")), "key")


def _cells(vectors: DataFrame, payload: str, tables: int, axes: int, probes: int) -> DataFrame:
    """(cell, key, payload, embedding): each vector once for each of its nearest cells in each table."""
    kinds = vectors.schema
    names = ["table", "code", "size", "key", payload, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lengths = np.diff(batch["embedding"].offsets.to_numpy())
                for size in np.unique(lengths):
                    part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                    x = matrix(part["embedding"], size)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for table in range(tables):
                        cells = best_cells(x, table, axes, probes)
                        again = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                        rows = part.take(again)
                        n = len(again)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, table, np.int32)), pa.array(cells.ravel()), pa.array(np.full(n, size, np.int32)),
                             rows["key"], rows[payload], rows["embedding"]], names)

    schema = (f"table int, code bigint, size int, key {kinds['key'].dataType.simpleString()}, "
              f"{payload} {kinds[payload].dataType.simpleString()}, embedding {kinds['embedding'].dataType.simpleString()}")
    return vectors.select("key", payload, "embedding").mapInArrow(run, schema).select(
        F.struct("size", "table", "code").alias("cell"), "key", payload, "embedding")


def _compare(k: int):
    """Of the vectors of a block the k + 1 ids nearest to each of its queries, with exact scores."""
    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if vectors.num_rows and queries.num_rows:
            size = len(vectors["embedding"][0])
            x = matrix(vectors["embedding"].combine_chunks(), size)
            ids = vectors["ids"].to_pylist()
            keys = queries["key"].to_pylist()
            q = matrix(queries["embedding"].combine_chunks(), size)
            for start in range(0, len(q), 256):
                block = q[start:start + 256]
                rough = block @ x.T
                for row, scores in enumerate(rough):
                    if len(scores) > k + 1:  # all that reach the score of the last but rounding
                        least = np.partition(scores, -(k + 1))[-(k + 1)]
                        places = np.flatnonzero(scores >= least - 1e-9 * max(1.0, np.abs(scores).max()))
                    else:
                        places = np.arange(len(scores))
                    exact = (x[places] * block[row]).sum(axis=1)
                    hits = sorted((-s, i) for s, place in zip(exact.tolist(), places) for i in ids[place])[:k + 1]
                    out[0].append(keys[start + row])
                    out[1].append([i for _, i in hits])
                    out[2].append([-s for s, _ in hits])
                    out[3].append(len(x))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64())),
                         pa.array(out[3], pa.int64())], ["key", "vec_ids", "scores", "met"])

    return compare
