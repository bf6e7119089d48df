"""Hard negatives by threshold joins: an inverted index with norm bounds, and thresholds that fall until windows are full."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from havenlens.llm.common import stored

#: Vectors of a block, anchors of a block, dimensions whose postings are read together.
BLOCK, ANCHORS, GROUP = 4096, 1024, 8
#: The first threshold as a share of the largest score possible, how it falls, and the share below which all are compared.
START, FALL, LEAST = 0.5, 0.6, 0.04
ALL = -1e308


class Index:
    """Postings of a block of vectors, for anchors whose thresholds are at least `least` times their norms.

    Dimensions are ordered by their energy, the strongest last. The leading dimensions of a vector are left out as long as
    their norm is below `least`: by the Cauchy-Schwarz inequality they alone lift no score to a threshold. The others are
    posted, a few dimensions at a time, with the norm of what stands before.
    """

    def __init__(self, x: np.ndarray, least: float):
        self.order = np.argsort((x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.norms = np.sqrt(np.cumsum(np.pad(self.x.astype(np.float64), ((0, 0), (1, 0))) ** 2, axis=1))
        self.omitted = (self.norms[:, 1:] < least).sum(axis=1)
        self.postings = []
        for first in range((x.shape[1] - 1) // GROUP * GROUP, -1, -GROUP) if x.shape[1] else ():
            part = self.x[:, first:first + GROUP] * (np.arange(first, min(first + GROUP, x.shape[1])) >= self.omitted[:, None])
            rows = np.flatnonzero(part.any(axis=1))
            rest = np.maximum(first, self.omitted)  # the dimensions before this one are not in the partial score
            self.postings.append((first, rows, part[rows], part, rest, self.norms[np.arange(len(x)), rest]))

    def search(self, q: np.ndarray, least: float, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the wanted vectors whose inner product with q is at least `least`.

        Partial scores are added up from the strongest dimensions on. A vector goes as soon as its partial score and the
        norms of what remains on both sides cannot reach the threshold; the scores of those that stay are then completed.
        """
        q = q[self.order]
        norms = np.sqrt(np.cumsum(np.pad(q.astype(np.float64), (1, 0)) ** 2))
        slack = 1e-9 * (norms[-1] * (self.norms[:, -1].max() if len(self.x) else 0.0) + 1)
        partial, places = np.zeros(len(self.x), self.x.dtype), np.flatnonzero(wanted)
        for first, rows, posted, dense, rest, before in self.postings:
            part = q[first:first + GROUP]
            if 2 * len(places) > len(partial):
                partial[rows] += posted @ part
            else:
                partial[places] += dense[places] @ part
            places = places[partial[places] + norms[rest[places]] * before[places] >= least - slack]
            if not len(places):
                break
        scores = self.x[places] @ q
        good = scores >= least
        return places[good], scores[good]


def scaled(vectors: DataFrame, factor: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): vectors with a label, each component x as the whole number floor(factor * x), x as double.

    Rows with a null id, label or vector, a null or non-finite component, or so long that scores could exceed a long take no
    part. Rows with equal ids are one: the smallest label, then the smallest vector.
    """
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    short = F.aggregate("e", F.lit(0.0), lambda a, x: a + (factor * x + 1) * (factor * x + 1)) < 2.0 ** 62
    return (
        vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("e"))
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").where(finite).where(short)
        .select("vec_id", "label", F.transform("e", lambda x: F.floor(factor * x)).alias("v"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v"))


def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from whole (vec_id, label, v), v of longs.

    A score is the inner product with the anchor; higher comes first, ties by the smaller id. An anchor is a row for which
    `is_anchor` (SQL over vec_id) holds, its positives the first other rows of its label. For each positive the first rows
    of other labels come whose score is between `low` and `high` hundredths of the positive's. Fewer rows give all there
    are, so a positive with a score below 0 has none. Vectors of another length are never compared. An empty table gives
    no rows.

    First positives, then negatives are sought above a threshold; for anchors whose windows are not full, it is lowered and
    they ask again. What scores below a threshold comes after all that was found, so a full window is final. Vectors and
    anchors are dealt into blocks, and each pair of blocks is a task, which indexes its vectors and returns no more than a
    window's rows for each window: no label, copy or anchor is a key that could be hot.
    """
    vectors = stored(vectors.withColumn("size", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = vectors.groupBy("size").agg(F.max(norm).alias("longest"))
    labels = vectors.groupBy("size", "label").agg((F.count("*") - 1).alias("others"))
    top = F.col("norm") * F.col("longest")
    asked = stored(
        vectors.where(is_anchor).withColumn("norm", norm).join(longest, "size").join(labels, ["size", "label"]).where("others > 0")
        .select("size", F.col("vec_id").alias("anchor_id"), "label", "v", top.alias("top"),
                F.least("others", F.lit(positives)).alias("need")), "anchors")

    open_, found = asked.withColumn("least", START * F.col("top")), []
    while True:
        hits = _ask(vectors, open_, "anchor_id bigint, vec_id bigint, score bigint", _positives(positives), block, anchors)
        best = stored(_first(hits, ["anchor_id"], "vec_id", positives), "positives")
        state = best.groupBy("anchor_id").agg(F.count("*").alias("n"))
        state = stored(open_.join(state, "anchor_id", "left").withColumn("full", F.coalesce("n", F.lit(0)) >= F.col("need")).drop("n"), "asked")
        found.append(best.join(state.where("full").select("anchor_id"), "anchor_id", "left_semi"))
        open_ = state.where("NOT full").drop("full").withColumn(
            "least", F.when(F.col("least") * FALL > LEAST * F.col("top"), F.col("least") * FALL).otherwise(ALL))
        if open_.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, found)

    bounds = pairs.where("score >= 0").select("anchor_id", F.struct(
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high")).alias("window"))
    windows = bounds.groupBy("anchor_id").agg(F.collect_list("window").alias("windows"))  # no more than `positives`
    lowest = F.array_min(F.transform("windows", lambda w: w["low"])).cast("double")
    highest = F.array_min(F.transform("windows", lambda w: w["high"])).cast("double")
    open_ = stored(asked.join(windows, "anchor_id").select(
        "size", "anchor_id", "label", "v", "windows", F.greatest(lowest, 0.8 * highest).alias("least")), "windows")
    found = []
    while True:
        hits = _ask(vectors, open_, "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint",
                    _negatives(negatives), block, anchors)
        best = stored(_first(hits, ["anchor_id", "positive_id"], "vec_id", negatives), "negatives")
        counts = best.groupBy("anchor_id", "positive_id").agg(F.count("*").alias("n"))
        one = open_.select("anchor_id", "least", F.explode("windows").alias("window"))
        state = one.join(counts, (one["anchor_id"] == counts["anchor_id"]) & (one["window.positive_id"] == counts["positive_id"]), "left").select(
            one["anchor_id"], "window", ((F.coalesce("n", F.lit(0)) >= negatives) | (F.col("least") <= F.col("window.low"))).alias("full"))
        state = stored(state, "filled")
        full = state.where("full").select("anchor_id", "window.positive_id")
        found.append(best.join(full, ["anchor_id", "positive_id"], "left_semi"))
        rest = state.where("NOT full").groupBy("anchor_id").agg(F.collect_list("window").alias("windows"))
        open_ = stored(open_.drop("windows").join(rest, "anchor_id").withColumn("least", F.greatest(lowest, FALL * F.col("least"))), "windows")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))


def _first(hits: DataFrame, of: list[str], id_col: str, k: int) -> DataFrame:
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), id_col))).where(F.col("nth") <= k)


def _ask(vectors: DataFrame, asked: DataFrame, schema: str, choose: Callable, block: int, anchors: int) -> DataFrame:
    """What `choose` takes of the scores of every pair of a block of vectors and a block of anchors of one length."""
    sizes = stored(
        vectors.groupBy("size").agg(F.ceil(F.count("*") / block).cast("int").alias("v_blocks"))
        .join(asked.groupBy("size").agg(F.ceil(F.count("*") / anchors).cast("int").alias("a_blocks")), "size"), "sizes")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return rows.join(sizes, "size").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop("v_blocks", "a_blocks")

    left = dealt(vectors.withColumnRenamed("v", "x"), "vec_id", "v", "a")
    right = dealt(asked.withColumnRenamed("v", "x"), "anchor_id", "a", "v")

    kinds = pa.schema([(field.split()[0], pa.int64()) for field in schema.split(", ")])

    def compare(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return kinds.empty_table()
        x, q = _matrix(own["x"]), _matrix(asking["x"])
        lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        if (x.astype(np.float64) ** 2).sum(axis=1).max() * lengths.max() ** 2 < 2.0 ** 104:
            x, q = x.astype(np.float64), q.astype(np.float64)  # every sum of products is a whole number below 2**53, so exact
        least = asking["least"].to_numpy()
        index = Index(x, float((least / np.maximum(lengths, 1e-300)).min()))
        ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
        rows = []
        for q_, least_, anchor in zip(q, least, asking.drop_columns(["x"]).to_pylist()):
            rows += choose(index, q_, least_, anchor, ids, labels)
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(c, pa.int64()) for c in columns], kinds)

    return left.groupBy("size", "v", "a").cogroup(right.groupBy("size", "v", "a")).applyInArrow(compare, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1 if len(column.flatten()) else 0)


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    first = np.lexsort((ids, -scores))[:k]
    return [(int(i), int(s)) for i, s in zip(ids[first], scores[first])]


def _positives(k: int) -> Callable:
    def choose(index, q, least, anchor, ids, labels):
        places, scores = index.search(q, least, (labels == anchor["label"]) & (ids != anchor["anchor_id"]))
        return [(anchor["anchor_id"], i, s) for i, s in _ranked(ids[places], scores, k)]

    return choose


def _negatives(k: int) -> Callable:
    def choose(index, q, least, anchor, ids, labels):
        places, scores = index.search(q, least, labels != anchor["label"])
        rows = []
        for window in anchor["windows"]:
            inside = (scores >= window["low"]) & (scores <= window["high"])
            rows += [(anchor["anchor_id"], window["positive_id"], window["positive_score"], i, s)
                     for i, s in _ranked(ids[places[inside]], scores[inside], k)]
        return rows

    return choose
