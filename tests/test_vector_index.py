"""The stored vector index against vector_search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from havenlens.operators import search, vector_index

SHAPE = "vec_id long, embedding array<float>, label int"
ASKED = "query_id string, query_vector array<double>, label int"


def table(spark, data, shape=SHAPE):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 4) for i, v in enumerate(data)], shape)


def asked(spark, data):
    return spark.createDataFrame([(f"q{j}", [float(x) for x in v], j % 4) for j, v in enumerate(data)], ASKED)


def hits(found, id_column="id"):
    return {(r.query_id, r["rank"]): (r[id_column], round(r.score, 9)) for r in found.collect()}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Spread vectors with repeated, opposite and unusable ones, in two loads."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 8))
    data[300:340] = data[7]
    data[340:360] = -data[7]
    odd = [(500, [0.0] * 8, 1), (501, None, 1), (502, [float("nan")] * 8, 1), (503, [1.0] * 9, 1), (504, [1.0, None] * 4, 1)]
    df = table(spark, data).unionByName(spark.createDataFrame(odd, SHAPE))
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vector_index.append_vectors(df.where("vec_id % 3 > 0"), path, ["label"], cells=6)
    vector_index.append_vectors(df, path, ["label"])
    vector_index.append_vectors(df, path, ["label"])  # nothing is new
    queries = asked(spark, [*rng.normal(size=(5, 8)), data[7], np.zeros(8)])
    return df.where("vec_id < 500"), queries.withColumn("query_vector", F.when(F.col("query_id") != "none", F.col("query_vector"))), path


@pytest.mark.parametrize("on,probes", [([], 1), (["label"], 2)])
def test_exact_answers_are_those_of_the_whole_comparison(small, on, probes):
    df, queries, path = small
    want = hits(search.vector_search(df, queries, 9, on), "vec_id")
    assert hits(vector_index.search_vector_index(queries, path, 9, probes, on, exact=True)) == want and len(want) == 54


def test_every_vector_with_a_direction_is_held_once(spark, small):
    ids = [r.id for r in vector_index._stored(spark, small[2]).select("id").collect()]
    assert sorted(ids) == list(range(400))


def test_lists_are_full_even_if_cells_are_small(small):
    _, queries, path = small
    counts = {k: {r.query_id: r["count"] for r in vector_index.search_vector_index(queries, path, k, 1).groupBy("query_id").count().collect()}
              for k in (60, 1000)}
    assert set(counts[60].values()) == {60} and set(counts[1000].values()) == {400} and len(counts[60]) == 6
    few = vector_index.search_vector_index(queries, path, 90, 1, ["label"]).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {90}


def test_blocks_of_a_full_cell_give_the_same_answer(small, monkeypatch):
    _, queries, path = small
    whole = hits(vector_index.search_vector_index(queries, path, 9, 2))
    monkeypatch.setattr(vector_index, "VECTOR_ROWS", 7)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 2)
    assert hits(vector_index.search_vector_index(queries, path, 9, 2)) == whole


def test_a_broken_load_is_neither_found_nor_counted(spark, small, tmp_path):
    df, queries, _ = small
    path = str(tmp_path / "index")
    vector_index.append_vectors(df.where("vec_id < 100"), path, cells=4)
    before = hits(vector_index.search_vector_index(queries, path, 5, exact=True))
    left = vector_index._rows(spark, path).withColumn("load", F.lit("broken")).withColumn("id", F.col("id") + 1000)
    left.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    assert hits(vector_index.search_vector_index(queries, path, 5, exact=True)) == before
    vector_index.append_vectors(df, path)  # the load again, now whole
    assert hits(vector_index.search_vector_index(queries, path, 5, exact=True)) == hits(search.vector_search(df, queries, 5), "vec_id")


def test_nothing_to_index_and_nothing_to_ask(spark, small, tmp_path):
    path = str(tmp_path / "index")
    vector_index.append_vectors(small[0].limit(0), path)
    with pytest.raises(ValueError, match="no vector index"):
        vector_index.search_vector_index(small[1], path)
    assert vector_index.search_vector_index(small[1].limit(0), small[2], exact=True).count() == 0
    vector_index.append_vectors(small[0].where("vec_id = 3"), path)
    assert {r.id for r in vector_index.search_vector_index(small[1], path).collect()} == {3}


def test_a_hundred_thousand_vectors_in_groups_are_found_in_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    groups = rng.normal(size=(300, 16))
    member = rng.integers(0, 300, 100_000)
    member[:30_000] = 0  # one group has nearly a third
    data = groups[member] + 0.35 * rng.normal(size=(100_000, 16))
    spread = spark.sparkContext.broadcast(data)

    def rows(batches):
        import pyarrow as pa
        for batch in batches:
            ids = np.asarray(batch["id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(spread.value[ids]))], ["vec_id", "embedding"])

    path = str(tmp_path / "index")
    df = spark.range(100_000, numPartitions=8).mapInArrow(rows, "vec_id long, embedding array<double>")
    vector_index.append_vectors(df, path)
    picked = rng.integers(0, 100_000, 60)
    queries = asked(spark, data[picked] + 0.1 * rng.normal(size=(60, 16))).drop("label")
    want, found = (hits(f, i) for f, i in ((search.vector_search(df, queries, 10), "vec_id"),
                                           (vector_index.search_vector_index(queries, path, 10), "id")))
    shared = {(q, i) for (q, _), (i, _) in want.items()} & {(q, i) for (q, _), (i, _) in found.items()}
    recall, read = len(shared) / len(want), vector_index.share_read(queries, path, k=10)
    print(f"recall {recall:.3f}, share of vectors read {read:.3f}")
    assert len(want) == 600 and recall >= 0.9 and read < 0.2
    one = vector_index.search_vector_index(queries.limit(1), path, 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
