from __future__ import annotations

import math

import numpy as np
import pytest

from havenlens.llm import ann


def brute(rows, is_query, k):
    vectors = {}
    for i, v in rows:
        ok = i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            vectors[i] = min(v, vectors.get(i, v))
    out = {}
    for q in vectors:
        if is_query(q):
            own = np.array(vectors[q], np.float32).astype(float)
            scored = [(-float((np.array(v, np.float32).astype(float) * own).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(own)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def edge_vectors():
    chance = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in chance.normal(size=6)]) for i in range(40)]
    twin = [float(np.float32(x)) for x in (1, 2, 3, 4, 5, 6)]
    rows += [(100 + i, twin) for i in range(60)] + [(200, [0.0] * 6), (201, None), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [math.nan] * 6),
             (204, [math.inf] * 6), (None, twin), (205, []), (206, [1.0, 2.0, 3.0]), (207, [3.0, 2.0, 1.0]), (39, rows[39][1]),
             (208, [1e-30] * 6), (209, [1e18] * 6)]
    return rows


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
def test_all_cells_looked_at_gives_the_exact_answer(spark, blocks):
    df = spark.createDataFrame([(i, v, "x") for i, v in edge_vectors()], "vec_id long, embedding array<float>, key string").repartition(3)
    got = result(ann.search(df, "vec_id % 5 = 0", k=20, tables=2, probes=16, cell_vectors=blocks[0], cell_queries=blocks[1]))
    want = {q: hits for q, hits in brute(edge_vectors(), lambda q: q % 5 == 0, 20).items() if hits}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-30)


def test_no_vectors_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, "vec_id % 5 = 0").count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.search(one, "vec_id % 5 = 0").count() == 0


def test_rotations_keep_lengths_and_products():
    x = np.random.default_rng(1).normal(size=(20, 48))
    turned = ann.rotate(x, (1, 2))
    assert turned.shape == (20, 64) and np.allclose(turned @ turned.T, x @ x.T)
    matrix = np.array([[1]])
    for _ in range(3):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    assert np.allclose(ann.hadamard(np.eye(8)), matrix / np.sqrt(8))


@pytest.mark.parametrize("axes", [1, 2])
def test_probes_go_by_distance_from_the_own_cell(axes):
    x = np.random.default_rng(2).normal(size=(30, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = ann.best_cells(x, 0, axes, 12)
    values = [np.concatenate([t, -t], axis=1) for t in (ann.rotate(x, (ann.SEED, 0, a)) for a in range(axes))]
    for row, own in enumerate(cells):
        score = [sum(values[a][row][c // 16 ** (axes - 1 - a) % 16] for a in range(axes)) for c in own]
        assert len(set(own)) == 12 and np.all(np.diff(score) <= 1e-12)
        every = sorted((sum(values[a][row][c // 16 ** (axes - 1 - a) % 16] for a in range(axes)) for c in range(16 ** axes)), reverse=True)
        assert np.allclose(score, every[:12])


def test_recall_of_the_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.1"
    got = result(entry.queries()["op10_cross_polytope"](spark, folder))
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(hits) == 20 for hits in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("n", [150, 250, 500, 501])
def test_recall_of_fewer_vectors(spark, n):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(f"vec_id < {n}").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got, want = result(ann.search(df, "vec_id % 5 = 0", k=20)), brute(rows, lambda q: q % 5 == 0, 20)
    assert got.keys() == want.keys() and all(len(hits) == 20 for hits in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want), hit / 20 / len(want)


def exactly(spark, rows, is_query, where, k=20):
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)
    got, want = result(ann.search(df, where, k=k)), brute(rows, is_query, k)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
    return got


@pytest.mark.parametrize("n", [2, 10, 60])
def test_few_vectors_all_meet(spark, n):
    chance = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in chance.normal(size=64)]) for i in range(n)]
    got = exactly(spark, rows, lambda q: True, "true")
    assert all(len(hits) == min(20, n - 1) for hits in got.values())


def test_queries_that_face_away_from_all_others_get_whole_lists(spark):
    chance = np.random.default_rng(5)
    middle = chance.normal(size=64)
    rows = [(100 + i, middle + chance.normal(0, 0.01, 64)) for i in range(2000)] + [(i, -middle + chance.normal(0, 0.01, 64)) for i in range(15)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = exactly(spark, rows, lambda q: q < 15, "vec_id < 15")
    assert len(got) == 15 and all(len(hits) == 20 for hits in got.values())
