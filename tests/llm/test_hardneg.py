"""Hard negatives against all pairs in memory."""
from __future__ import annotations

import math
import random

import numpy as np
import pytest

from havenlens.llm import hardneg

KIND = "vec_id long, label int, embedding array<float>, v string, size string, least string, rank string"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, components as whole numbers), ids once."""
    out = set()
    for anchor, label, q in rows:
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), i, lab) for i, lab, v in rows if i != anchor and len(v) == len(q)]
        for ps, pos, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            window = sorted(s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)
            out |= {(anchor, pos, nth, i, -ps, -s) for nth, (s, i, _) in enumerate(window[:negatives], 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, *["other"] * 4) for r in rows], KIND).repartition(3)
    got = hardneg.mine(hardneg.scaled(df), "vec_id % 100 = 0", **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def whole(rows):
    return [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]


def test_dense_vectors_labels_of_all_sizes_and_copies(spark):
    chance = np.random.default_rng(3)
    x = chance.normal(size=(900, 24))
    x[::3] = x[0] + chance.normal(scale=0.05, size=x[::3].shape) * (chance.random((300, 1)) < 0.5)  # a third are nearly or quite one vector
    x[200] = -x[0]  # an anchor that faces away from it
    labels = chance.choice([0, 0, 0, 1, 2, 3], 900)
    labels[500], labels[7] = 8, 9  # an anchor alone under its label
    labels[600], labels[601], labels[602] = 5, 5, 5  # fewer positives than asked for
    rows = [(i, int(labels[i]), (x[i] / 4).tolist()) for i in range(900)]
    want = brute(whole(rows))
    assert mined(spark, rows) == want == mined(spark, rows, block=70, anchors=2)
    assert {r[0] for r in want} >= {0, 600} and 500 not in {r[0] for r in want}


def test_sparse_vectors_other_lengths_and_long_components(spark):
    chance = random.Random(4)
    rows = [(i, chance.randrange(3), [chance.choice([0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 1.0, -0.25, 2.0]) for _ in range(40)]) for i in range(300)]
    rows += [(i, chance.randrange(2), [chance.random() * 1e6 - 4e5 for _ in range(3)]) for i in range(300, 420)]
    rows += [(1000, 0, []), (1001, 0, []), (1002, 1, []), (1100, 1, [0.0] * 40)]
    assert mined(spark, rows) == brute(whole(rows))


def test_rows_that_take_no_part(spark):
    good = [(i, i % 2, [1.0 + i / 64, 0.5, -i / 32]) for i in range(0, 40)]
    bad = [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0, 1.0, 1.0]), (300, 1, None), (301, 1, [1.0, None, 1.0]),
           (302, 0, [float("nan"), 1.0, 1.0]), (400, 0, [float("inf"), 1.0, 1.0]), (500, 1, [1e30, 0.0, 0.0])]
    want = brute(whole(good))
    assert want and mined(spark, good + bad) == want
    assert mined(spark, good + good) == want  # repeated rows are one
    assert mined(spark, []) == set() and mined(spark, bad) == set()


@pytest.mark.parametrize("least", [-5.0, 0.0, 3.0, 20.0, 60.0])
def test_the_index_finds_all_above_a_threshold(least):
    chance = np.random.default_rng(5)
    x = np.floor(chance.normal(scale=3, size=(500, 21)) * (chance.random((500, 21)) < 0.4))
    q = np.floor(chance.normal(scale=3, size=21))
    wanted = chance.random(500) < 0.8
    places, scores = hardneg.Index(x, least / np.linalg.norm(q)).search(q, least, wanted)
    assert sorted(places) == sorted(np.flatnonzero(wanted & (x @ q >= least))) and (scores == x[places] @ q).all()
