from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.corpus_rows import edge_rows
from havenlens.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"))


def test_held_out_accuracy(spark, model):
    import __spark_entry__ as entry

    rows = entry.queries()["op6_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_edge_rows(spark, edge_docs, no_docs, model):
    got = sorted(((r.doc_id, r.lang_pred, r.score > 0) for r in langid.identify(edge_docs, model).collect()), key=repr)
    rows = edge_rows()
    assert len(got) == len(rows)
    for doc_id in (4, 5, 6, 7):
        assert [g[1:] for g in got if g[0] == doc_id] == [("und", False)]
    assert all(g[1] != "und" for g in got if g[0] in (1, 8, 9, 13, 15))
    kept = langid.keep_known(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _ in rows)
    assert langid.identify(no_docs, model).count() == 0


def test_label_and_source_are_no_inputs(spark, model):
    docs = spark.createDataFrame([(1, "und der die das ist ein", "fr"), (1, "und der die das ist ein", None)], "doc_id long, text string, lang string")
    a, b = langid.identify(docs, model).collect()
    assert a == b


def test_nothing_to_learn_from(spark, edge_docs, no_docs):
    for docs in (no_docs, edge_docs.where("lang IS NULL")):
        model = langid.fit(docs, F.lit(True))
        assert {(r.lang_pred, r.score) for r in langid.identify(edge_docs, model).collect()} == {("und", 0.0)}


def test_the_sample_is_bounded_and_one_language_is_enough(spark, edge_docs):
    seen = []
    fit_rows = langid.fit_rows
    try:
        langid.fit_rows = lambda x, langs: seen.append(list(langs)) or fit_rows(x, langs)
        model = langid.fit(edge_docs, F.lit(True), per_language=3)
        one = langid.fit(edge_docs.where("lang = 'fr'"), F.lit(True))
    finally:
        langid.fit_rows = fit_rows
    assert max(seen[0].count(lang) for lang in set(seen[0])) <= 3 and set(seen[0]) == {"en", "fr", "de", "es"}
    assert model.languages == {"germanic": ("de", "en"), "romance": ("es", "fr")}
    assert {(r.lang_pred, r.score) for r in langid.identify(edge_docs, one).collect()} == {("fr", 1.0), ("und", 0.0)}


def test_machines_separate_and_an_unlisted_language_is_its_own_family():
    chance = np.random.default_rng(0)
    x = np.abs(chance.normal(0, 0.02, (90, langid.BUCKETS))).astype(np.float32)
    langs = ["en", "de", "qq"] * 30
    for i, lang in enumerate(langs):
        x[i, {"en": 1, "de": 2, "qq": 3}[lang]] = 1
    model = langid.fit_rows(x, langs)
    assert model.families == ("germanic", "own:qq") and model.predict(x)[0] == langs


def plain_features(text: str | None) -> dict[int, float]:
    """Hashed trigrams around a letter's byte, counted one by one."""
    data = [32, *(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()), 32]
    counts: dict[int, int] = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 32:
            bucket = (((a << 16) | (b << 8) | c) * 2654435761 % 2 ** 32) >> 20
            counts[bucket] = counts.get(bucket, 0) + 1
    return {bucket: (n / sum(counts.values())) ** 0.5 for bucket, n in counts.items()}


def solved(x: np.ndarray, positive: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """The same machine by another way: the rows inside the margin are guessed, their linear system solved, until they stay."""
    y = np.where(positive, 1.0, -1.0)
    share = cost * len(x) / (2 * np.where(positive, positive.sum(), (~positive).sum()))
    inside, weights = np.ones(len(x), bool), np.zeros(x.shape[1])
    for _ in range(100):
        some = x[inside]
        weights = some.T @ np.linalg.solve(some @ some.T + np.diag(1 / (2 * share[inside])), y[inside])
        now = y * (x @ weights) < 1
        if (now == inside).all():
            return weights
        inside = now
    raise AssertionError("the rows inside the margin do not settle")


def test_the_query_equals_a_plain_version(spark):
    """Own features, an independent solver and a plain vote, on every document of the smallest tables."""
    import zlib
    from itertools import combinations

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, folder).collect()}

    def row(text):
        x = np.zeros(langid.BUCKETS + 1)
        x[-1] = 1
        for bucket, value in plain_features(text).items():
            x[bucket] = value
        return x

    learned = [d for d in docs if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and any(map(str.isalpha, d.text or ""))]
    x, langs = np.array([row(d.text) for d in learned]), np.array([d.lang for d in learned])
    assert max(np.unique(langs, return_counts=True)[1]) <= langid.SAMPLE_PER_LANGUAGE
    families = {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(langs) == {"de", "en", "es", "fr"}
    member = {f: solved(x, np.isin(langs, of)) for f, of in families.items()}
    duel = {(a, b): solved(x[(langs == a) | (langs == b)], langs[(langs == a) | (langs == b)] == a)
            for of in families.values() for a, b in combinations(of, 2)}
    sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
    assert set(got) == {d.doc_id for d in docs} and len(got) == len(docs)
    clear = 0
    for d in docs:
        told = got[d.doc_id]
        if not any(map(str.isalpha, d.text or "")):
            assert (told.lang_pred, told.score) == ("und", 0.0)
            continue
        of_family = {f: float(row(d.text) @ w) for f, w in member.items()}
        family = max(of_family, key=of_family.get)
        a, b = families[family]
        margin = float(row(d.text) @ duel[a, b])
        assert told.score == pytest.approx(sure(of_family[family]) * sure(abs(margin)), abs=0.02)
        if abs(margin) > 0.01 and abs(of_family["germanic"] - of_family["romance"]) > 0.01:
            clear += 1
            assert told.lang_pred == (a if margin >= 0 else b)
    assert clear > 0.95 * len(docs)


def test_the_sample_has_the_smallest_hashes_of_each_language(spark):
    import struct

    import xxhash

    rows = [(i, f"word{chr(97 + i % 26)} number {chr(97 + i // 26)}", "en" if i % 3 else "fr") for i in range(300)]
    seen = []
    fit_rows = langid.fit_rows
    try:
        langid.fit_rows = lambda x, langs: seen.append((x, list(langs))) or fit_rows(x, langs)
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), F.lit(True), per_language=20)
    finally:
        langid.fit_rows = fit_rows
    key = lambda r: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)))[0]
    want = sorted((lang, langid.features(text.encode()).tobytes()) for one in ("en", "fr")
                  for _, text, lang in sorted((r for r in rows if r[2] == one), key=key)[:20])
    assert [(lang, x.tobytes()) for x, lang in zip(*seen[0])] == want
