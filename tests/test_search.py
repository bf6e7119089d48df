from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions

from havenlens.operators import search


def brute_bm25(docs: dict[int, str], query: search.SearchQuery, k: int):
    words = {i: [t for t in re.split(r"[\W_]+", (t or "").lower()) if t] for i, t in docs.items()}
    average = sum(map(len, words.values())) / len(words)
    scores = {}
    for i, tokens in words.items():
        tf = Counter(tokens)
        score = 0.0
        for term, n in query.terms.items():
            df = sum(term in w for w in words.values())
            idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
            score += n * idf * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(tokens) / average))
        if score > 0:
            scores[i] = score
    return sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)
    words = "the the the claim Claim, été pending. port report port-my x1 _y".split()
    docs = {i: rng.choice(["", ".", "  "]) + " ".join(rng.choices(words, k=rng.randint(0, 60))) for i in range(120)}
    docs |= {200: "", 201: "...", 202: "the", 203: None}
    return docs, spark.createDataFrame(list(docs.items()), "doc_id int, text string")


@pytest.mark.parametrize("text", ["the claim", "port my x1", "été", "the the y", "missing"])
def test_keyword_search_equals_brute_force(documents, text):
    docs, df = documents
    query = search.SearchQuery("q", text)
    got = search.keyword_search(df, [query], 10, "doc_id", "text").orderBy("rank").collect()
    want = brute_bm25(docs, query, 10)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_keyword_search_moves_only_candidates(documents):
    _, df = documents
    plan = search.keyword_search(df, [search.SearchQuery("q", "the claim")], 3, "doc_id", "text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and text.count("WindowGroupLimit") >= 2


def test_filters_limit_candidates_but_not_statistics(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a a", "y"), (3, "c", "x")], "doc_id int, text string, kind string")
    queries = [search.SearchQuery("all", "a"), search.SearchQuery("only", "a", {"kind": "x"})]
    got = {(r.query_id, r.doc_id): r.score for r in search.keyword_search(df, queries, 5, "doc_id", "text").collect()}
    assert set(got) == {("all", 1), ("all", 2), ("only", 1)} and got["all", 1] == got["only", 1]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8)).astype("float32")
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(data)] + [(500, [0.0] * 8, 1), (501, None, 1)]
    queries = [(f"q{j}", [float(x) for x in rng.normal(size=8)], j % 4) for j in range(6)]
    return (data, queries, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"),
            spark.createDataFrame(queries, "query_id string, query_vector array<double>, label int"))


@pytest.mark.parametrize("on", [(), ("label",)])
def test_vector_search_equals_brute_force(vectors, on):
    data, queries, df, qdf = vectors
    got = search.vector_search(df, qdf if on else qdf.drop("label"), 5, on).collect()
    for qid, q, label in queries:
        q = np.array(q)
        cos = {i: float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for i, v in enumerate(data.astype("float64"))
               if not on or i % 4 == label}
        want = sorted(cos, key=lambda i: -cos[i])[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("on", [(), ("label",)])
def test_blocks_of_any_size_give_the_same_answer(vectors, on):
    _, _, df, qdf = vectors
    whole = search.vector_search(df, qdf if on else qdf.drop("label"), 7, on).collect()
    split = search.vector_search(df, qdf if on else qdf.drop("label"), 7, on, vector_rows=30, query_rows=2).collect()
    assert {(r.query_id, r.vec_id, r["rank"], round(r.score, 12)) for r in whole} == {
        (r.query_id, r.vec_id, r["rank"], round(r.score, 12)) for r in split}


def test_ten_thousand_query_vectors_are_no_limit(spark, vectors):
    from pyspark.sql import functions as F
    many = spark.range(10_000).select(
        F.concat(F.lit("q"), "id").alias("query_id"),
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + 1)).alias("query_vector"))
    got = search.vector_search(vectors[2], many, 2)
    assert got.count() == 20_000


@pytest.mark.parametrize("k", [5, 2000])
def test_hits_of_a_query_are_limited_in_parts_before_they_meet(spark, k):
    hits = spark.range(5000).selectExpr("concat('q', id % 1) AS query_id", "id AS doc_id", "cast(id % 977 AS double) AS score").repartition(4)
    ranked = search._ranked(hits, ["query_id"], "doc_id", k)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "part#" in plan.split("Exchange hashpartitioning")[2]
    want = sorted(((-(i % 977), i) for i in range(5000)))[:k]
    assert [(r.doc_id, r["rank"]) for r in ranked.orderBy("rank").collect()] == [(i, n + 1) for n, (_, i) in enumerate(want)]


def test_fusion_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, rank int")
    got = search.hybrid_search(a, b).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_cohort_cites_only_its_own_calls(book):
    from pyspark.sql import functions as F
    corpus = search.search_corpus(book.insights)
    cohort = book.nba.where(F.col("customer_id").isin("calls", "none", "hot"))
    got = {r.customer_id: r.citations for r in search.cohort_with_evidence(
        cohort, corpus, search.SearchQuery("q", "cancel or port my policy")).collect()}
    assert got["none"] == "" and got["calls"].startswith("[a90]") and got["hot"].count("[h") == 5
    assert search.refresh_corpus(book.insights, corpus).count() == 0


@pytest.fixture(scope="module")
def index(spark, book, tmp_path_factory):
    """The same corpus indexed at once and in two loads."""
    from havenlens.operators import search_index

    corpus, folder = search.search_corpus(book.insights), tmp_path_factory.mktemp("index")
    search_index.append_index(corpus, f"{folder}/once")
    search_index.append_index(corpus.where("call_date < '2001-09-15'"), f"{folder}/twice")
    search_index.append_index(corpus, f"{folder}/twice")
    search_index.append_index(corpus, f"{folder}/twice")  # nothing is new
    return corpus, str(folder)


QUERIES = [("leave", "cancel or port my policy", None), ("cheap", "cheaper cheaper premium", None), ("none", "zebra", None),
           ("some", "cancel cheaper the", "cancellation_intent")]


def test_index_equals_a_scan_and_two_loads_equal_one(spark, index):
    from havenlens.operators import search_index

    corpus, folder = index
    asked = spark.createDataFrame(QUERIES, "query_id string, text string, primary_intent string")
    scanned = search.keyword_search(corpus, [
        search.SearchQuery(q, text, {"primary_intent": f} if f else {}) for q, text, f in QUERIES], 7)
    want = {(r.query_id, r["rank"]): (r.transcript_id, round(r.score, 9)) for r in scanned.collect()}
    for name in ("once", "twice"):
        found = search_index.search_index(asked, f"{folder}/{name}", 7)
        assert {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in found.collect()} == want and len(want) == 21
        assert found.columns == ["query_id", "id", "rank", "score", "customer_id", "call_date", "primary_intent", "sentiment_label", "summary"]
    n = {name: {t: spark.read.parquet(f"{search_index.folder_of(spark, f'{folder}/{name}')}/{t}").count() for t in ("postings", "docs")} for name in ("once", "twice")}
    assert n["once"] == n["twice"] and n["once"]["docs"] == corpus.count()


def test_a_search_reads_postings_and_no_text(spark, index):
    from havenlens.operators import search_index

    asked = spark.createDataFrame(QUERIES, "query_id string, text string, primary_intent string")
    plan = search_index.search_index(asked, f"{index[1]}/once")._jdf.queryExecution().executedPlan().toString()
    assert "transcript_text" not in plan and "search_text" not in plan
    filters = [line for line in plan.splitlines() if "/postings" in line]
    assert filters and all("PartitionFilters: [term_part" in line for line in filters)


def test_a_load_works_out_its_corpus_once_and_counts_in_rows(spark, tmp_path):
    """Every step of a load made the corpus anew; equal rows still count as one document of all their words."""
    from havenlens.operators import search_index

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    none = [functions.lit(None).cast("string").alias(c) for c in (*search_index.CARRIED, "summary")]
    texts = {1: "b a b", 2: "", 3: "c, b b b", 4: None}
    rows = spark.createDataFrame([*texts.items(), (3, texts[3]), (None, "a"), (None, "a a")], "doc_id int, text string")
    corpus = rows.coalesce(1).mapInArrow(count, rows.schema).select("doc_id", "text", *none)
    path = str(tmp_path / "index")
    search_index.append_index(corpus, path, "doc_id", "text")
    assert read.value == 7
    held = search_index.open_index(spark, path).postings.select("id", "term", "tf", "doc_len").collect()
    assert sorted(map(tuple, held), key=str) == sorted(
        [(1, "a", 1, 3), (1, "b", 2, 3), (3, "b", 6, 4), (3, "c", 2, 4), (None, "a", 1, 1), (None, "a", 2, 2)], key=str)


def test_index_search_per_customer_among_members(spark, index, book):
    from havenlens.operators import search_index

    asked = spark.createDataFrame(QUERIES[:1], "query_id string, text string, primary_intent string")
    members = spark.createDataFrame([("calls",), ("hot",)], "customer_id string")
    got = search_index.search_index(asked, f"{index[1]}/once", 3, "customer_id", members).collect()
    want = search.keyword_search(index[0], [search.SearchQuery("leave", QUERIES[0][1])], 3, per="customer_id", members=members).collect()
    assert {(r.customer_id, r["rank"], r.id) for r in got} == {(r.customer_id, r["rank"], r.transcript_id) for r in want}


def test_a_broken_load_is_not_read(spark, index, tmp_path):
    from havenlens.operators import search_index

    path = str(tmp_path / "i")
    search_index.append_index(index[0].limit(20), path)
    before = search_index.search_index(spark.createDataFrame(QUERIES[:2], "query_id string, text string, primary_intent string"), path)
    rows = sorted(map(tuple, before.collect()), key=repr)
    data = search_index.folder_of(spark, path)
    left = spark.read.parquet(f"{data}/postings").withColumn("load", functions.lit("broken"))
    left.write.mode("append").partitionBy("term_part").parquet(f"{data}/postings")
    docs = spark.read.parquet(f"{data}/docs").select("id", "doc_len", "load", functions.lit("broken").alias("by"))
    docs.write.mode("append").parquet(f"{data}/gone")
    again = search_index.search_index(spark.createDataFrame(QUERIES[:2], "query_id string, text string, primary_intent string"), path)
    assert sorted(map(tuple, again.collect()), key=repr) == rows


def test_filters_by_customer_and_policy_and_no_others(spark, index, book):
    from havenlens.operators import search_index

    corpus, path = index[0], f"{index[1]}/once"
    asked = spark.createDataFrame([("a", "cancel or port", "hot", None), ("b", "cancel or port", "calls", None), ("c", "cancel", None, "P-none")],
                                  "query_id string, text string, customer_id string, policy_id string")
    got = {(r.query_id, r.id) for r in search_index.search_index(asked, path, 4).collect()}
    want = search.keyword_search(corpus, [search.SearchQuery("a", "cancel or port", {"customer_id": "hot"}),
                                          search.SearchQuery("b", "cancel or port", {"customer_id": "calls"})], 4)
    assert got == {(r.query_id, r.transcript_id) for r in want.collect()} and len(got) > 4
    with pytest.raises(ValueError, match="agent_id"):
        search_index.search_index(asked.withColumnRenamed("customer_id", "agent_id"), path)


def test_changed_and_deleted_calls_and_many_loads_equal_a_fresh_build(spark, index, tmp_path, monkeypatch):
    from havenlens.operators import search_index

    monkeypatch.setattr(search_index, "MOST_LOADS", 4)
    monkeypatch.setattr(search_index, "TERM_PARTS", 3)
    corpus = index[0].where("transcript_id < 'h00040' OR transcript_id > 'i'")
    corpus.write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    path, loads = str(tmp_path / "kept"), 4
    part = functions.pmod(functions.xxhash64("transcript_id"), functions.lit(loads))
    for n in range(loads):
        search_index.refresh_index(corpus.where(part == n), path)
    said = functions.when(functions.col("transcript_id") < "h00005", functions.concat(functions.col("search_text"), functions.lit(" zebra cancel"))).otherwise(
        functions.col("search_text"))
    now = corpus.withColumn("search_text", said).where("transcript_id <> 'a90' AND transcript_id <> 'h00007'")
    deleted = spark.createDataFrame([("a90",), ("h00007",), ("h00000",), ("not there",)], "id string")
    search_index.refresh_index(now, path, deleted)
    search_index.refresh_index(now, path, deleted)  # again: nothing is left to do
    search_index.append_index(now, f"{tmp_path}/fresh")
    asked = spark.createDataFrame([*[q[:2] for q in QUERIES], ("z", "zebra")], "query_id string, text string")
    want, got = (sorted((r.query_id, r["rank"], r.id, round(r.score, 9), r.summary) for r in search_index.search_index(asked, p, 9).collect())
                 for p in (f"{tmp_path}/fresh", path))
    assert got == want and sum(r[0] == "z" for r in got) > 3 and not {"a90", "h00007"} & {r[2] for r in got}
    assert spark.read.parquet(f"{search_index.folder_of(spark, path)}/loads").count() < 4
    assert len(search_index.whole_versions(spark, f"{path}/generations")) == 2
    one = spark.createDataFrame([("z", "zebra")], "query_id string, text string")
    plan = search_index.search_index(one, path)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,zebra)" in plan or "In(term, [zebra])" in plan


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, tmp_path):
    """Texts of many lengths and counts: the answer is that of a scan, and of common terms only the best blocks are read."""
    from havenlens.operators import search_index

    rng, rare = random.Random(3), "alpha beta gamma".split()
    texts = {f"d{i:04d}": " ".join(["claim"] * rng.choice([1, 1, 2, 5, 9]) + rng.choices(["other", "words", "here"], k=rng.randint(0, 150))
                                   + ([rng.choice(rare)] if i % 40 == 0 else [])) for i in range(1500)}
    corpus = spark.createDataFrame([(i, f"c{int(i[1:]) % 9}", None, "2001-09-01", "x" if i < "d0700" else "y", "z", "s", t) for i, t in texts.items()],
                                   "transcript_id string, customer_id string, policy_id string, call_date string, primary_intent string, "
                                   "sentiment_label string, summary string, search_text string")
    path = str(tmp_path / "index")
    search_index.append_index(corpus.where("transcript_id < 'd0900'"), path)
    search_index.append_index(corpus, path)
    asked = [("one", "claim", None), ("two", "claim alpha alpha", None), ("three", "words claim here", "y"), ("all", "beta", None), ("none", "zebra", None)]
    want = search.keyword_search(corpus, [search.SearchQuery(q, text, {"primary_intent": f} if f else {}) for q, text, f in asked], 5).collect()
    queries = spark.createDataFrame(asked, "query_id string, text string, primary_intent string")
    got = search_index.search_index(queries, path, 5).collect()
    assert {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in got} == {
        (r.query_id, r["rank"]): (r.transcript_id, round(r.score, 9)) for r in want} and len(got) == 20
    found = search_index.search_index(queries.where("query_id = 'one'").drop("primary_intent"), path, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"block#\d+ >= (\d+)", plan)
    postings = search_index.open_index(spark, path).postings.where("term = 'claim'")
    read = postings.where(functions.col("block") >= int(pushed[1])).count()
    assert postings.count() == 1500 and 5 <= read < 300
