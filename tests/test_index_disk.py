"""What a stored index and its loads leave on disk."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from havenlens.operators import search, search_index
from havenlens.session import shuffles_dropped


def exchanged(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{f}" for folder in folders for d, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_")}


def size(path: str) -> int:
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """20,000 calls of 30 different words, each with ids of its own; some ids come twice, some for two customers."""
    path = str(tmp_path_factory.mktemp("calls") / "rows")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("w"), (i * 40 + F.pmod(F.xxhash64("id", i), F.lit(40))).cast("string"))), " ")
    rows = spark.range(20_000).select(
        F.format_string("T%015d", "id").alias("transcript_id"), F.format_string("C%012d", F.pmod(F.xxhash64("id"), F.lit(4000))).alias("customer_id"),
        F.format_string("P%015d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90_000))).alias("policy_id"),
        F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.pmod("id", F.lit(240)).cast("int")), "yyyy-MM-dd").alias("call_date"),
        F.element_at(F.array(F.lit("x"), F.lit("y")), (F.pmod("id", F.lit(2)) + 1).cast("int")).alias("primary_intent"),
        F.lit("neutral").alias("sentiment_label"), F.lit("s").alias("summary"), words.alias("search_text"))
    again = rows.where("transcript_id < 'T000000000000300'")
    other = again.where("transcript_id < 'T000000000000100'").withColumn("customer_id", F.lit("C-other"))
    rows.unionByName(again).unionByName(other).write.parquet(path)
    return spark.read.parquet(path)


def test_postings_take_little_room_and_a_load_leaves_no_exchange(spark, calls, tmp_path):
    """A posting held its call's ids, customer, policy and labels, 15 bytes and more, and what a load exchanged stayed."""
    path, before = str(tmp_path / "index"), exchanged(spark)
    search_index.append_index(calls, path)
    until = time.time() + 20
    while exchanged(spark) - before and time.time() < until:  # files go soon after the write
        time.sleep(0.5)
    assert not exchanged(spark) - before
    folder = search_index.folder_of(spark, path)
    postings = spark.read.parquet(f"{folder}/postings")
    assert size(f"{folder}/postings") < 5 * postings.count()
    assert not {"id", *search_index.CARRIED} & set(postings.columns)


def test_slices_write_what_one_write_does(spark, calls, tmp_path, monkeypatch):
    ways = {}
    for name, most in (("one", 1 << 40), ("many", 1)):
        monkeypatch.setattr(search_index, "SLICE_BYTES", most)
        path = str(tmp_path / name)
        search_index.append_index(calls.where("transcript_id < 'T000000000000200' OR transcript_id >= 'T000000000010000'"), path)
        search_index.append_index(calls, path)
        search_index.refresh_index(calls.where("transcript_id > 'T000000000000250'"), path, calls.where("transcript_id < 'T000000000000002'").select("transcript_id"))
        if name == "many":
            search_index.compact_index(spark, path)
        index = search_index.open_index(spark, path)
        held = index.postings.join(index.gone, ["id", "load"], "left_anti").select("id", *search_index.CARRIED, "doc_len", "term", "tf", "block", "term_part")
        asked = spark.createDataFrame([("a", "w1 w2 w45", None), ("b", "w1", "y")], "query_id string, text string, primary_intent string")
        found = [search_index.search_index(asked, path, 9), search_index.search_index(asked.limit(1), path, 2, "customer_id"),
                 search_index.search_index(asked, path, 2, "customer_id", spark.createDataFrame([("C-other",), ("C000000000007",)], "customer_id string"))]
        ways[name] = [held.agg(F.count("*"), F.sum(F.xxhash64(*held.columns).cast("decimal(38,0)"))).first(),
                      *(sorted(map(str, f.withColumn("score", F.round("score", 9)).collect())) for f in found)]
    assert ways["one"] == ways["many"] and all(ways["one"]) and all(len(x) > 1 for x in ways["one"][1:])


def test_calls_of_two_customers_with_one_id_keep_their_customers(spark, calls, tmp_path):
    path = str(tmp_path / "index")
    search_index.append_index(calls, path)
    asked = spark.createDataFrame([("q", "w1 w2 w3 w4 w5 w6 w7")], "query_id string, text string")
    got = search_index.search_index(asked, path, 3, "customer_id", spark.createDataFrame([("C-other",)], "customer_id string"))
    assert {r["rank"] for r in got.collect()} == {1, 2, 3}
    by_filter = spark.createDataFrame([("q", "w1 w2 w3 w4 w5 w6 w7", "C-other")], "query_id string, text string, customer_id string")
    assert {r.id for r in search_index.search_index(by_filter, path, 3).collect()} == {r.id for r in got.collect()}
    once = calls.where("transcript_id >= 'T000000000000300'")
    search_index.append_index(once, f"{path}-once")
    want = search.keyword_search(once, [search.SearchQuery("q", "w1 w2 w45")], 8).collect()
    found = search_index.search_index(spark.createDataFrame([("q", "w1 w2 w45")], "query_id string, text string"), f"{path}-once", 8).collect()
    assert {(r["rank"], r.id, round(r.score, 9)) for r in found} == {(r["rank"], r.transcript_id, round(r.score, 9)) for r in want}


def test_an_index_of_an_earlier_form_is_refused(spark, calls, tmp_path):
    path = str(tmp_path / "index")
    search_index.append_index(calls.limit(3), path)
    folder = search_index.folder_of(spark, path)
    rows = spark.createDataFrame(spark.read.parquet(f"{folder}/docs").drop("run", "doc").collect(), spark.read.parquet(f"{folder}/docs").drop("run", "doc").schema)
    rows.write.mode("overwrite").parquet(f"{folder}/docs")
    with pytest.raises(ValueError, match="earlier form"):
        search_index.open_index(spark, path)


@pytest.mark.parametrize("was", [None, "false", "true"])
def test_the_setting_is_put_back(spark, was):
    from havenlens.session import DROPPING

    begun = spark.conf.get(DROPPING, None)
    try:
        spark.conf.unset(DROPPING) if was is None else spark.conf.set(DROPPING, was)
        kept = spark.conf.get(DROPPING, None)
        with pytest.raises(RuntimeError), shuffles_dropped(spark):
            assert spark.conf.get(DROPPING) == "true"
            raise RuntimeError
        assert spark.conf.get(DROPPING, None) == kept
    finally:
        spark.conf.unset(DROPPING) if begun is None else spark.conf.set(DROPPING, begun)
