"""The book stored by customer: no exchanges, pruned buckets, whole runs only."""

from __future__ import annotations

import re

import pytest

from sample_days import AS_OF

from havenlens.operators import actions, customer360, serving
from havenlens.plans.keyed_book import SOURCES, open_keyed_book, store_keyed
from havenlens.sources import keyed

BUCKETS = 8


@pytest.fixture(scope="module")
def stored(spark, plain_book, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keyed"))
    store_keyed(spark, plain_book, folder, BUCKETS, spread=2)
    return folder, open_keyed_book(spark, plain_book, folder)


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
                                                  .fromString("formatted"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_stored_book_is_the_book(stored, book):
    for name in ("c360", "risk", "nba"):
        mine, theirs = getattr(stored[1], name), getattr(book, name)
        assert mine.columns == theirs.columns and mine.count() == theirs.count()
        assert mine.exceptAll(theirs.select(mine.columns)).count() == 0
    for name in SOURCES:
        assert getattr(stored[1], name).exceptAll(getattr(book, name)).count() == 0


def test_360_actions_and_cards_exchange_nothing(stored, no_broadcast):
    b = stored[1]
    wide = customer360.customer_360(b.customers, b.policies, b.claims, b.payments, b.call_transcripts, b.insights, AS_OF)
    nba = actions.next_best_actions(b.risk, b.insights, AS_OF, b.wording, b.stamped_at)
    card = serving.customer_card(b.nba, b.c360)
    health = serving.source_health(b.c360, b.policies, b.claims, b.payments, b.insights)
    for df in (wide, nba, card, health):
        assert "Exchange" not in plan_of(df), plan_of(df)


def test_semantic_queries_exchange_nothing_by_customer(stored, book, no_broadcast):
    from havenlens.operators import semantic

    for dimensions in (["customer_segment"], ["call_intent"], ["churn_risk_band", "customer_city"]):
        on, plain = (semantic.semantic_query(b.logical_tables, dimensions, ["customer_count", "at_risk_premium", "call_count"])
                     for b in (stored[1], book))
        assert "hashpartitioning(customer_id" not in plan_of(on) and on.exceptAll(plain).count() == plain.exceptAll(on).count() == 0


def test_a_card_reads_one_bucket_per_customer(stored, no_broadcast):
    ids = ["none", "hot", "tie"]
    card = serving.customer_card(stored[1].nba, stored[1].c360, ids)
    counts = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan_of(card))
    assert len(counts) == 2 and all(int(n) <= 3 and int(of) == BUCKETS for n, of in counts)
    assert sorted(r.customer_id for r in card.collect()) == sorted(ids)
    files = {f for f in serving._only(stored[1].nba, ids).inputFiles()}
    assert len(files) <= BUCKETS


def test_rows_of_a_frequent_customer_are_written_by_several_tasks(spark, stored):
    from pyspark.sql import functions as F

    files = stored[1].call_transcripts.where("customer_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert files == 2


def test_a_run_that_broke_off_is_not_read(spark, stored, plain_book, monkeypatch):
    folder, before = stored

    def breaks(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(keyed, "write_layout", breaks)
    with pytest.raises(RuntimeError):
        store_keyed(spark, plain_book, folder, BUCKETS)
    monkeypatch.undo()
    assert open_keyed_book(spark, plain_book, folder).nba.inputFiles() == before.nba.inputFiles()
    store_keyed(spark, plain_book, folder, 4)
    again = open_keyed_book(spark.newSession(), plain_book, folder).nba
    assert again.inputFiles() != before.nba.inputFiles() and again.count() == before.nba.count()


def test_insights_lie_in_the_buckets_of_their_calls_without_an_exchange(spark, stored, plain_book, tmp_path, monkeypatch, no_broadcast):
    from pyspark.sql import functions as F

    made = {}
    write = keyed.write_keyed

    def noted(df, path, key, buckets, spread=1, distinct=()):
        made[path.rsplit("/", 1)[1]] = "Exchange" in plan_of(df) or spread > 1
        return write(df, path, key, buckets, spread, distinct)

    monkeypatch.setattr(keyed, "write_keyed", noted)
    again = store_keyed(spark, plain_book, str(tmp_path), BUCKETS, spread=2)
    assert set(made) == {*SOURCES, "interaction_insights", "customer_360", "churn_risk", "next_best_actions"}
    assert not any(made[name] for name in ("interaction_insights", "customer_360", "churn_risk", "next_best_actions"))
    assert again.insights.exceptAll(plain_book.insights).count() == plain_book.insights.exceptAll(again.insights).count() == 0
    lying = [b.select("transcript_id", F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1).alias("bucket"))
             for b in (again.call_transcripts, again.insights)]
    assert lying[0].exceptAll(lying[1]).count() == 0 and lying[1].where("bucket = ''").count() == 0


def test_insights_that_exist_are_dealt_into_buckets(spark, stored, plain_book, tmp_path):
    scored = stored[1].insights.coalesce(1).select("*")
    again = store_keyed(spark, plain_book, str(tmp_path), BUCKETS, spread=2, scored=scored)
    assert again.insights.exceptAll(scored).count() == scored.exceptAll(again.insights).count() == 0


def test_a_lane_that_broke_off_breaks_the_run(spark, stored, plain_book, monkeypatch, tmp_path):
    def breaks(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr("havenlens.plans.keyed_book.insights.interaction_insights", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        store_keyed(spark, plain_book, str(tmp_path), BUCKETS)
    assert not (tmp_path / "layouts").exists()
