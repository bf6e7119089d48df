"""The plans that matter at scale: what reaches the scan and how often rows are exchanged."""

from __future__ import annotations

import re

from sample_days import AS_OF

from havenlens.operators import customer360


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
                                                  .fromString("formatted"))


def test_windows_and_columns_reach_the_scan(sample):
    claims = plan_of(customer360.claims_rollup_18m(sample["claims"], AS_OF))
    assert "GreaterThanOrEqual(claim_date,2000-05-05)" in claims and "policy_id" not in claims
    calls = plan_of(customer360.calls_rollup_180d(sample["call_transcripts"], AS_OF))
    assert "GreaterThanOrEqual(call_ts," in calls and "transcript_text" not in calls


def test_scoring_a_call_shuffles_nothing(plain_book):
    assert "Exchange" not in plan_of(plain_book.insights)


def test_the_360_exchanges_each_source_once(spark, sample, book):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = customer360.customer_360(*[sample[t] for t in (
            "customers", "policies", "claims", "payments", "call_transcripts")], book.insights, AS_OF)
        text = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id", text)) == text.count("Exchange ") == 6


def test_month_layout_is_pruned(spark, sample, tmp_path):
    from havenlens.sources.tables import write_table

    path = str(tmp_path / "calls")
    write_table(sample["call_transcripts"], path, month_of="call_ts")
    stored = spark.read.parquet(path)
    recent = customer360.since(stored, AS_OF, 20)
    assert re.search(r"PartitionFilters: \[.*month.*2001-10", plan_of(recent))
    assert recent.count() == customer360.since(sample["call_transcripts"], AS_OF, 20).count()


def test_a_card_reads_each_stage_once(book):
    from havenlens.operators import serving

    plan = serving.customer_card(book.nba, book.c360)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "transcript_text" not in plan
