from __future__ import annotations

import datetime as dt

import pytest
from sample_days import AS_OF
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.operators import actions, decisions, risk


@pytest.mark.parametrize("days, points", [(-10, 15), (0, 15), (30, 15), (31, 10), (60, 10), (61, 5), (90, 5), (91, 0)])
def test_renewal_points_at_the_boundaries(risk_rows, days, points):
    assert risk_rows[f"renew{days}"].p_renewal == points


def test_three_late_points_round_to_even(risk_rows):
    assert risk_rows["late3"].p_payment == 11.2


def test_score_is_the_clipped_sum_of_points(risk_rows):
    for r in risk_rows.values():
        total = sum(r[c] for c in K.POINT_COLUMNS)
        assert r.risk_score == pytest.approx(max(0, min(100, total)), abs=0.051) and 0 <= r.risk_score <= 100
        assert r.risk_band == ("High" if r.risk_score >= 55 else "Medium" if r.risk_score >= 30 else "Low")
        assert [d.factor for d in r.risk_drivers if d.points == 0] == []


def test_bands_at_their_limits(spark):
    df = spark.createDataFrame([(55.0,), (54.9,), (30.0,), (29.9,), (100.0,)], "risk_score double")
    assert [r.b for r in df.select(churn.risk_band().alias("b")).collect()] == ["High", "Medium", "Medium", "Low", "High"]


def test_drivers_rank_by_points_and_keep_order_on_ties(spark):
    drivers = [("a", 10.0, ""), ("b", 15.0, ""), ("c", 10.0, ""), ("d", -5.0, "")]
    df = spark.createDataFrame([(drivers,)], "d array<struct<factor: string, points: double, detail: string>>")
    got = df.select(churn.top_drivers(F.col("d"), 3).alias("names"),
                    churn.top_drivers(F.col("d"), 2, " · ", True).alias("points")).first()
    assert (got.names, got.points) == ("b; a; c", "b +15 · a +10")


def test_protective_share_is_left_out(book):
    shares = risk.driver_share(book.risk).collect()
    assert {r.factor for r in shares} <= set(K.DRIVER_MAXIMA) and all(0 < r.share_pct <= 100 for r in shares)


def test_one_action_per_customer_and_own_recent_evidence(book, nba_rows):
    owner = {r.transcript_id: r.customer_id for r in book.call_transcripts.collect()}
    assert len(nba_rows) == book.customers.count()
    for r in nba_rows.values():
        assert len(r.evidence) <= 3 and all(owner[t] == r.customer_id for t in r.evidence)


def test_evidence_prefers_the_matching_intent_then_any(nba_rows):
    assert nba_rows["calls"].action_category == "RETENTION_CALL" and nba_rows["calls"].evidence == ["a90"]
    assert nba_rows["renew0"].action_category == "RENEWAL_NUDGE" and nba_rows["renew0"].evidence == ["quiet"]
    assert nba_rows["none"].evidence == []


def test_hot_customer_keeps_the_latest_matching_calls(book, nba_rows):
    calls = [r for r in book.insights.where("customer_id = 'hot'").collect() if r.primary_intent == K.CANCELLATION]
    latest = sorted(calls, key=lambda r: (r.call_ts, r.transcript_id), reverse=True)[:3]
    assert nba_rows["hot"].evidence == [r.transcript_id for r in latest]


def test_evidence_is_limited_before_the_exchange(book):
    plan = actions.evidence_pool(book.insights, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_texts_never_go_missing(nba_rows):
    r = nba_rows["none"]
    assert r.action_category == "CROSS_SELL" and "None" not in (r.customer_message or "")
    assert all(r.action and r.reason for r in nba_rows.values())
    assert all((r.customer_message is None) == (r.action_category == "NURTURE") for r in nba_rows.values())


def test_queue_respects_run_size_and_total_cap(spark):
    scored = spark.createDataFrame(
        [("a", 60.0, "High", 0), ("b", 60.0, "High", 0), ("c", 31.0, "Medium", 0), ("d", 5.0, "Low", 1),
         ("e", 9.0, "Low", 0)], "customer_id string, risk_score double, risk_band string, n_upsell_interest_180d long")

    def queued(done, **limits):
        ids = spark.createDataFrame([(d,) for d in done], "customer_id string")
        return [r.customer_id for r in actions.enrichment_queue(scored, ids, **limits).orderBy("queue_no").collect()]

    assert queued([]) == ["a", "b", "c", "d"] and queued([], per_run=2) == ["a", "b"]
    assert queued(["a", "x"], per_run=2, cap=3) == ["b"]
    assert queued(["a", "x"], per_run=2, cap=2) == []


def test_model_answers_overlay_only_when_they_parse(book, spark):
    answers = spark.createDataFrame([
        ("calls", 'text {"action": "Ring", "evidence": ["h00001", "d1", "a90"]} text'), ("tie", "no idea"),
        ("none", "{broken"), ("claims", "{}"), ("late3", '{"action_category": "MADE_UP", "action": "Ask"}')],
        "customer_id string, response string")
    before = {r.customer_id: r for r in book.nba.collect()}
    after = {r.customer_id: r for r in actions.apply_model_response(book.nba, answers, book.insights).collect()}
    assert (after["calls"].action, after["calls"].evidence) == ("Ring", ["d1", "a90"])
    assert after["calls"].reason == before["calls"].reason and after["calls"].generated_by == "model"
    assert all(after[c] == before[c] for c in ("tie", "none", "claims"))
    assert (after["late3"].action_category, after["late3"].action) == (before["late3"].action_category, "Ask")


def test_latest_valid_decision_wins(spark, rows):
    from havenlens import schemas

    ts = dt.datetime(2001, 11, 1)
    log = rows(schemas.ACTION_LOG, [
        dict(log_id=1, customer_id="a", status="Accepted", ts=ts), dict(log_id=2, customer_id="a", status="Done", ts=ts),
        dict(log_id=3, customer_id="a", status="Maybe", ts=ts + dt.timedelta(1)),
        dict(log_id=4, customer_id="b", status="Rejected", ts=ts)])
    status = decisions.action_status(log)
    assert {(r.customer_id, r.status) for r in status.collect()} == {("a", "Done"), ("b", "Rejected")}
    uptake = decisions.action_uptake(status).first()
    assert (uptake.reviewed, uptake.done, uptake.uptake_rate) == (2, 1, 0.5)
    assert decisions.action_uptake(status.limit(0)).first().uptake_rate is None


def test_repeated_answers_keep_one_row_per_customer(spark, book):
    from pyspark.sql import functions as F

    ids = [r.customer_id for r in book.nba.orderBy("customer_id").limit(2).collect()]
    answers = [(ids[0], '{"action": "First", "evidence": ["x"]}', 1), (ids[0], '{"action": "Second"}', 2), (ids[0], "no answer", 3),
               (ids[1], '{"action": "A"}', 5), (ids[1], '{"action": "B"}', 5)]
    df = spark.createDataFrame(answers, "customer_id string, response string, responded_at int")
    for responses, first in ((df, "Second"), (df.drop("responded_at"), "Second")):
        after = actions.apply_model_response(book.nba, responses, book.insights)
        got = {r.customer_id: r for r in after.collect()}
        assert after.count() == book.nba.count() == len(got)
        assert got[ids[0]].action == first and got[ids[1]].action == "B"
    assert after.where(F.col("generated_by") == "model").count() == 2


def test_only_cited_calls_are_summarised(book):
    from sample_days import AS_OF

    told = actions.cited_calls_in_words(book.nba, book.call_transcripts, AS_OF)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    depth = {name: plan.index(name) for name in ("summary", "LeftSemi")}
    assert depth["summary"] < depth["LeftSemi"] and "transcript_text" not in plan.split("LeftSemi")[0].split("Project")[0]
    assert told.count() == book.nba.selectExpr("explode(evidence)").count()
