"""One wide row per customer from five sources. Each source is scanned once and shuffled once, on customer_id."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions.numeric import exact_mean, half_even, ratio
from havenlens.functions.times import moment

RENEWAL_COLUMNS = ("next_renewal_policy_id", "next_renewal_product", "next_renewal_plan", "next_renewal_premium",
                   "next_renewal_date", "days_to_renewal")


def as_of_date(as_of: dt.date) -> Column:
    return F.lit(as_of)


def months_back(as_of: dt.date, months: int) -> Column:
    return F.add_months(as_of_date(as_of), -months)


def days_back(as_of: dt.date, days: int) -> Column:
    """Midnight `days` days before as_of, in the type of call_ts."""
    return moment(dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))


def since(calls: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Calls of the last `days` days. A table laid out by month is pruned to the months concerned."""
    kept = calls.where(F.col("call_ts") >= days_back(as_of, days))
    if "month" in calls.columns:
        kept = kept.where(F.col("month") >= (as_of - dt.timedelta(days=days)).strftime("%Y-%m"))
    return kept


def policy_profile(policies: DataFrame, as_of: dt.date) -> DataFrame:
    """Holdings and next renewal together: one scan and one exchange for both."""
    status, live = F.col("status"), F.col("status") != K.LAPSED
    soonest = F.min(F.when(live & F.col("renewal_date").isNotNull(), F.struct(
        "renewal_date", "policy_id", "product_line", "plan_name", "annual_premium")))
    grouped = policies.groupBy("customer_id").agg(
        F.count_if(status.isin(*K.ACTIVE_STATUSES)).alias("n_active_policies"),
        F.array_join(F.array_sort(F.collect_set("product_line")), ", ").alias("product_lines"),
        F.sum(F.when(live, F.col("annual_premium"))).alias("total_annual_premium"),
        F.coalesce(F.sum("sum_insured"), F.lit(0)).alias("total_sum_insured"),
        *[F.max(F.when(F.col("product_line") == product, 1).otherwise(0)).alias(f"has_{product.lower()}")
          for product in ("Health", "Life", "Motor", "Home")],
        F.count_if(status == "Cancellation Requested").alias("n_cancel_requests"),
        F.count_if(status == "Grace Period").alias("n_in_grace"),
        soonest.alias("soonest"))
    return grouped.select(
        *[c for c in grouped.columns if c != "soonest"],
        F.col("soonest.policy_id").alias("next_renewal_policy_id"),
        F.col("soonest.product_line").alias("next_renewal_product"),
        F.col("soonest.plan_name").alias("next_renewal_plan"),
        F.col("soonest.annual_premium").alias("next_renewal_premium"),
        F.col("soonest.renewal_date").alias("next_renewal_date"),
        F.datediff(F.col("soonest.renewal_date"), as_of_date(as_of)).alias("days_to_renewal"))


def policy_rollup(policies: DataFrame, as_of: dt.date) -> DataFrame:
    return policy_profile(policies, as_of).drop(*RENEWAL_COLUMNS)


def next_renewal(policies: DataFrame, as_of: dt.date) -> DataFrame:
    """Earliest renewal among policies that have not lapsed; equal dates go to the smaller policy id."""
    return (policy_profile(policies, as_of).select("customer_id", *RENEWAL_COLUMNS)
            .where(F.col("next_renewal_date").isNotNull()))


def claims_rollup_18m(claims: DataFrame, as_of: dt.date) -> DataFrame:
    is_open = F.col("status").isin(*K.OPEN_CLAIM_STATUSES)
    slow = ((F.col("status") == "Settled") & (F.col("days_to_settle") > 30)) | (is_open & (F.col("days_open") > 30))
    return claims.where(F.col("claim_date") >= months_back(as_of, 18)).groupBy("customer_id").agg(
        F.count("*").alias("n_claims"),
        F.count_if(is_open).alias("n_open_claims"),
        F.count_if(F.col("status") == "Rejected").alias("n_rejected_claims"),
        F.count_if(slow).alias("n_slow_claims"),
        F.coalesce(F.sum("claim_amount"), F.lit(0)).alias("total_claimed"),
        F.coalesce(F.sum("approved_amount"), F.lit(0)).alias("total_approved"),
        half_even(F.avg("days_to_settle"), 1).alias("avg_days_to_settle"),
        F.max(F.when(is_open, F.col("days_open"))).alias("max_open_claim_days"))


def payments_rollup_12m(payments: DataFrame, as_of: dt.date) -> DataFrame:
    status = F.col("payment_status")
    return payments.where(F.col("due_date") >= months_back(as_of, 12)).groupBy("customer_id").agg(
        F.count("*").alias("n_payments_due_12m"),
        F.count_if(status == "Late").alias("n_late_12m"),
        F.count_if(status == "Missed").alias("n_missed_12m"),
        half_even(ratio(F.count_if(status == "On-time"), F.count("*")), 3).alias("on_time_rate_12m"),
        half_even(F.avg(F.when(status == "Late", F.col("days_late"))), 1).alias("avg_days_late"))


def calls_rollup_180d(transcripts: DataFrame, as_of: dt.date) -> DataFrame:
    return since(transcripts, as_of, 180).groupBy("customer_id").agg(
        F.count("*").alias("n_calls_180d"),
        F.max("call_ts").alias("last_call_ts"),
        F.floor(F.coalesce(F.sum("duration_sec"), F.lit(0)) / 60).cast("long").alias("call_minutes_180d"))


def ai_signals(insights: DataFrame, as_of: dt.date) -> DataFrame:
    recent = F.col("call_ts") >= days_back(as_of, 90)
    intent, score = F.col("primary_intent"), F.col("sentiment_score")
    grouped = since(insights, as_of, 180).groupBy("customer_id").agg(
        exact_mean(score, 3, recent).alias("avg_sentiment_90d"),
        exact_mean(score, 3).alias("avg_sentiment_180d"),
        F.max(F.struct("call_ts", "transcript_id", "sentiment_score", "primary_intent")).alias("last"),
        F.count_if(recent & (intent == K.CANCELLATION)).alias("n_cancel_intent_90d"),
        F.count_if(intent == K.CANCELLATION).alias("n_cancel_intent_180d"),
        F.count_if(recent & (intent == K.PRICE)).alias("n_price_concern_90d"),
        F.count_if(recent & (intent == K.CLAIM)).alias("n_claim_issue_90d"),
        F.count_if(intent == K.UPSELL).alias("n_upsell_interest_180d"),
        F.count_if(intent == K.PRAISE).alias("n_service_praise_180d"))
    return grouped.select(
        "customer_id", "avg_sentiment_90d", "avg_sentiment_180d", F.col("last.sentiment_score").alias("last_sentiment"),
        F.col("last.primary_intent").alias("last_intent"), "n_cancel_intent_90d", "n_cancel_intent_180d",
        "n_price_concern_90d", "n_claim_issue_90d", "n_upsell_interest_180d", "n_service_praise_180d",
        F.lit(True).alias("has_ai_insights"))


def customer_360(customers: DataFrame, policies: DataFrame, claims: DataFrame, payments: DataFrame,
                 transcripts: DataFrame, insights: DataFrame | None, as_of: dt.date) -> DataFrame:
    """59 columns per customer. Every right side is already hashed on customer_id by its own aggregation."""
    wide = customers
    for rollup in (policy_profile(policies, as_of), claims_rollup_18m(claims, as_of),
                   payments_rollup_12m(payments, as_of), calls_rollup_180d(transcripts, as_of)):
        wide = wide.join(rollup, "customer_id", "left")
    if insights is None:
        empty = customers.sparkSession.createDataFrame([], (
            "transcript_id string, customer_id string, call_ts timestamp_ntz, sentiment_score double, "
            "primary_intent string"))
        insights = empty
    wide = wide.join(ai_signals(insights, as_of), "customer_id", "left")
    return wide.fillna(0, list(K.ZERO_FILLED)).fillna(False, ["has_ai_insights"])


def coverage_summary(c360: DataFrame) -> DataFrame:
    """How many customers each source covers, and the premium they hold."""
    return c360.agg(
        F.count("*").alias("n_customers"),
        F.count_if(F.col("product_lines").isNotNull()).alias("with_policies"),
        F.count_if(F.col("n_claims") > 0).alias("with_claims"),
        F.count_if(F.col("n_payments_due_12m") > 0).alias("with_payments"),
        F.count_if(F.col("n_calls_180d") > 0).alias("with_calls"),
        F.count_if("has_ai_insights").alias("with_ai_insights"),
        F.sum("total_annual_premium").alias("total_premium"))
