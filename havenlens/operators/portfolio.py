"""Portfolio aggregates over a cohort of customers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.functions.numeric import inr_label, ratio
from havenlens.operators.customer360 import as_of_date, since


def _by_band(value) -> list:
    """One zero-filled sum per band: a pivot over a known domain as plain conditional sums."""
    return [F.coalesce(F.sum(F.when(F.col("risk_band") == band, value)), F.lit(0)).alias(band.lower())
            for band in K.BANDS]


def portfolio_filter(nba: DataFrame, policies: DataFrame, products: Sequence[str] = (), segments: Sequence[str] = (),
                     cities: Sequence[str] = ()) -> DataFrame:
    """Customers that hold (or held) any of the products, in the segments and cities; an empty list filters nothing."""
    cohort = nba
    if segments:
        cohort = cohort.where(F.col("segment").isin(*segments))
    if cities:
        cohort = cohort.where(F.col("city").isin(*cities))
    if products:
        holders = policies.where(F.col("product_line").isin(*products)).select("customer_id").distinct()
        cohort = cohort.join(holders, "customer_id", "left_semi")
    return cohort


def portfolio_kpis(cohort: DataFrame) -> DataFrame:
    """Headline figures; renewals due within 30 days include overdue ones."""
    high = F.col("risk_band") == "High"
    premium = F.coalesce(F.sum("total_annual_premium"), F.lit(0))
    high_premium = F.coalesce(F.sum(F.when(high, F.col("total_annual_premium"))), F.lit(0))
    return cohort.agg(
        F.count("*").alias("n_customers"), F.count_if(high).alias("n_high"),
        ratio(F.count_if(high), F.count("*")).alias("high_share"),
        premium.alias("premium"), high_premium.alias("high_premium"),
        ratio(high_premium, premium).alias("high_premium_share"),
        F.coalesce(F.sum("expected_premium_loss"), F.lit(0.0)).alias("expected_loss"),
        F.count_if(high & (F.col("days_to_renewal") <= 30)).alias("high_renewals_30d"))


def _bands(cohort: DataFrame) -> DataFrame:
    return cohort.select("customer_id", "risk_band")


def premium_by_product_band(cohort: DataFrame, policies: DataFrame) -> DataFrame:
    """Premium that has not lapsed, product × band.

    Facts are summed per customer before they meet the cohort, here and below, so that the join sees few rows of even
    the largest customer.
    """
    live = (policies.where(F.col("status") != K.LAPSED).groupBy("customer_id", "product_line")
            .agg(F.sum("annual_premium").alias("annual_premium")))
    return live.join(_bands(cohort), "customer_id").groupBy("product_line").agg(*_by_band(F.col("annual_premium")))


def intent_by_sentiment(cohort: DataFrame, insights: DataFrame, as_of: dt.date) -> DataFrame:
    """Calls of the last 180 days by intent and mood, smallest total first."""
    moods = [F.count_if(F.col("sentiment_label") == label).alias(label) for label in K.SENTIMENT_LABELS]
    per_customer = since(insights, as_of, 180).groupBy("customer_id", "primary_intent").agg(
        *moods, F.count("*").alias("n_calls"))
    return (per_customer.join(cohort.select("customer_id"), "customer_id", "left_semi").groupBy("primary_intent")
            .agg(*[F.sum(c).alias(c) for c in (*K.SENTIMENT_LABELS, "n_calls")]).orderBy("n_calls", "primary_intent"))


def renewal_pipeline(cohort: DataFrame, policies: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Premium renewing per week (Monday start) and band, today and the last day included."""
    due = policies.where(F.col("renewal_date").between(as_of_date(as_of), F.date_add(as_of_date(as_of), days)))
    weekly = due.groupBy("customer_id", F.trunc("renewal_date", "week").alias("week")).agg(
        F.sum("annual_premium").alias("annual_premium"))
    return (weekly.join(_bands(cohort), "customer_id").groupBy("week").agg(*_by_band(F.col("annual_premium")))
            .orderBy("week"))


def plays(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("action_category").agg(F.count("*").alias("n_customers")).orderBy(
        "n_customers", "action_category")


def call_list(cohort: DataFrame, n: int = 25) -> DataFrame:
    """Whom to call first: highest risk, then highest premium."""
    return (cohort.orderBy(F.desc("risk_score"), F.desc("total_annual_premium"), "customer_id").limit(n)
            .select("customer_id", "full_name", "city", "segment", "risk_score", "risk_band", "total_annual_premium",
                    "next_renewal_product", "days_to_renewal",
                    churn.top_drivers(F.col("risk_drivers"), 3, " · ", with_points=True).alias("top_drivers"),
                    "action"))


def at_risk_list(nba: DataFrame, n: int = 20) -> DataFrame:
    """Non-Low customers by premium at risk, then score."""
    return (nba.where(F.col("risk_band") != "Low")
            .orderBy(F.desc("premium_at_risk"), F.desc("risk_score"), "customer_id").limit(n)
            .select("customer_id", "full_name", "segment", "city", "risk_score", "risk_band", "premium_at_risk",
                    inr_label(F.col("premium_at_risk"), 2, indian_groups=True).alias("premium_label"),
                    "action_category"))


def portfolio_totals(nba: DataFrame, insights: DataFrame) -> DataFrame:
    """One row of book totals. The premium total equals the 360's: both tables carry it per customer."""
    high = F.col("risk_band") == "High"
    book = nba.agg(
        F.count("*").alias("n_customers"), (ratio(F.count_if(high), F.count("*")) * 100).alias("pct_high_risk"),
        F.coalesce(F.sum("premium_at_risk"), F.lit(0)).alias("premium_at_risk"),
        F.coalesce(F.sum("expected_premium_loss"), F.lit(0.0)).alias("expected_premium_loss"),
        F.coalesce(F.sum("total_annual_premium"), F.lit(0)).alias("total_premium"))
    milli = F.rint(F.col("sentiment_score") * 1000).cast("long")
    calls = insights.agg(F.count("*").alias("n"), F.sum(milli).alias("total"), F.count(milli).alias("scored")).select(
        F.struct("n", "total", "scored")).scalar()
    return book.withColumn("calls", calls).select(
        *book.columns, F.col("calls.n").alias("n_transcripts"),
        (F.col("calls.total").cast("double") / F.nullif(F.col("calls.scored"), F.lit(0)) / 1000).alias("avg_sentiment"))


def portfolio_breakdown(nba: DataFrame, insights: DataFrame) -> DataFrame:
    """Counts per band, play and intent in long form: (section, name, n)."""
    sections = nba.select(F.inline(F.array(
        F.struct(F.lit("risk_bands").alias("section"), F.col("risk_band").alias("name")),
        F.struct(F.lit("actions").alias("section"), F.col("action_category").alias("name")))))
    intents = insights.select(F.lit("intents").alias("section"), F.col("primary_intent").alias("name"))
    return sections.unionByName(intents).groupBy("section", "name").agg(F.count("*").alias("n"))


def risk_histogram(nba: DataFrame) -> DataFrame:
    """Customers per ten-point bucket 0–9 … 90–99; empty buckets show 0 and a score of 100 falls in none."""
    buckets = nba.sparkSession.range(0, 100, 10).select(F.col("id").alias("low"))
    counted = nba.groupBy((F.floor(F.col("risk_score") / 10) * 10).cast("long").alias("low")).agg(
        F.count("*").alias("n"))
    return buckets.join(counted, "low", "left").select(
        F.concat(F.col("low").cast("string"), F.lit("-"), (F.col("low") + 9).cast("string")).alias("bucket"),
        F.coalesce("n", F.lit(0)).alias("n_customers"))
