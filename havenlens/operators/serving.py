"""Customer-level views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.functions.numeric import fixed, inr_label
from havenlens.operators.actions import cited_calls_in_words


def _only(df: DataFrame, ids: list[str] | None) -> DataFrame:
    """Rows of the named customers; the literal list reaches the scan as a pushed filter."""
    return df if ids is None else df.where(F.col("customer_id").isin(list(ids)))


def customer_card(nba: DataFrame, c360: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """All 360 columns plus the action columns that the 360 does not already have."""
    extra = [c for c in nba.columns if c not in c360.columns]
    return (_only(c360, ids).join(_only(nba, ids).select("customer_id", *extra), "customer_id")
            .withColumn("card_sentiment", churn.known_sentiment()))


def call_timeline(insights: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Calls newest first."""
    return _only(insights, ids).select(
        "customer_id", "call_ts", "transcript_id", "agent_id", "primary_intent", "sentiment_score", "sentiment_label",
        "summary").orderBy("customer_id", F.desc("call_ts"), F.desc("transcript_id"))


def sentiment_trend(insights: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Score series per customer, oldest first."""
    return _only(insights, ids).select("customer_id", "call_ts", "transcript_id", "sentiment_score").orderBy(
        "customer_id", "call_ts", "transcript_id")


def payments_by_month(payments: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return (_only(payments, ids).groupBy("customer_id", F.trunc("due_date", "month").alias("month"))
            .agg(*[F.count_if(F.col("payment_status") == status).alias(name)
                   for status, name in zip(K.PAYMENT_STATUSES, ("on_time", "late", "missed"))]))


def source_health(c360: DataFrame, policies: DataFrame, claims: DataFrame, payments: DataFrame,
                  insights: DataFrame, decimals: int = 2) -> DataFrame:
    """Per customer and source: row count, good / warn / bad, headline and sub-line. Counts cover all time."""
    pol = policies.groupBy("customer_id").agg(
        F.count("*").alias("n_pol"), F.count_if(F.lower("status").rlike("cancel|grace|lapse")).alias("n_bad"))
    clm = claims.groupBy("customer_id").agg(
        F.count("*").alias("n_clm"), F.count_if(F.col("status").isin(*K.OPEN_CLAIM_STATUSES)).alias("n_open"),
        F.count_if(F.col("status") == "Rejected").alias("n_rejected"))
    pay = payments.groupBy("customer_id").agg(
        F.count("*").alias("n_pay"), F.count_if(F.col("payment_status") == "Late").alias("n_late"),
        F.count_if(F.col("payment_status") == "Missed").alias("n_missed"))
    ins = insights.groupBy("customer_id").agg(
        F.count("*").alias("n_ins"), F.count_if(F.col("primary_intent") == K.CANCELLATION).alias("n_cancel"))
    wide = c360
    for counts in (pol, clm, pay, ins):
        wide = wide.join(counts, "customer_id", "left")
    wide = wide.fillna(0, ["n_pol", "n_bad", "n_clm", "n_open", "n_rejected", "n_pay", "n_late", "n_missed", "n_ins",
                           "n_cancel"])

    def text(name: str):
        return F.col(name).cast("string")

    def dash(column):
        return F.coalesce(column, F.lit("—"))

    mood = churn.known_sentiment()
    mood_or_zero = F.coalesce(mood, F.lit(0.0))
    settle = F.when(F.col("avg_days_to_settle") != 0, F.concat(fixed(F.floor(F.col("avg_days_to_settle") + 0.5).cast(
        "double"), 0), F.lit("d")))
    on_time = F.concat(F.floor(F.col("on_time_rate_12m") * 100 + 0.5).cast("string"), F.lit("%"))
    nodes = F.array(
        F.struct(
            F.lit("policies").alias("source"), F.col("n_pol").alias("n_rows"),
            F.when(F.col("n_bad") > 0, "bad").when(F.coalesce("days_to_renewal", F.lit(999)) <= 30, "warn")
            .otherwise("good").alias("health"),
            F.concat(text("n_active_policies"), F.lit(" active · "),
                     inr_label(F.col("total_annual_premium"), decimals, indian_groups=True), F.lit("/yr"))
            .alias("headline"),
            F.when(F.col("n_bad") > 0, F.concat(text("n_bad"), F.lit(" in cancellation / grace"))).otherwise(F.concat(
                F.lit("Next renewal "), dash(F.date_format("next_renewal_date", "dd MMM yyyy")))).alias("sub")),
        F.struct(
            F.lit("claims").alias("source"), F.col("n_clm").alias("n_rows"),
            F.when((F.col("n_rejected") > 0) | (F.col("n_slow_claims") > 0), "bad").when(F.col("n_open") > 0, "warn")
            .otherwise("good").alias("health"),
            F.when(F.col("n_clm") > 0, F.concat(text("n_open"), F.lit(" open · "), text("n_rejected"),
                                                F.lit(" rejected"))).otherwise("No claims filed").alias("headline"),
            F.when(F.col("max_open_claim_days") > 0, F.concat(
                F.lit("Oldest open: "), text("max_open_claim_days"), F.lit(" days")))
            .otherwise(F.concat(F.lit("Avg settle "), dash(settle))).alias("sub")),
        F.struct(
            F.lit("payments").alias("source"), F.col("n_pay").alias("n_rows"),
            F.when(F.col("n_missed") > 0, "bad").when(F.col("n_late") > 0, "warn").otherwise("good").alias("health"),
            F.concat(text("n_late"), F.lit(" late · "), text("n_missed"), F.lit(" missed")).alias("headline"),
            F.concat(F.lit("On-time rate "), dash(on_time), F.lit(" (12m)")).alias("sub")),
        F.struct(
            F.lit("calls").alias("source"), F.col("n_ins").alias("n_rows"),
            F.when((F.col("n_cancel") > 0) | (mood_or_zero < -0.2), "bad").when(mood_or_zero < 0.2, "warn")
            .otherwise("good").alias("health"),
            F.concat(text("n_ins"), F.lit(" calls · sentiment "), dash(fixed(mood, 2))).alias("headline"),
            F.concat(F.lit("Last intent: "), F.replace(dash(F.col("last_intent")), F.lit("_"), F.lit(" ")))
            .alias("sub")),
    )
    return wide.select("customer_id", F.inline(nodes))


def evidence_detail(nba: DataFrame, transcripts: DataFrame, as_of: dt.date, wording: K.Wording = K.DEFAULT_WORDING) -> DataFrame:
    """Each cited call with what it was about."""
    return cited_calls_in_words(nba, transcripts, as_of, wording)


def recent_payments(payments: DataFrame, n: int = 12, ids: list[str] | None = None) -> DataFrame:
    """Latest n instalments per customer; the row_number limit trims rows before the exchange."""
    newest = Window.partitionBy("customer_id").orderBy(F.desc("due_date"), F.desc("payment_id"))
    return _only(payments, ids).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n)


def customer_index(nba: DataFrame) -> DataFrame:
    """Label per customer, riskiest first."""
    label = F.concat_ws(" · ", "full_name", "customer_id", "city",
                        F.concat(F.col("risk_band"), F.lit(" "), fixed(F.col("risk_score"), 0)))
    return nba.select("customer_id", label.alias("label"), "risk_score").orderBy(F.desc("risk_score"), "customer_id")


def customer_search(nba: DataFrame, text: str, n: int = 8) -> DataFrame:
    """Customers whose id, name, city, products or segment contain the text; the n riskiest."""
    haystack = F.lower(F.concat_ws(" ", "customer_id", "full_name", "city", "product_lines", "segment"))
    needle = text.strip().lower()
    hits = nba.where(haystack.contains(needle)) if needle else nba
    return hits.select("customer_id", "full_name", "city", "product_lines", "segment", "risk_score", "risk_band").orderBy(
        F.desc("risk_score"), "customer_id").limit(n)


def filter_options(nba: DataFrame) -> DataFrame:
    """Distinct segments and cities. Two columns unpivoted first, so one pass and one exchange serve both."""
    options = F.array(F.struct(F.lit("segment").alias("field"), F.col("segment").alias("value")),
                      F.struct(F.lit("city").alias("field"), F.col("city").alias("value")))
    return nba.select(F.inline(options)).distinct().orderBy("field", "value")


def renewal_line(c360: DataFrame, decimals: int = 1) -> DataFrame:
    """The next-renewal line of a card."""
    return c360.where(F.col("next_renewal_date").isNotNull()).select("customer_id", F.concat(
        F.col("next_renewal_plan"), F.lit(" ("), F.col("next_renewal_policy_id"), F.lit(") on "),
        F.date_format("next_renewal_date", "dd MMM yyyy"), F.lit(" · "),
        inr_label(F.col("next_renewal_premium"), decimals)).alias("renewal_line"))
