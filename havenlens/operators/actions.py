"""Next best action per customer, with the calls that support it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.functions.numeric import fixed, ratio
from havenlens.functions.rules import fill, first_match
from havenlens.functions.times import moment
from havenlens.operators.customer360 import since
from havenlens.operators.insights import interaction_insights

GENERATED_BY = "rule engine"
RESPONSE = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("customer_message", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("action_category", T.StringType()),
])


def action_category() -> Column:
    """First rule that holds decides the play."""
    high, low = F.col("risk_band") == "High", F.col("risk_band") == "Low"
    friction = F.col("p_claims") >= 7.5
    return first_match([
        ((F.col("p_cancel") >= 20) | (high & (F.col("p_cancel") > 0)), "RETENTION_CALL"),
        (friction & (F.col("n_open_claims") > 0), "CLAIM_ESCALATION"),
        (F.col("p_price") > 0, "PRICE_MATCH"),
        (F.col("p_payment") >= 7.5, "PAYMENT_FLEX"),
        (friction, "CLAIM_ESCALATION"),
        (F.col("days_to_renewal") <= 30, "RENEWAL_NUDGE"),
        (low & ((F.col("n_upsell_interest_180d") > 0) | (F.col("n_active_policies") <= 2)), "CROSS_SELL"),
        (low & (F.col("n_service_praise_180d") > 0), "ADVOCACY"),
        (F.col("days_to_renewal") <= 60, "RENEWAL_NUDGE"),
    ], "NURTURE")


def cross_sell_product(wording: K.Wording = K.DEFAULT_WORDING) -> Column:
    """Offer for the first product line the customer lacks; holding no policy at all lacks none of them knowingly."""
    return first_match([(F.col(f"has_{line.lower()}") == 0, offer) for line, offer in wording.offers.items()],
                       wording.fallback_offer)


def _slots(wording: K.Wording) -> dict[str, Column | str]:
    return {
        "first": F.coalesce(F.get(F.split(F.trim("full_name"), r"\s+"), F.lit(0)), F.lit("")),
        "brand": wording.brand,
        "policy": F.coalesce("next_renewal_policy_id", F.lit("your policy")),
        "product": F.coalesce("next_renewal_product", F.lit("insurance")),
        "renews": F.coalesce(F.date_format("next_renewal_date", "dd MMM"), F.lit("")),
        "offer": cross_sell_product(wording),
    }


def action_text(category: Column, wording: K.Wording = K.DEFAULT_WORDING) -> Column:
    slots = _slots(wording)
    return first_match([(category == name, fill(text, slots)) for name, text in K.ACTION_TEXT.items()], None)


def customer_message(category: Column, wording: K.Wording = K.DEFAULT_WORDING) -> Column:
    slots = _slots(wording)
    return first_match([(category == name, fill(text, slots)) for name, text in K.CUSTOMER_MESSAGE.items()], None)


def action_reason(category: Column, drivers: Column) -> Column:
    top = F.coalesce(F.nullif(churn.top_drivers(drivers, 2), F.lit("")), F.lit("none"))
    return F.concat(F.lit("Rule engine: "), category, F.lit(" — top drivers: "), top)


def evidence_pool(insights: DataFrame, as_of: dt.date, k: int = 3) -> DataFrame:
    """Per customer, the k latest calls of each intent, newest first.

    The row_number limit is applied before the exchange, so a customer with very many calls moves at most k rows per
    intent and map task; the collected array holds at most k × 6 entries.
    """
    latest = Window.partitionBy("customer_id", "primary_intent").orderBy(
        F.desc("call_ts"), F.desc("transcript_id"))
    kept = (since(insights, as_of, 180)
            .select("customer_id", "primary_intent", "call_ts", "transcript_id")
            .withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= k))
    return kept.groupBy("customer_id").agg(F.sort_array(F.collect_list(
        F.struct("call_ts", "transcript_id", "primary_intent")), asc=False).alias("recent_calls"))


def cited_calls(category: Column, pool: Column, k: int = 3) -> Column:
    """Ids of the latest calls about the category's intent; without any, the latest calls of whatever intent."""
    wanted = first_match([(category == name, intent) for name, intent in K.EVIDENCE_INTENT.items()], None)
    matching = F.filter(pool, lambda call: call.getField("primary_intent") == wanted)
    chosen = F.when(F.size(matching) > 0, matching).otherwise(pool)
    ids = F.transform(F.slice(chosen, 1, k), lambda call: call.getField("transcript_id"))
    return F.coalesce(ids, F.array().cast("array<string>"))


def evidence_calls(risk: DataFrame, insights: DataFrame, as_of: dt.date, k: int = 3) -> DataFrame:
    """Evidence ids per customer for the category its risk row leads to."""
    return (risk.select("customer_id", action_category().alias("action_category"))
            .join(evidence_pool(insights, as_of, k), "customer_id", "left")
            .select("customer_id", "action_category",
                    cited_calls(F.col("action_category"), F.col("recent_calls"), k).alias("evidence")))


def next_best_actions(risk: DataFrame, insights: DataFrame, as_of: dt.date, wording: K.Wording = K.DEFAULT_WORDING,
                      generated_at: dt.datetime | None = None) -> DataFrame:
    """The 24-column action table, one row per customer."""
    category = F.col("action_category")
    return (
        risk.withColumn("action_category", action_category())
        .join(evidence_pool(insights, as_of), "customer_id", "left")
        .select(
            "customer_id", "full_name", "segment", "city", "product_lines", "total_annual_premium",
            "next_renewal_policy_id", "next_renewal_product", "next_renewal_date", "days_to_renewal", "risk_score",
            "risk_band", "risk_drivers", "expected_premium_loss", churn.premium_at_risk().alias("premium_at_risk"),
            "action_category", action_text(category, wording).alias("action"),
            action_reason(category, F.col("risk_drivers")).alias("reason"),
            cited_calls(category, F.col("recent_calls")).alias("evidence"),
            customer_message(category, wording).alias("customer_message"),
            F.col("preferred_channel").alias("channel"), category.alias("rule_category"),
            F.lit(GENERATED_BY).alias("generated_by"), moment(generated_at).alias("generated_at")))


def enrichment_queue(risk: DataFrame, done: DataFrame, per_run: int = 50, cap: int = 150) -> DataFrame:
    """Next customers to send for a written action: riskiest first, `per_run` at a time, `cap` over all runs."""
    order = [F.desc("risk_score"), F.asc("customer_id")]
    wanted = (risk.where(F.col("risk_band").isin("High", "Medium") | (F.col("n_upsell_interest_180d") > 0))
              .select("customer_id", "risk_score", "risk_band")
              .join(done.select("customer_id"), "customer_id", "left_anti")
              .orderBy(*order).limit(per_run))
    used = done.select(F.count_distinct("customer_id")).scalar()
    nth = F.row_number().over(Window.orderBy(*order))  # over at most `per_run` rows
    return wanted.withColumn("queue_no", nth).where(F.col("queue_no") <= F.lit(cap) - used)


def cited_calls_in_words(nba: DataFrame, transcripts: DataFrame, as_of: dt.date, wording: K.Wording = K.DEFAULT_WORDING,
                         days: int | None = 180) -> DataFrame:
    """(customer_id, position, transcript_id, call_ts, primary_intent, sentiment_score, summary) of the calls cited.

    Only calls that are cited are summarised: the raw calls of the last `days` days (None: all, for evidence that a model
    chose) are cut down to the cited ids before any text is read.
    """
    cited = evidence_rows(nba)
    calls = since(transcripts, as_of, days) if days else transcripts
    wanted = calls.join(cited.select("transcript_id").distinct(), "transcript_id", "left_semi")
    told = interaction_insights(wanted, wording).select(
        "transcript_id", "call_ts", "primary_intent", "sentiment_score", "summary")
    return cited.join(told, "transcript_id").select(
        "customer_id", "position", "transcript_id", "call_ts", "primary_intent", "sentiment_score", "summary")


def grounding_context(nba: DataFrame, c360: DataFrame, cited: DataFrame) -> DataFrame:
    """One text per customer for a writer to work from: profile, signals, drivers and the cited calls in words."""
    call_line = F.concat_ws(
        " | ", "transcript_id", F.date_format("call_ts", "yyyy-MM-dd"), "primary_intent", fixed(
            F.col("sentiment_score"), 2), "summary")
    calls = cited.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", call_line.alias("line")))).alias("calls"))
    drivers = F.array_join(F.transform(churn.drivers_ranked(F.col("risk_drivers")), lambda d: F.concat(
        d.getField("factor"), F.lit(" "), fixed(d.getField("points"), 1), F.lit(" ("), d.getField("detail"),
        F.lit(")"))), "; ")
    extra = c360.select("customer_id", "tenure_years", "n_active_policies", "n_open_claims", "n_late_12m",
                        "n_missed_12m", "n_calls_180d", "avg_sentiment_90d")
    joined = nba.join(extra, "customer_id").join(calls, "customer_id", "left")
    text = F.concat_ws(
        "\n",
        F.concat_ws(" | ", F.lit("CUSTOMER"), "customer_id", "full_name", "segment", "city", "product_lines",
                    F.concat(F.col("tenure_years").cast("string"), F.lit(" years"))),
        F.concat_ws(" | ", F.lit("SIGNALS"),
                    F.concat(F.lit("premium "), F.col("total_annual_premium").cast("string")),
                    F.concat(F.lit("active policies "), F.col("n_active_policies").cast("string")),
                    F.concat(F.lit("open claims "), F.col("n_open_claims").cast("string")),
                    F.concat(F.lit("late "), F.col("n_late_12m").cast("string")),
                    F.concat(F.lit("missed "), F.col("n_missed_12m").cast("string")),
                    F.concat(F.lit("calls "), F.col("n_calls_180d").cast("string")),
                    F.concat(F.lit("sentiment "), fixed(F.col("avg_sentiment_90d"), 2))),
        F.concat(F.lit("RISK | "), fixed(F.col("risk_score"), 1), F.lit(" "), F.col("risk_band"), F.lit(" | "),
                 drivers),
        F.concat_ws(" | ", F.lit("RULE"), "rule_category", "action"),
        F.concat(F.lit("CALLS | "), F.array_join(
            F.transform("calls", lambda c: c.getField("line")), "\n")))
    return joined.select("customer_id", text.alias("context"))


def evidence_rows(nba: DataFrame) -> DataFrame:
    return nba.select("customer_id", F.posexplode("evidence").alias("position", "transcript_id"))


def apply_model_response(nba: DataFrame, responses: DataFrame, insights: DataFrame,
                         generated_by: str = "model") -> DataFrame:
    """Overlay written answers on the rule-engine rows.

    `responses` holds (customer_id, response) and, if answers can repeat, responded_at. The outermost braces are read as
    JSON; an answer that does not parse leaves the row as it was. Of several that do, the latest counts, and of those at
    one time the largest text, so a customer keeps one row. Cited ids must be calls of that same customer; the others are
    removed.
    """
    parsed = responses.withColumn("r", F.from_json(F.regexp_extract("response", r"(?s)\{.*\}", 0), RESPONSE))
    parsed = parsed.where(F.coalesce("r.action", "r.reason", "r.customer_message", "r.channel").isNotNull()
                          | F.col("r.evidence").isNotNull())
    order = [c for c in ("responded_at", "response") if c in responses.columns]
    parsed = parsed.groupBy("customer_id").agg(F.max_by("r", F.struct(*order)).alias("r"))
    claimed = parsed.select("customer_id", F.posexplode("r.evidence").alias("position", "transcript_id"))
    owned = (claimed.join(insights.select("customer_id", "transcript_id"), ["customer_id", "transcript_id"], "left_semi")
             .groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("position", "transcript_id")))
                                         .alias("owned")))
    overlay = parsed.join(owned, "customer_id", "left").select(
        "customer_id", "r", F.transform("owned", lambda c: c.getField("transcript_id")).alias("owned_ids"))
    joined = nba.join(overlay, "customer_id", "left")
    changed = {
        "action_category": F.when(F.col("r.action_category").isin(*K.ACTION_TEXT), F.col("r.action_category")),
        "action": F.col("r.action"),
        "reason": F.col("r.reason"),
        "evidence": F.when(F.col("r.evidence").isNotNull(),
                           F.coalesce("owned_ids", F.array().cast("array<string>"))),
        "customer_message": F.col("r.customer_message"),
        "channel": F.col("r.channel"),
        "generated_by": F.when(F.col("r").isNotNull(), F.lit(generated_by)),
    }
    return joined.select(*[
        F.coalesce(changed[name], F.col(name)).alias(name) if name in changed else F.col(name) for name in nba.columns])


def rule_vs_final(nba: DataFrame) -> DataFrame:
    """How often the final category is the rule engine's, per generator."""
    agrees = F.count_if(F.col("rule_category") == F.col("action_category"))
    return nba.groupBy("generated_by").agg(
        F.count("*").alias("n_actions"), agrees.alias("n_agree"),
        ratio(agrees, F.count("*")).alias("agreement"))
