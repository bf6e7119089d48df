"""Named dimensions, facts and metrics over three logical tables: c360, nba (both one row per customer) and ins (calls)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: dimension -> (logical table, expression, synonyms) ---------------------------
DIMENSIONS = {
    "cust_id": ("c360", "customer_id", ("customer id", "customer number", "client id")),
    "customer_name": ("c360", "full_name", ("name", "policyholder name", "client name")),
    "customer_city": ("c360", "city", ("city", "location")),
    "customer_state": ("c360", "state", ("state", "region")),
    "customer_city_tier": ("c360", "city_tier", ()),
    "customer_segment": ("c360", "segment", ("segment", "customer type")),
    "income_band": ("c360", "annual_income_band", ()),
    "customer_age": ("c360", "age", ()),
    "customer_tenure_years": ("c360", "tenure_years", ("tenure", "years with us", "vintage")),
    "contact_channel": ("c360", "preferred_channel", ("contact channel", "channel preference")),
    "contact_language": ("c360", "preferred_language", ()),
    "product_mix": ("c360", "product_lines", ("products", "product mix", "lines of business")),
    "has_health_policy": ("c360", "has_health = 1", ("health policyholder", "health customer")),
    "has_life_policy": ("c360", "has_life = 1", ()),
    "has_motor_policy": ("c360", "has_motor = 1", ()),
    "has_home_policy": ("c360", "has_home = 1", ()),
    "renewal_product": ("c360", "next_renewal_product", ("renewing product", "next renewal product")),
    "renewal_policy_id": ("c360", "next_renewal_policy_id", ()),
    "renewal_date": ("c360", "next_renewal_date", ("renewal date", "due date", "expiry date")),
    "days_until_renewal": ("c360", "days_to_renewal", ("days left", "days until renewal")),
    "last_call_intent": ("c360", "last_intent", ()),
    "churn_risk_band": ("nba", "risk_band", ("churn risk band", "risk level", "risk category")),
    "nba_category": ("nba", "action_category", ("play", "action type", "NBA category")),
    "recommended_action": ("nba", "action", ("next best action", "recommendation", "what to do")),
    "action_reason": ("nba", "reason", ("why", "reason", "rationale")),
    "evidence_transcripts": ("nba", "array_join(evidence, ', ')", ("evidence", "source calls", "citations")),
    "suggested_message": ("nba", "customer_message", ()),
    "outreach_channel": ("nba", "channel", ()),
    "action_source": ("nba", "generated_by", ()),
    "call_transcript_id": ("ins", "transcript_id", ("call id", "transcript", "evidence id")),
    "call_date": ("ins", "CAST(call_ts AS DATE)", ("call date", "date of call")),
    "call_policy_id": ("ins", "policy_id", ()),
    "call_intent": ("ins", "primary_intent", ("intent", "reason for call", "call reason", "topic")),
    "call_sentiment": ("ins", "sentiment_label", ("sentiment", "mood", "tone")),
    "call_summary": ("ins", "summary", ("summary", "call notes")),
}

# --- fixed values: fact -> (logical table, column, synonyms) -------------------------------------
FACTS = {
    "annual_premium_inr": ("c360", "total_annual_premium", ("premium", "annual premium", "GWP")),
    "sum_insured_inr": ("c360", "total_sum_insured", ()),
    "renewal_premium_inr": ("c360", "next_renewal_premium", ()),
    "settlement_days": ("c360", "avg_days_to_settle", ()),
    "claims_count": ("c360", "n_claims", ()),
    "open_claims_count": ("c360", "n_open_claims", ()),
    "late_payments_12m": ("c360", "n_late_12m", ()),
    "missed_payments_12m": ("c360", "n_missed_12m", ()),
    "risk_points": ("nba", "risk_score", ()),
    "premium_at_risk_inr": ("nba", "premium_at_risk", ()),
    "expected_loss_inr": ("nba", "expected_premium_loss", ()),
    "sentiment": ("ins", "sentiment_score", ()),
}

# --- fixed values: metric -> (logical table, aggregate, synonyms) --------------------------------
METRICS = {
    "customer_count": ("c360", "count(customer_id)", ("number of customers", "customers", "headcount")),
    "book_premium": ("c360", "sum(total_annual_premium)", ("total premium", "book size", "GWP")),
    "avg_claim_settlement_days": ("c360", "avg(avg_days_to_settle)", (
        "claim settlement days", "time to settle", "TAT", "claim turnaround")),
    "open_claims": ("c360", "sum(n_open_claims)", ()),
    "renewals_due_30d": ("c360", "count_if(days_to_renewal BETWEEN 0 AND 30)", (
        "renewals due this month", "upcoming renewals", "renewals in 30 days")),
    "renewal_premium_due_30d": ("c360", "sum(if(days_to_renewal BETWEEN 0 AND 30, next_renewal_premium, 0))", ()),
    "churn_rate": ("nba", "count_if(risk_band = 'High') / nullif(count(customer_id), 0)", (
        "churn risk rate", "high risk share", "percent at risk", "attrition risk")),
    "high_risk_customers": ("nba", "count_if(risk_band = 'High')", ("at-risk customers", "customers at risk")),
    "avg_risk_score": ("nba", "avg(risk_score)", ()),
    "at_risk_premium": ("nba", "sum(premium_at_risk)", ("revenue at risk", "premium at stake", "at-risk premium")),
    "expected_loss": ("nba", "sum(expected_premium_loss)", ("expected loss", "risk-weighted premium")),
    "call_count": ("ins", "count(transcript_id)", ("number of calls", "call volume", "interactions")),
    "avg_sentiment": ("ins", "avg(sentiment_score)", ("average sentiment", "sentiment score", "customer mood")),
    "negative_call_share": ("ins", "count_if(sentiment_label = 'negative') / nullif(count(transcript_id), 0)", ()),
    "cancellation_calls": ("ins", "count_if(primary_intent = 'cancellation_intent')", (
        "porting calls", "cancel requests")),
}
COUNTS = ("customer_count", "renewals_due_30d", "high_risk_customers", "call_count", "cancellation_calls")

# --- fixed values: synonyms of the logical tables -------------------------------------------------
TABLE_SYNONYMS = {
    "c360": ("customers", "policyholders", "customer 360", "insured"),
    "nba": ("churn risk", "next best action", "retention recommendations"),
    "ins": ("calls", "call transcripts", "interactions", "conversations", "call centre"),
}
# what calls are summed to before they meet customers, and the metrics over calls made from these sums
CALL_SUMS = {
    "n_calls": "count(transcript_id)",
    "n_negative": "count_if(sentiment_label = 'negative')",
    "n_cancelling": "count_if(primary_intent = 'cancellation_intent')",
    "n_scored": "count(sentiment_score)",
    "sum_score": "sum(sentiment_score)",
}
FROM_CALL_SUMS = {
    "call_count": "coalesce(sum(n_calls), 0)",
    "avg_sentiment": "sum(sum_score) / nullif(sum(n_scored), 0)",
    "negative_call_share": "sum(n_negative) / nullif(sum(n_calls), 0)",
    "cancellation_calls": "coalesce(sum(n_cancelling), 0)",
}
KEYS = {"c360": "customer_id", "nba": "customer_id", "ins": "transcript_id"}


def semantic_dimensions(tables: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """Dimension columns by name, row by row, for names of one logical table."""
    (table,) = {DIMENSIONS[name][0] for name in names}
    return tables[table].select(*[F.expr(DIMENSIONS[name][1]).alias(name) for name in names])


def semantic_facts(tables: Mapping[str, DataFrame], table: str) -> DataFrame:
    """The row-level measures of one logical table under their business names."""
    facts = [F.expr(column).alias(name) for name, (owner, column, _) in FACTS.items() if owner == table]
    return tables[table].select(KEYS[table], *facts)


def _with_dimensions(tables: Mapping[str, DataFrame], base: str, names: Sequence[str],
                     only: Column | None) -> DataFrame:
    """Rows of one logical table with dimension columns of any table beside them, never multiplied.

    Calls that need dimensions of a customer are summed per customer and call dimension first, so that a busy caller is one
    row. Dimensions of the other customer table join one to one. Call dimensions on a customer table join the distinct
    (customer, values) pairs, so a customer counts once per value however many calls there are.
    """
    rows = tables[base]
    by_table: dict[str, list[str]] = {}
    for name in names:
        by_table.setdefault(DIMENSIONS[name][0], []).append(name)
    if base == "ins" and set(by_table) - {"ins"}:
        own = by_table.pop("ins", [])
        rows = rows.groupBy("customer_id", *[F.expr(DIMENSIONS[name][1]).alias(name) for name in own]).agg(
            *[F.expr(total).alias(name) for name, total in CALL_SUMS.items()])
    for table, wanted in by_table.items():
        columns = [F.expr(DIMENSIONS[name][1]).alias(name) for name in wanted]
        if table == base:
            rows = rows.withColumns({name: F.expr(DIMENSIONS[name][1]) for name in wanted})
            continue
        other = tables[table].select("customer_id", *columns)
        if table == "ins":
            other = other.distinct()
        rows = rows.join(other, "customer_id", "inner" if table == "ins" else "left")
    return rows if only is None else rows.where(only)


def semantic_query(tables: Mapping[str, DataFrame], dimensions: Sequence[str], metrics: Sequence[str],
                   where: Mapping[str, object] | None = None) -> DataFrame:
    """Metrics by dimensions, both by name.

    Each logical table is reduced to the dimension values first; the reduced tables are then stacked and merged with
    one more grouping, which treats null dimension values as equal. `where` maps dimensions to a value or a list.
    """
    where = where or {}
    needed = list(dict.fromkeys([*dimensions, *where]))
    only = None
    for name, value in where.items():
        test = F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value)
        only = test if only is None else only & test
    parts = []
    for table in dict.fromkeys(METRICS[m][0] for m in metrics):
        own = [m for m in metrics if METRICS[m][0] == table]
        rows = _with_dimensions(tables, table, needed, only)
        made = FROM_CALL_SUMS if "n_calls" in rows.columns else {m: METRICS[m][1] for m in own}
        parts.append(rows.groupBy(*dimensions).agg(*[F.expr(made[m]).alias(m) for m in own]))
    if len(parts) == 1:
        return parts[0].select(*dimensions, *metrics)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.groupBy(*dimensions).agg(*[
        (F.coalesce(F.max(m), F.lit(0)) if m in COUNTS else F.max(m)).alias(m) for m in metrics])
    return merged.select(*dimensions, *metrics)


def synonym_table(spark: SparkSession) -> DataFrame:
    """(synonym, kind, logical_table, name) for every registered word, names included."""
    rows = [(word.lower(), "table", table, table) for table, words in TABLE_SYNONYMS.items() for word in words]
    for kind, registry in (("dimension", DIMENSIONS), ("fact", FACTS), ("metric", METRICS)):
        for name, (table, _, words) in registry.items():
            rows += [(word.lower(), kind, table, name) for word in dict.fromkeys((name, name.replace("_", " "), *words))]
    return spark.createDataFrame(sorted(set(rows)), "synonym string, kind string, logical_table string, name string")


def semantic_synonyms(words: DataFrame) -> DataFrame:
    """Every registered thing that a business word (column `word`) can mean."""
    known = synonym_table(words.sparkSession)
    return words.join(F.broadcast(known), F.lower(F.trim("word")) == F.col("synonym")).select(
        "word", "kind", "logical_table", "name")
