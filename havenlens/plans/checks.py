"""Checking SQL: an independent statement of each query for a second engine over the same Parquet tables."""

from __future__ import annotations

import re

from havenlens import constants as K
from havenlens.plans import fixtures as fx


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(terms) -> str:
    return " + ".join(
        f"(length(lowered) - length(replace(lowered, {_quoted(t)}, ''))) / {len(t)}" for t in terms)


def _any(phrases) -> str:
    return "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in phrases)


def _text(template: str, **slots: str) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(slots[piece[1:-1]])
        elif piece:
            parts.append(_quoted(piece))
    return " || ".join(parts)


def _case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def f2(value: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"printf('%.{digits}f', round_even(({value}) * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE)"


def r(value: str, digits: int) -> str:
    scale = 10**digits
    return f"(round_even(({value}) * {scale}.0::DOUBLE, 0) / {scale}.0::DOUBLE)"


W = K.DEFAULT_WORDING
FIRST_POLICY = f"nullif(regexp_extract(transcript_text, '{fx.POLICY_PATTERN}', 0), '')"
FIRST_CLAIM = rf"nullif(regexp_extract(transcript_text, 'CLM-\d+', 0), '')"
AMOUNT = r"nullif(regexp_extract(customer_text, '₹([\d,]+)', 1), '')"
DAYS = r"nullif(regexp_extract(customer_text, '(\d+) days', 1), '')"
PERCENT = r"nullif(regexp_extract(customer_text, '(\d+) percent', 1), '')"
POLICY = f"coalesce({FIRST_POLICY}, 'their policy')"
S = K.SUMMARY
SUMMARY_SQL = _case([
    ("primary_intent = 'claim_issue' AND contains(customer_text, 'garage')",
     _text(S["claim_garage"], days=f"coalesce({DAYS}, 'several')", amount=f"coalesce({AMOUNT}, '—')")),
    ("primary_intent = 'claim_issue'", "replace(" + _text(
        S["claim"], claim=f"coalesce({FIRST_CLAIM}, '')", days=f"coalesce({DAYS}, 'many')",
        regulator=f"CASE WHEN contains(customer_text, 'IRDAI') THEN {_quoted(S['claim_regulator'])} ELSE '' END")
     + ", '  ', ' ')"),
    ("primary_intent = 'cancellation_intent' AND contains(lowered, 'port')", _text(S["port"], policy=POLICY)),
    ("primary_intent = 'cancellation_intent'", _text(S["cancel"], policy=POLICY,
                                                    amount=f"coalesce({AMOUNT}, 'lower')")),
    ("primary_intent = 'price_concern' AND contains(customer_text, 'percent')", _text(
        S["price_percent"], percent=f"coalesce({PERCENT}, '')", policy=POLICY, amount=f"coalesce({AMOUNT}, '')")),
    ("primary_intent = 'price_concern'", _text(S["price"], brand=_quoted(W.brand))),
    ("primary_intent = 'upsell_interest' AND contains(customer_text, 'baby')", _text(S["upsell_baby"])),
    ("primary_intent = 'upsell_interest'", _text(S["upsell"], home_plan=_quoted(W.home_plan))),
    (f"primary_intent = 'service_praise' AND {FIRST_CLAIM} IS NOT NULL", _text(
        S["praise_claim"], brand=_quoted(W.brand), claim=FIRST_CLAIM)),
    ("primary_intent = 'service_praise'", _text(S["praise"])),
    ("contains(customer_text, 'address')", _text(S["address"])),
    ("contains(customer_text, 'certificate')", _text(S["certificate"], policy=POLICY)),
], _text(S["general"], policy=POLICY))

OFFER = ("CASE WHEN has_health = 0 THEN 'Health Shield Family Floater' WHEN has_life = 0 THEN 'Term Secure life cover' "
         "WHEN has_home = 0 THEN 'Home Protect' ELSE 'Super Top-Up health cover' END")
MESSAGE_SLOTS = dict(
    first="split_part(trim(full_name), ' ', 1)", brand=_quoted(W.brand),
    policy="coalesce(next_renewal_policy_id, 'your policy')", product="coalesce(next_renewal_product, 'insurance')",
    renews="coalesce(strftime(next_renewal_date, '%d %b'), '')", offer=OFFER)
ACTION_SQL = _case([(f"action_category = '{c}'", _text(t, **MESSAGE_SLOTS)) for c, t in K.ACTION_TEXT.items()], "NULL")
MESSAGE_SQL = _case([(f"action_category = '{c}'", _text(t, **MESSAGE_SLOTS)) for c, t in K.CUSTOMER_MESSAGE.items()],
                    "NULL")

ZERO = set(K.ZERO_FILLED)


def _filled(names: str) -> str:
    return ", ".join(f"coalesce({n}, 0) AS {n}" if n in ZERO else n for n in names.split())


STEPS = {name: fx.check_sql(name) for name in fx.VIEWS}
STEPS |= {
    "said": """SELECT *, lower(customer_text) AS lowered FROM (SELECT *, array_to_string(list_transform(list_filter(
 list_transform(string_split(transcript_text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, 'Customer:')),
 lambda x: trim(substr(x, 10))), ' ') AS customer_text FROM call_transcripts) s""",
    "scored": f"""SELECT *, round_even(greatest(-0.95::DOUBLE, least(0.95::DOUBLE,
 (p - 1.3::DOUBLE * n) / (p + n + 1.5::DOUBLE))) * 1000, 0) / 1000 AS sentiment_score,
 CASE WHEN regexp_matches(lowered, '{K.CANCELLATION_WHOLE_WORDS}|{_any(K.CANCELLATION_PHRASES)}') THEN 'cancellation_intent'
  WHEN (contains(lowered, 'claim') AND regexp_matches(lowered, '{_any(K.CLAIM_TROUBLE_PHRASES)}'))
   OR contains(lowered, 'garage') THEN 'claim_issue'
  WHEN regexp_matches(lowered, '{_any(K.PRICE_PHRASES)}') THEN 'price_concern'
  WHEN regexp_matches(lowered, '{_any(K.UPSELL_PHRASES)}') THEN 'upsell_interest'
  WHEN regexp_matches(lowered, '{_any(K.PRAISE_PHRASES)}') THEN 'service_praise' ELSE 'general_service' END AS primary_intent
 FROM (SELECT *, {_hits(K.POSITIVE_TERMS)} AS p, {_hits(K.NEGATIVE_TERMS)} AS n FROM said) h""",
    "insights": f"""SELECT transcript_id, customer_id, policy_id, call_ts, agent_id, customer_text, sentiment_score,
 CASE WHEN sentiment_score <= -0.25 THEN 'negative' WHEN sentiment_score >= 0.25 THEN 'positive' ELSE 'neutral' END
 AS sentiment_label, primary_intent, {SUMMARY_SQL} AS summary, transcript_text,
 'rules (lexicon sentiment + keyword intent + template summary)' AS enriched_by,
 TIMESTAMP '2001-11-05 06:00:00' AS enriched_at FROM scored""",
    "soonest": """SELECT customer_id, policy_id AS next_renewal_policy_id, product_line AS next_renewal_product,
 plan_name AS next_renewal_plan, annual_premium AS next_renewal_premium, renewal_date AS next_renewal_date,
 CAST(date_diff('day', DATE '2001-11-05', renewal_date) AS INT) AS days_to_renewal
 FROM policies WHERE status <> 'Lapsed'
 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY renewal_date, policy_id) = 1""",
    "pol_roll": """SELECT customer_id,
 count(*) FILTER (status IN ('Active', 'Grace Period', 'Cancellation Requested')) AS n_active_policies,
 string_agg(DISTINCT product_line, ', ' ORDER BY product_line) AS product_lines,
 CAST(sum(annual_premium) FILTER (status <> 'Lapsed') AS BIGINT) AS total_annual_premium,
 CAST(sum(sum_insured) AS BIGINT) AS total_sum_insured,
 CAST(max(CASE WHEN product_line = 'Health' THEN 1 ELSE 0 END) AS INT) AS has_health,
 CAST(max(CASE WHEN product_line = 'Life' THEN 1 ELSE 0 END) AS INT) AS has_life,
 CAST(max(CASE WHEN product_line = 'Motor' THEN 1 ELSE 0 END) AS INT) AS has_motor,
 CAST(max(CASE WHEN product_line = 'Home' THEN 1 ELSE 0 END) AS INT) AS has_home,
 count(*) FILTER (status = 'Cancellation Requested') AS n_cancel_requests,
 count(*) FILTER (status = 'Grace Period') AS n_in_grace FROM policies GROUP BY customer_id""",
    "claims_roll": f"""SELECT customer_id, count(*) AS n_claims,
 count(*) FILTER (status IN ('Pending', 'Under Review')) AS n_open_claims,
 count(*) FILTER (status = 'Rejected') AS n_rejected_claims,
 count(*) FILTER ((status = 'Settled' AND days_to_settle > 30) OR (status IN ('Pending', 'Under Review')
  AND days_open > 30)) AS n_slow_claims,
 CAST(sum(claim_amount) AS BIGINT) AS total_claimed, CAST(coalesce(sum(approved_amount), 0) AS BIGINT) AS total_approved,
 {r("avg(days_to_settle)", 1)} AS avg_days_to_settle,
 max(days_open) FILTER (status IN ('Pending', 'Under Review')) AS max_open_claim_days
 FROM claims WHERE claim_date >= DATE '2001-11-05' - INTERVAL 18 MONTH GROUP BY customer_id""",
    "payments_roll": f"""SELECT customer_id, count(*) AS n_payments_due_12m,
 count(*) FILTER (payment_status = 'Late') AS n_late_12m, count(*) FILTER (payment_status = 'Missed') AS n_missed_12m,
 {r("count(*) FILTER (payment_status = 'On-time') / count(*)", 3)} AS on_time_rate_12m,
 {r("avg(days_late) FILTER (payment_status = 'Late')", 1)} AS avg_days_late
 FROM payments WHERE due_date >= DATE '2001-11-05' - INTERVAL 12 MONTH GROUP BY customer_id""",
    "calls_roll": """SELECT customer_id, count(*) AS n_calls_180d, max(call_ts) AS last_call_ts,
 CAST(floor(sum(duration_sec) / 60) AS BIGINT) AS call_minutes_180d
 FROM call_transcripts WHERE call_ts >= TIMESTAMP '2001-11-05' - INTERVAL 180 DAY GROUP BY customer_id""",
    "recent": """SELECT *, call_ts >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY AS in_90d FROM insights
 WHERE call_ts >= TIMESTAMP '2001-11-05' - INTERVAL 180 DAY""",
    "ai": """SELECT customer_id,
 round_even(CAST(sum(CAST(round(sentiment_score * 1000) AS BIGINT)) FILTER (in_90d) AS DOUBLE) /
  nullif(count(*) FILTER (in_90d), 0), 0) / 1000 AS avg_sentiment_90d,
 round_even(CAST(sum(CAST(round(sentiment_score * 1000) AS BIGINT)) AS DOUBLE) / count(*), 0) / 1000
  AS avg_sentiment_180d,
 arg_max(sentiment_score, strftime(call_ts, '%Y-%m-%d %H:%M:%S') || transcript_id) AS last_sentiment,
 arg_max(primary_intent, strftime(call_ts, '%Y-%m-%d %H:%M:%S') || transcript_id) AS last_intent,
 count(*) FILTER (in_90d AND primary_intent = 'cancellation_intent') AS n_cancel_intent_90d,
 count(*) FILTER (primary_intent = 'cancellation_intent') AS n_cancel_intent_180d,
 count(*) FILTER (in_90d AND primary_intent = 'price_concern') AS n_price_concern_90d,
 count(*) FILTER (in_90d AND primary_intent = 'claim_issue') AS n_claim_issue_90d,
 count(*) FILTER (primary_intent = 'upsell_interest') AS n_upsell_interest_180d,
 count(*) FILTER (primary_intent = 'service_praise') AS n_service_praise_180d, true AS has_ai_insights
 FROM recent GROUP BY customer_id""",
}
PROFILE = ("full_name gender age city state city_tier segment annual_income_band customer_since tenure_years "
           "preferred_channel preferred_language email mobile_masked kyc_status")
WIDE = ("n_active_policies product_lines total_annual_premium total_sum_insured has_health has_life has_motor has_home "
        "n_cancel_requests n_in_grace next_renewal_policy_id next_renewal_product next_renewal_plan next_renewal_premium "
        "next_renewal_date days_to_renewal n_claims n_open_claims n_rejected_claims n_slow_claims total_claimed "
        "total_approved avg_days_to_settle max_open_claim_days n_payments_due_12m n_late_12m n_missed_12m "
        "on_time_rate_12m avg_days_late n_calls_180d last_call_ts call_minutes_180d avg_sentiment_90d avg_sentiment_180d "
        "last_sentiment last_intent n_cancel_intent_90d n_cancel_intent_180d n_price_concern_90d n_claim_issue_90d "
        "n_upsell_interest_180d n_service_praise_180d")
STEPS |= {
    "c360": f"""SELECT customer_id, {PROFILE.replace(' ', ', ')}, {_filled(WIDE)},
 coalesce(has_ai_insights, false) AS has_ai_insights FROM customers LEFT JOIN pol_roll USING (customer_id)
 LEFT JOIN soonest USING (customer_id) LEFT JOIN claims_roll USING (customer_id)
 LEFT JOIN payments_roll USING (customer_id) LEFT JOIN calls_roll USING (customer_id)
 LEFT JOIN ai USING (customer_id)""",
    "points": """SELECT *,
 round_even(25::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE,
  0.25::DOUBLE - coalesce(avg_sentiment_90d, avg_sentiment_180d, 0.25::DOUBLE))) * 10, 0) / 10 AS p_sentiment,
 CAST(CASE WHEN n_cancel_intent_90d > 0 THEN 20 WHEN n_cancel_intent_180d > 0 THEN 8 ELSE 0 END AS DOUBLE) AS p_cancel,
 CAST(CASE WHEN n_price_concern_90d > 0 THEN 10 ELSE 0 END AS DOUBLE) AS p_price,
 round_even(15::DOUBLE * least(1::DOUBLE, (n_late_12m + 2 * n_missed_12m) / 4) * 10, 0) / 10 AS p_payment,
 round_even(15::DOUBLE * least(1::DOUBLE, (n_slow_claims + n_rejected_claims) / 2) * 10, 0) / 10 AS p_claims,
 CAST(CASE WHEN days_to_renewal <= 30 THEN 15 WHEN days_to_renewal <= 60 THEN 10 WHEN days_to_renewal <= 90 THEN 5
  ELSE 0 END AS DOUBLE) AS p_renewal,
 CAST(CASE WHEN tenure_years >= 8 THEN -5 ELSE 0 END AS DOUBLE) AS p_loyalty,
 CAST(CASE WHEN n_service_praise_180d > 0 THEN -5 ELSE 0 END AS DOUBLE) AS p_advocacy FROM c360""",
    "risk": """SELECT *, round_even(total_annual_premium * risk_score / 100, 0) AS expected_premium_loss FROM (
 SELECT *, CASE WHEN risk_score >= 55 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_band FROM (
 SELECT *, round_even(greatest(0::DOUBLE, least(100::DOUBLE, p_sentiment + p_cancel + p_price + p_payment + p_claims
  + p_renewal + p_loyalty + p_advocacy)) * 10, 0) / 10 AS risk_score FROM points) a) b""",
    "drivers": f"""SELECT customer_id, pos, factor, points, detail FROM (
 SELECT customer_id, 0 AS pos, 'Negative sentiment' AS factor, p_sentiment AS points, 'Avg customer sentiment ' ||
  {f2("coalesce(avg_sentiment_90d, avg_sentiment_180d)")} || ' (90d)' AS detail FROM risk
 UNION ALL SELECT customer_id, 1, 'Cancellation / porting intent', p_cancel,
  n_cancel_intent_180d || ' call(s) mentioning cancel/port' FROM risk
 UNION ALL SELECT customer_id, 2, 'Price sensitivity', p_price, n_price_concern_90d || ' price-concern call(s) in 90d'
  FROM risk
 UNION ALL SELECT customer_id, 3, 'Payment stress', p_payment, n_late_12m || ' late, ' || n_missed_12m ||
  ' missed payments (12m)' FROM risk
 UNION ALL SELECT customer_id, 4, 'Claim friction', p_claims, n_slow_claims || ' slow/open >30d, ' || n_rejected_claims
  || ' rejected' FROM risk
 UNION ALL SELECT customer_id, 5, 'Renewal due soon', p_renewal, next_renewal_product || ' renewal in ' ||
  days_to_renewal || ' days' FROM risk
 UNION ALL SELECT customer_id, 6, 'Long tenure (protective)', p_loyalty, tenure_years || ' years with {W.brand}' FROM risk
 UNION ALL SELECT customer_id, 7, 'Recent praise (protective)', p_advocacy, 'Service-praise call in last 180d' FROM risk
 ) d WHERE points <> 0""",
    "driver_text": f"""SELECT customer_id,
 string_agg(factor || ' ' || {f2("points", 1)} || ' (' || detail || ')', '; ' ORDER BY pos) AS drivers,
 string_agg(factor || ' ' || {f2("points", 1)} || ' (' || detail || ')', '; ' ORDER BY points DESC, pos) AS ranked
 FROM drivers GROUP BY customer_id""",
    "top_text": f"""SELECT customer_id, string_agg(factor, '; ' ORDER BY nth) FILTER (nth <= 2) AS top_two,
 string_agg(factor, '; ' ORDER BY nth) FILTER (nth <= 3) AS top_three,
 string_agg(factor || ' +' || {f2("points", 0)}, ' · ' ORDER BY nth) FILTER (nth <= 3) AS top_three_points,
 string_agg(factor || ' (+' || {f2("points", 0)} || ')', ', ' ORDER BY nth) FILTER (nth <= 3) AS top_three_listed
 FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY points DESC, pos) AS nth FROM drivers
 WHERE points > 0) t GROUP BY customer_id""",
    "categorised": """SELECT *, CASE
 WHEN p_cancel >= 20 OR (risk_band = 'High' AND p_cancel > 0) THEN 'RETENTION_CALL'
 WHEN p_claims >= 7.5 AND n_open_claims > 0 THEN 'CLAIM_ESCALATION' WHEN p_price > 0 THEN 'PRICE_MATCH'
 WHEN p_payment >= 7.5 THEN 'PAYMENT_FLEX' WHEN p_claims >= 7.5 THEN 'CLAIM_ESCALATION'
 WHEN days_to_renewal <= 30 THEN 'RENEWAL_NUDGE'
 WHEN risk_band = 'Low' AND (n_upsell_interest_180d > 0 OR n_active_policies <= 2) THEN 'CROSS_SELL'
 WHEN risk_band = 'Low' AND n_service_praise_180d > 0 THEN 'ADVOCACY' WHEN days_to_renewal <= 60 THEN 'RENEWAL_NUDGE'
 ELSE 'NURTURE' END AS action_category FROM risk""",
    "evidence": """SELECT customer_id, transcript_id, nth FROM (
 SELECT c.customer_id, r.transcript_id, r.matches,
  max(CAST(r.matches AS INT)) OVER (PARTITION BY c.customer_id) AS any_match,
  row_number() OVER (PARTITION BY c.customer_id, r.matches ORDER BY r.call_ts DESC, r.transcript_id DESC) AS nth_in,
  row_number() OVER (PARTITION BY c.customer_id ORDER BY r.call_ts DESC, r.transcript_id DESC) AS nth_any,
  CASE WHEN max(CAST(r.matches AS INT)) OVER (PARTITION BY c.customer_id) = 1 THEN
   CASE WHEN r.matches THEN row_number() OVER (PARTITION BY c.customer_id, r.matches
    ORDER BY r.call_ts DESC, r.transcript_id DESC) END
   ELSE row_number() OVER (PARTITION BY c.customer_id ORDER BY r.call_ts DESC, r.transcript_id DESC) END AS nth
 FROM categorised c JOIN (
  SELECT k.customer_id, k.transcript_id, k.call_ts, coalesce(k.primary_intent = CASE g.action_category
   WHEN 'RETENTION_CALL' THEN 'cancellation_intent' WHEN 'CLAIM_ESCALATION' THEN 'claim_issue'
   WHEN 'PRICE_MATCH' THEN 'price_concern' WHEN 'CROSS_SELL' THEN 'upsell_interest'
   WHEN 'ADVOCACY' THEN 'service_praise' END, false) AS matches
  FROM recent k JOIN categorised g USING (customer_id)) r USING (customer_id)) e WHERE nth <= 3""",
    "evidence_text": """SELECT customer_id, string_agg(transcript_id, ',' ORDER BY nth) AS evidence
 FROM evidence GROUP BY customer_id""",
    "nba": f"""SELECT customer_id, full_name, segment, city, product_lines, total_annual_premium, next_renewal_policy_id,
 next_renewal_product, next_renewal_date, days_to_renewal, risk_score, risk_band, coalesce(drivers, '') AS risk_drivers,
 expected_premium_loss, CASE WHEN risk_band = 'High' THEN total_annual_premium ELSE 0 END AS premium_at_risk,
 action_category, {ACTION_SQL} AS action,
 'Rule engine: ' || action_category || ' — top drivers: ' || coalesce(top_two, 'none') AS reason,
 coalesce(evidence, '') AS evidence, {MESSAGE_SQL} AS customer_message, preferred_channel AS channel,
 action_category AS rule_category, 'rule engine' AS generated_by, TIMESTAMP '2001-11-05 06:00:00' AS generated_at
 FROM categorised LEFT JOIN driver_text USING (customer_id) LEFT JOIN top_text USING (customer_id)
 LEFT JOIN evidence_text USING (customer_id)""",
    "status": """SELECT customer_id, action_category, action, status, agent, ts, note FROM action_log
 WHERE status IN ('Accepted', 'Rejected', 'Done')
 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, log_id DESC) = 1""",
}


def with_steps(final: str) -> str:
    """The final SELECT with just the steps it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(STEPS[name])

    visit(final)
    steps = ",\n".join(f"{name} AS (\n{STEPS[name]})" for name in STEPS if name in needed)
    final = final.strip()
    if not steps:
        return final
    return f"WITH {steps},\n{final[5:]}" if final.startswith("WITH ") else f"WITH {steps}\n{final}"
