"""Views that present the test tables as an insurer's five sources.

One SQL text per view serves Spark and the checking engine; `{…}` slots name the input tables and the three spellings
that differ. Every view reads its whole input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from havenlens import schemas

AS_OF = dt.date(2001, 11, 5)
POLICY_PATTERN = r"P\d{15}"
CUSTOMER_PATTERN = r"\bc\d{12}\b"

VIEWS = {
    "customers": """
SELECT 'C' || lpad(CAST(c_custkey AS STRING), 12, '0') AS customer_id, c_name AS full_name,
 CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(21 + (c_custkey * 11) % 58 AS INT) AS age,
 n_name AS city, r_name AS state, CAST(1 + c_nationkey % 3 AS INT) AS city_tier, c_mktsegment AS segment,
 CASE WHEN c_acctbal < 0 THEN 'below 5' WHEN c_acctbal < 5000 THEN '5 to 15' ELSE 'above 15' END AS annual_income_band,
 CAST(DATE '2001-11-05' - CAST((c_custkey * 7) % 181 * 36 AS INT) AS DATE) AS customer_since,
 CAST(CAST((c_custkey * 7) % 181 AS DOUBLE) / 10 AS DECIMAL(4,1)) AS tenure_years,
 CASE c_custkey % 5 WHEN 0 THEN 'Phone' WHEN 1 THEN 'WhatsApp' WHEN 2 THEN 'Email' WHEN 3 THEN 'Mobile App'
  ELSE 'Branch' END AS preferred_channel,
 CASE c_custkey % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Hindi' ELSE 'Tamil' END AS preferred_language,
 'c' || CAST(c_custkey AS STRING) || '@example.org' AS email,
 'xxxxxx' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS mobile_masked,
 CASE WHEN c_custkey % 9 = 0 THEN 'Pending re-KYC' ELSE 'Verified' END AS kyc_status
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "policies": """
SELECT policy_id, customer_id, product_line, plan_name, sum_insured, annual_premium, payment_frequency, start_date,
 renewal_date,
 CASE WHEN k % 17 = 0 THEN 'Cancellation Requested' WHEN renewal_date >= DATE '2001-11-05' THEN 'Active'
  WHEN renewal_date >= DATE '2001-11-05' - 15 THEN 'Grace Period' ELSE 'Lapsed' END AS status
FROM (SELECT o_orderkey AS k, 'P' || lpad(CAST(o_orderkey AS STRING), 15, '0') AS policy_id,
 'C' || lpad(CAST(o_custkey AS STRING), 12, '0') AS customer_id,
 CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'Health' WHEN 1 THEN 'Motor' WHEN 2 THEN 'Life' ELSE 'Home' END
  AS product_line,
 o_orderpriority AS plan_name, CAST(round(o_totalprice * 20) AS BIGINT) AS sum_insured,
 CAST(round(o_totalprice) AS BIGINT) AS annual_premium,
 CASE o_orderkey % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Quarterly' ELSE 'Monthly' END AS payment_frequency,
 CAST(o_orderdate AS DATE) AS start_date,
 CASE WHEN o_orderstatus = 'F' THEN CAST(DATE '2001-11-05' - CAST(16 + o_orderkey % 300 AS INT) AS DATE)
  ELSE CAST(DATE '2001-11-05' + CAST((o_custkey * 53) % 330 + (o_orderkey * 37) % 56 - 20 AS INT) AS DATE) END
  AS renewal_date
 FROM {orders}) t""",
    "claims": """
SELECT claim_id, policy_id, customer_id, product_line, claim_date, claim_amount,
 CASE WHEN status = 'Settled' THEN CAST(round(claim_amount * (1 - disc)) AS BIGINT) END AS approved_amount, status,
 CASE WHEN status = 'Settled' THEN CAST(claim_date + dts AS DATE) END AS settled_date,
 CASE WHEN status = 'Settled' THEN dts END AS days_to_settle,
 CASE WHEN status = 'Settled' THEN dts ELSE open_days END AS days_open
FROM (SELECT 'CLM-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
  CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)
  || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS claim_id,
 'P' || lpad(CAST(l_orderkey AS STRING), 15, '0') AS policy_id,
 'C' || lpad(CAST(o_custkey AS STRING), 12, '0') AS customer_id,
 CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'Health' WHEN 1 THEN 'Motor' WHEN 2 THEN 'Life' ELSE 'Home' END
  AS product_line,
 CAST(l_shipdate AS DATE) AS claim_date, CAST(round(l_extendedprice) AS BIGINT) AS claim_amount, l_discount AS disc,
 CASE WHEN l_returnflag = 'R' AND l_partkey % 11 = 0 THEN 'Rejected'
  WHEN l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= DATE '2001-11-05' - 60
  THEN CASE WHEN l_partkey % 2 = 0 THEN 'Pending' ELSE 'Under Review' END ELSE 'Settled' END AS status,
 CAST(4 + (l_partkey * 7) % 31 AS INT) AS dts, {open_days} AS open_days
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N') t""",
    "payments": """
SELECT payment_id, policy_id, customer_id, due_date,
 CASE WHEN m = 0 THEN NULL WHEN m <= 3 THEN CAST(due_date + CAST(6 + k % 34 AS INT) AS DATE) ELSE due_date END
  AS paid_date,
 amount_due, CASE WHEN m = 0 THEN CAST(0 AS BIGINT) ELSE amount_due END AS amount_paid,
 CASE WHEN m = 0 THEN 'Missed' WHEN m <= 3 THEN 'Late' ELSE 'On-time' END AS payment_status,
 CASE WHEN m = 0 THEN NULL WHEN m <= 3 THEN CAST(6 + k % 34 AS INT) ELSE 0 END AS days_late
FROM (SELECT 'PAY-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
  CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)
  || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS payment_id,
 'P' || lpad(CAST(l_orderkey AS STRING), 15, '0') AS policy_id,
 'C' || lpad(CAST(o_custkey AS STRING), 12, '0') AS customer_id, CAST(l_shipdate AS DATE) AS due_date,
 CAST(round(l_extendedprice / 12) AS BIGINT) AS amount_due, l_suppkey % 13 AS m, l_partkey AS k
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'N') t""",
    "call_transcripts": """
SELECT 'T' || lpad(CAST(event_id AS STRING), 15, '0') AS transcript_id,
 'C' || lpad(CAST((event_id * 31 + user_id) % (SELECT count(*) FROM {customer}) AS STRING), 12, '0') AS customer_id,
 CASE WHEN event_type = 'view' THEN NULL ELSE 'P' || lpad(CAST(event_id AS STRING), 15, '0') END AS policy_id,
 CAST(DATE '2001-11-05' - CAST(1 + (event_id * 13) % 240 AS INT) AS {ts}) +
  INTERVAL '1' MINUTE * CAST(540 + (event_id * 7) % 660 AS INT) AS call_ts,
 CASE WHEN event_id % 4 = 0 THEN 'Outbound' ELSE 'Inbound' END AS direction, 'Phone' AS channel,
 'A' || CAST(event_id % 40 AS STRING) AS agent_id,
 CAST(60 + (event_id * 17) % 540 AS INT) AS duration_sec, 'English' AS language,
 'Agent: Thank you for calling, how may I help you today?' || chr(10) || 'Customer: ' ||
 CASE WHEN event_id % 14 = 0 THEN 'The service has been poor and I want to port my policy P' ||
   lpad(CAST(event_id AS STRING), 15, '0') || ' elsewhere. Please stop the auto-debit.'
  WHEN event_id % 7 = 0 THEN 'I am thinking to cancel, another insurer asks ₹' ||
   CAST(1000 + event_id % 900 AS STRING) || ' less.'
  WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'My car is at the garage for ' || CAST(event_id % 50 AS STRING)
   || ' days and only ₹8,200 was approved.'
  WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'Claim CLM-' || CAST(event_id AS STRING) ||
   ' is still pending after ' || CAST(event_id % 70 AS STRING) || ' days and nobody calls back. I will write to IRDAI.'
  WHEN event_type = 'error' THEN 'My claim is still pending and nobody calls back.'
  WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'Why a hike of ' || CAST(event_id % 30 AS STRING) ||
   ' percent on P' || lpad(CAST(event_id AS STRING), 15, '0') || '? I found a plan ₹3,100 cheaper online.'
  WHEN event_type = 'click' THEN 'Your price is higher than others, is there any discount?'
  WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'We had a baby girl, can you add her? Is the sum insured enough?'
  WHEN event_type = 'signup' THEN 'I am thinking of a term plan, that sounds good.'
  WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'I want to say thanks, CLM-' || CAST(event_id AS STRING) ||
   ' was settled in a week, very smooth.'
  WHEN event_type = 'purchase' THEN 'I renewed on the app and it was very easy. Very convenient.'
  WHEN event_id % 3 = 0 THEN 'I need to update my address in my policy records.'
  WHEN event_id % 3 = 1 THEN 'Please send the premium certificate for tax.'
  ELSE 'When is my renewal: this month or the next?' END || chr(10) ||
 'Agent: Noted, I will check that for you.' || chr(10) ||
 CASE event_id % 3 WHEN 0 THEN '  Customer: Okay.' WHEN 1 THEN 'Customer: Great, thank you.'
  ELSE 'Customer: This is really frustrating.' END AS transcript_text
FROM {events}""",
    "true_intents": """
SELECT 'T' || lpad(CAST(event_id AS STRING), 15, '0') AS transcript_id,
 CASE WHEN event_id % 7 = 0 THEN 'cancellation_intent' WHEN event_type = 'error' THEN 'claim_issue'
  WHEN event_type = 'click' THEN 'price_concern' WHEN event_type = 'signup' THEN 'upsell_interest'
  WHEN event_type = 'purchase' THEN 'service_praise' ELSE 'general_service' END AS true_intent
FROM {events}""",
    "archetypes": """
SELECT 'C' || lpad(CAST(c_custkey AS STRING), 12, '0') AS customer_id,
 CASE c_custkey % 4 WHEN 0 THEN 'loyal' WHEN 1 THEN 'at_risk' WHEN 2 THEN 'price_shopper' ELSE 'growth' END AS archetype
FROM {customer}""",
    "action_log": """
SELECT event_id AS log_id,
 'C' || lpad(CAST((event_id * 31 + user_id) % (SELECT count(*) FROM {customer}) AS STRING), 12, '0') AS customer_id,
 CASE event_type WHEN 'error' THEN 'CLAIM_ESCALATION' WHEN 'click' THEN 'PRICE_MATCH' WHEN 'signup' THEN 'CROSS_SELL'
  WHEN 'purchase' THEN 'ADVOCACY' ELSE 'RENEWAL_NUDGE' END AS action_category,
 'follow up ' || event_type AS action,
 CASE event_id % 5 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Done' WHEN 3 THEN 'Accepted'
  ELSE 'Snoozed' END AS status,
 'A' || CAST(event_id % 40 AS STRING) AS agent,
 CAST(DATE '2001-11-05' - CAST(1 + event_id % 30 AS INT) AS {ts}) AS ts,
 CASE WHEN event_id % 6 = 0 THEN 'called back' END AS note
FROM {events}""",
}

SCHEMAS = {
    "customers": schemas.CUSTOMERS,
    "policies": schemas.POLICIES,
    "claims": schemas.CLAIMS,
    "payments": schemas.PAYMENTS,
    "call_transcripts": schemas.CALL_TRANSCRIPTS,
    "true_intents": schemas.TRUE_INTENTS,
    "archetypes": schemas.ARCHETYPES,
    "action_log": schemas.ACTION_LOG,
}
INPUTS = ("customer", "nation", "region", "orders", "lineitem", "events")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in INPUTS}


def view(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One fixture view over the given input tables, conformed to its source schema."""
    text = VIEWS[name]
    used = {t: tables[t] for t in INPUTS if "{" + t + "}" in text}
    text = text.replace("{ts}", "TIMESTAMP_NTZ").replace(
        "{open_days}", "datediff(DATE '2001-11-05', CAST(l_shipdate AS DATE))")
    return schemas.conform(spark.sql(text, **used), SCHEMAS[name])


def check_sql(name: str) -> str:
    """The same view for the checking engine."""
    text = VIEWS[name].replace("{ts}", "TIMESTAMP").replace(
        "{open_days}", "CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-11-05') AS INT)")
    for table in INPUTS:
        text = text.replace("{" + table + "}", table)
    return text.strip()
