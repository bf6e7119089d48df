"""Source schemas and a projection that conforms a table to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(4,1)": T.DecimalType(4, 1),
}


def _schema(spec: str) -> T.StructType:
    """Built without a session, so that the schemas can be module constants."""
    fields = [column.split() for column in spec.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


CUSTOMERS = _schema(
    "customer_id string, full_name string, gender string, age int, city string, state string, city_tier int, "
    "segment string, annual_income_band string, customer_since date, tenure_years decimal(4,1), "
    "preferred_channel string, preferred_language string, email string, mobile_masked string, kyc_status string")
POLICIES = _schema(
    "policy_id string, customer_id string, product_line string, plan_name string, sum_insured bigint, "
    "annual_premium bigint, payment_frequency string, start_date date, renewal_date date, status string, "
    "sales_channel string, ncb_pct int")
CLAIMS = _schema(
    "claim_id string, policy_id string, customer_id string, product_line string, claim_type string, claim_date date, "
    "claim_amount bigint, approved_amount bigint, status string, settled_date date, days_to_settle int, days_open int")
PAYMENTS = _schema(
    "payment_id string, policy_id string, customer_id string, due_date date, paid_date date, amount_due bigint, "
    "amount_paid bigint, payment_status string, days_late int, payment_method string")
CALL_TRANSCRIPTS = _schema(
    "transcript_id string, customer_id string, policy_id string, call_ts timestamp_ntz, direction string, "
    "channel string, agent_id string, duration_sec int, language string, transcript_text string")
TRUE_INTENTS = _schema("transcript_id string, true_intent string")
ARCHETYPES = _schema("customer_id string, archetype string")
ACTION_LOG = _schema(
    "log_id bigint, customer_id string, action_category string, action string, status string, agent string, "
    "ts timestamp_ntz, note string")
DRIVERS = T.ArrayType(_schema("factor string, points double, detail string"))

RAW_TABLES = {
    "customers": CUSTOMERS,
    "policies": POLICIES,
    "claims": CLAIMS,
    "payments": PAYMENTS,
    "call_transcripts": CALL_TRANSCRIPTS,
    "eval_transcript_labels": TRUE_INTENTS,
}
KEYS = {
    "customers": "customer_id",
    "policies": "policy_id",
    "claims": "claim_id",
    "payments": "payment_id",
    "call_transcripts": "transcript_id",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order and type; columns the table lacks are null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
