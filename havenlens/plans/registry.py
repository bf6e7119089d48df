"""Registered queries: a Spark plan over the test tables and, where SQL can state it, its checking SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens import schemas
from havenlens.functions import churn
from havenlens.functions import text as tx
from havenlens.functions.numeric import fixed, inr_label
from havenlens.operators import (actions, ask, ask_batch, customer360, decisions, insights, portfolio, risk, search, search_index,
                                 semantic, serving, vector_index)
from havenlens.plans import fixtures as fx
from havenlens.plans.book import Book, run_stages
from havenlens.plans.checks import f2, r, with_steps
from havenlens.plans.keyed_book import open_keyed_book, store_keyed
from havenlens.session import scratch_path, shuffles_dropped
from havenlens.sources import tables as io
from havenlens.streaming import jobs

AS_OF = fx.AS_OF
STAMP = dt.datetime(2001, 11, 5, 6, 0)
WORDING = K.Wording(policy_pattern=fx.POLICY_PATTERN, customer_pattern=fx.CUSTOMER_PATTERN)
CITIES = tuple(f"NATION_{i}" for i in range(25))
SEGMENTS = {s.lower(): s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}


@dataclass(frozen=True)
class Context:
    """What a query gets: the session, the folder of test tables and the book made from them."""

    spark: SparkSession
    folder: str
    book: Book

    def table(self, name: str) -> DataFrame:
        return fx.read_table(self.spark, self.folder, name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


_books: WeakKeyDictionary[SparkSession, dict[str, Book]] = WeakKeyDictionary()


def fixture_book(spark: SparkSession, folder: str) -> Book:
    """The book over one folder. Plans are kept per session, so a table is analysed once; no data is kept."""
    books = _books.setdefault(spark, {})
    if folder not in books:
        books[folder] = make_book(spark, folder)
    return books[folder]


def make_book(spark: SparkSession, folder: str) -> Book:
    inputs = fx.read_tables(spark, folder)
    views = {name: fx.view(spark, name, inputs) for name in fx.VIEWS}
    return Book(views["customers"], views["policies"], views["claims"], views["payments"], views["call_transcripts"],
                AS_OF, WORDING, STAMP, views["action_log"], views["true_intents"], views["archetypes"])


QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query, with the final SELECT of its check if it has one."""
    def add(build: Callable[[Context], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = with_steps(check)
        return build

    return add


def driver_text(drivers) -> F.Column:
    return F.array_join(F.transform(drivers, lambda d: F.concat(
        d.getField("factor"), F.lit(" "), fixed(d.getField("points"), 1), F.lit(" ("), d.getField("detail"),
        F.lit(")"))), "; ")


def flat(nba: DataFrame) -> DataFrame:
    """Array columns as text, so that both engines compare plain values."""
    return nba.withColumns({"risk_drivers": driver_text(F.col("risk_drivers")),
                            "evidence": F.array_join("evidence", ",")})


# --- sources and sinks ---------------------------------------------------------------------------
COUNTED = ("customers", "policies", "claims", "payments", "call_transcripts")


@query("load_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in COUNTED))
def _(c):
    return io.load_row_counts({t: getattr(c.book, t) for t in COUNTED})


REFERENCES = {
    "policies_customer": ("policies", "customer_id", "customers", "customer_id"),
    "claims_policy": ("claims", "policy_id", "policies", "policy_id"),
    "payments_policy": ("payments", "policy_id", "policies", "policy_id"),
    "calls_customer": ("call_transcripts", "customer_id", "customers", "customer_id"),
    "calls_policy": ("call_transcripts", "policy_id", "policies", "policy_id"),
    "claims_customer": ("claims", "customer_id", "customers", "customer_id"),
    "payments_customer": ("payments", "customer_id", "customers", "customer_id"),
    "nba_c360": ("nba", "customer_id", "c360", "customer_id"),
    "insights_c360": ("insights", "customer_id", "c360", "customer_id"),
}


@query("key_checks", " UNION ALL ".join(
    [f"SELECT '{t}.null_keys' AS check_name, count(*) AS n_bad FROM {t} WHERE {schemas.KEYS[t]} IS NULL" for t in COUNTED]
    + [f"SELECT '{t}.duplicate_keys', count(*) FROM (SELECT {schemas.KEYS[t]} FROM {t} GROUP BY 1 HAVING count(*) > 1) d"
       for t in COUNTED]
    + [f"SELECT '{n}.orphans', count(*) FROM {a} WHERE {ka} IS NOT NULL AND {ka} NOT IN (SELECT {kb} FROM {b})"
       for n, (a, ka, b, kb) in REFERENCES.items()]))
def _(c):
    get = lambda name: getattr(c.book, name)
    return io.key_checks({t: (get(t), schemas.KEYS[t]) for t in COUNTED},
                         {n: (get(a), ka, get(b), kb) for n, (a, ka, b, kb) in REFERENCES.items()})


TRANSCRIPT_COLUMNS = ", ".join(f.name for f in schemas.CALL_TRANSCRIPTS.fields)


@query("read_raw_csv", f"SELECT {TRANSCRIPT_COLUMNS} FROM call_transcripts")
def _(c):
    path = c.scratch("csv")
    c.book.call_transcripts.withColumn("call_ts", F.date_format("call_ts", "yyyy-MM-dd HH:mm:ss")).write.option(
        "header", True).option("escape", '"').option("nullValue", "NULL").csv(path)
    return io.read_raw_csv(c.spark, path, schemas.CALL_TRANSCRIPTS, multiline=True)


def _digest_sql(table: str) -> str:
    """Rows, distinct keys and a sum of one number of a table: small and different if a value is lost."""
    key, number = DIGESTED[table]
    return (f"SELECT '{table}' AS table_name, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys, "
            f"CAST(sum(CAST({number} AS DECIMAL(20, 4))) AS DOUBLE) AS total, min({key}) AS least, max({key}) AS most FROM {table}")


DIGESTED = {"customers": ("customer_id", "tenure_years"), "policies": ("policy_id", "annual_premium"),
            "claims": ("claim_id", "claim_amount"), "payments": ("payment_id", "amount_due"),
            "call_transcripts": ("transcript_id", "length(transcript_text)"), "insights": ("transcript_id", "length(summary)")}


@query("parquet_tables", " UNION ALL ".join(map(_digest_sql, DIGESTED)))
def _(c):
    """All six tables after a trip through Parquet."""
    folder = c.scratch("tables")
    tables = {name: getattr(c.book, name) for name in COUNTED} | {"interaction_insights": c.book.insights}
    io.write_parquet_tables(tables, folder)
    read = io.read_parquet_tables(c.spark, folder, list(tables))
    parts = [c.spark.sql(_digest_sql(name).replace(f"FROM {name}", "FROM {t}"), t=read["interaction_insights" if name == "insights" else name])
             for name in DIGESTED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("normalise_types", "SELECT customer_id, CAST(next_renewal_date AS TIMESTAMP) AS next_renewal_date, "
       "coalesce(ranked, '') AS risk_drivers, evidence FROM nba LEFT JOIN driver_text USING (customer_id)")
def _(c):
    as_text = c.book.nba.select(
        "customer_id", F.col("next_renewal_date").cast("string").alias("next_renewal_date"),
        F.to_json("risk_drivers").alias("risk_drivers"), F.to_json("evidence").alias("evidence"))
    out = flat(io.normalise_types(as_text))
    return out.withColumn("next_renewal_date", F.col("next_renewal_date").cast("timestamp_ntz"))


@query("export_json", "SELECT payment_id, customer_id, strftime(due_date, '%Y-%m-%dT00:00:00') AS due_date, "
       "strftime(paid_date, '%Y-%m-%dT00:00:00') AS paid_date, amount_due, payment_status, days_late FROM payments")
def _(c):
    folder = c.scratch("json")
    io.export_json({"payments": c.book.payments}, folder)
    return c.spark.read.schema(
        "payment_id string, customer_id string, due_date string, paid_date string, amount_due bigint, "
        "payment_status string, days_late int").json(f"{folder}/payments")


@query("export_json_actions", """SELECT customer_id, strftime(next_renewal_date, '%Y-%m-%dT00:00:00') AS next_renewal_date,
 risk_score, risk_drivers, evidence, count(*) OVER () AS n_rows, '2001-11-05T00:00:00' AS as_of FROM nba""")
def _(c):
    """Rows with nested arrays, and the summary and run meta written beside them."""
    folder = c.scratch("json")
    meta = io.run_meta(insights.intent_accuracy(c.book.insights, c.book.labels), AS_OF, generated_at=STAMP)
    io.export_json({"next_best_actions": c.book.nba, "portfolio": portfolio.portfolio_totals(c.book.nba, c.book.insights), "meta": meta}, folder)
    rows = c.spark.read.schema("customer_id string, next_renewal_date string, risk_score double, evidence array<string>, "
                               f"risk_drivers {schemas.DRIVERS.simpleString()}").json(f"{folder}/next_best_actions")
    n_rows = c.spark.read.schema("n_customers bigint").json(f"{folder}/portfolio").scalar()
    as_of = c.spark.read.schema("as_of string").json(f"{folder}/meta").scalar()
    return rows.withColumns({"n_rows": n_rows, "as_of": as_of}).select(
        "customer_id", "next_renewal_date", "risk_score", driver_text(F.col("risk_drivers")).alias("risk_drivers"),
        F.array_join("evidence", ",").alias("evidence"), "n_rows", "as_of")


@query("conversation_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS customer_text FROM conversations "
       "WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id")
def _(c):
    return tx.ordered_text(c.table("conversations").where(F.col("role") == "user"), "conv_id", "turn", "text")


@query("snapshot_360", "SELECT * FROM c360")
def _(c):
    return io.snapshot_360(c.book.c360, c.scratch("snapshot"))


@query("run_meta", "SELECT 'rules' AS source, DATE '2001-11-05' AS as_of, TIMESTAMP '2001-11-05 06:00:00' AS "
       f"generated_at, {r('avg(CASE WHEN primary_intent = true_intent THEN 1 ELSE 0 END) * 100', 1)} AS "
       "intent_accuracy_pct, '' AS note FROM insights JOIN true_intents USING (transcript_id)")
def _(c):
    return io.run_meta(insights.intent_accuracy(c.book.insights, c.book.labels), AS_OF, generated_at=STAMP)


LOG_VALUES = "customer_id, action_category, action, status, agent, ts, note"


@query("append_action_log", f"""SELECT round, {LOG_VALUES}, true AS id_is_new FROM (
 SELECT * REPLACE (coalesce(agent, 'desk') AS agent, coalesce(ts, TIMESTAMP '2001-11-05 06:00:00') AS ts), unnest([1, 2]) AS round
 FROM status) s""")
def _(c):
    """The log that two appends make from nothing, by value; the second one's ids lie above the first one's."""
    path = c.scratch("log")
    decisions.append_action_log(c.book.status, path, agent="desk", now=STAMP)
    first = c.spark.read.parquet(path).select("log_id").withColumn("round", F.lit(1))
    first = io.snapshot_360(first, c.scratch("first"))
    decisions.append_action_log(c.book.status, path, agent="desk", now=STAMP)
    log = c.spark.read.parquet(path).join(first, "log_id", "left").withColumn("round", F.coalesce("round", F.lit(2)))
    top = first.agg(F.max("log_id")).scalar()
    return log.select("round", *LOG_VALUES.split(", "), ((F.col("round") == 1) | (F.col("log_id") > top)).alias("id_is_new"))


# --- transcript text -----------------------------------------------------------------------------
@query("customer_text", "SELECT transcript_id, customer_text FROM said")
def _(c):
    return c.book.call_transcripts.select("transcript_id", tx.customer_text(F.col("transcript_text"))
                                          .alias("customer_text"))


@query("dialogue_turns", """SELECT transcript_id, CAST(i - 1 AS INT) AS line_no,
 CASE WHEN starts_with(trim(lines[i]), 'Customer:') THEN 'customer' ELSE 'agent' END AS speaker,
 CASE WHEN contains(lines[i], ':') THEN trim(substr(lines[i], instr(lines[i], ':') + 1)) ELSE trim(lines[i]) END AS words
 FROM (SELECT transcript_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
 SELECT transcript_id, string_split(transcript_text, chr(10)) AS lines FROM call_transcripts) a) b""")
def _(c):
    return insights.dialogue_turns(c.book.call_transcripts)


@query("sentiment_score", "SELECT transcript_id, sentiment_score FROM scored")
def _(c):
    return c.book.insights.select("transcript_id", "sentiment_score")


def _free_text_check(table: str, key: str, where: str = "") -> str:
    """Sentiment and intent of a table's own text: the scoring step with `said` replaced."""
    from havenlens.plans.checks import STEPS
    body = STEPS["scored"].replace("FROM said", f"FROM (SELECT *, lower(text) AS lowered FROM {table} {where}) s0")
    return f"SELECT {key}, sentiment_score, primary_intent FROM ({body}) s1"


def _free_text(df: DataFrame, *keys: str) -> DataFrame:
    lowered = df.withColumn("lowered", F.lower("text"))
    return lowered.select(*keys, tx.sentiment_score(F.col("lowered")).alias("sentiment_score"),
                          tx.primary_intent(F.col("lowered")).alias("primary_intent"))


@query("sentiment_of_documents", _free_text_check("documents", "doc_id"))
def _(c):
    return _free_text(c.table("documents"), "doc_id")


@query("sentiment_of_user_turns", _free_text_check("conversations", "conv_id, turn", "WHERE role = 'user'"))
def _(c):
    return _free_text(c.table("conversations").where(F.col("role") == "user"), "conv_id", "turn")


@query("sentiment_label", "SELECT transcript_id, sentiment_label FROM insights")
def _(c):
    return c.book.insights.select("transcript_id", "sentiment_label")


@query("primary_intent", "SELECT transcript_id, primary_intent FROM scored")
def _(c):
    return c.book.insights.select("transcript_id", "primary_intent")


@query("extract_entities", rf"""SELECT transcript_id,
 array_to_string(regexp_extract_all(transcript_text, '{fx.POLICY_PATTERN}'), ',') AS policy_ids,
 array_to_string(regexp_extract_all(transcript_text, 'CLM-\d+'), ',') AS claim_ids,
 nullif(regexp_extract(customer_text, '₹([\d,]+)', 1), '') AS amount,
 nullif(regexp_extract(customer_text, '(\d+) days', 1), '') AS days,
 nullif(regexp_extract(customer_text, '(\d+) percent', 1), '') AS percent FROM said""")
def _(c):
    found = insights.entities(c.book.call_transcripts, WORDING)
    return found.withColumns({n: F.array_join(n, ",") for n in ("policy_ids", "claim_ids")})


@query("call_summary", "SELECT transcript_id, summary FROM insights")
def _(c):
    return c.book.insights.select("transcript_id", "summary")


@query("interaction_insights", "SELECT * FROM insights")
def _(c):
    return c.book.insights


@query("enrich_incremental", "SELECT * FROM insights WHERE call_ts >= TIMESTAMP '2001-10-06'")
def _(c):
    stored = c.book.call_transcripts.where(F.col("call_ts") < F.lit("2001-10-06").cast("timestamp_ntz"))
    return insights.enrich_incremental(c.book.call_transcripts, stored, WORDING, STAMP)


@query("intent_accuracy", f"""SELECT count(*) AS n_labelled,
 count(*) FILTER (primary_intent = true_intent) AS n_right,
 {r('avg(CASE WHEN primary_intent = true_intent THEN 1 ELSE 0 END) * 100', 1)} AS intent_accuracy_pct
 FROM insights JOIN true_intents USING (transcript_id)""")
def _(c):
    return insights.intent_accuracy(c.book.insights, c.book.labels)


@query("intent_distribution", f"""SELECT primary_intent, count(*) AS n_calls,
 {r('CAST(sum(CAST(round(sentiment_score * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000', 3)} AS avg_sentiment
 FROM insights GROUP BY primary_intent""")
def _(c):
    return insights.intent_distribution(c.book.insights)


@query("intent_confusion", "SELECT true_intent, primary_intent, count(*) AS n_calls FROM insights "
       "JOIN true_intents USING (transcript_id) GROUP BY ALL")
def _(c):
    return insights.intent_confusion(c.book.insights, c.book.labels)


# --- customer 360 --------------------------------------------------------------------------------
@query("policy_rollup", "SELECT * FROM pol_roll")
def _(c):
    return customer360.policy_rollup(c.book.policies, AS_OF)


@query("next_renewal", "SELECT * FROM soonest")
def _(c):
    return customer360.next_renewal(c.book.policies, AS_OF)


@query("claims_rollup_18m", "SELECT * FROM claims_roll")
def _(c):
    return customer360.claims_rollup_18m(c.book.claims, AS_OF)


@query("payments_rollup_12m", "SELECT * FROM payments_roll")
def _(c):
    return customer360.payments_rollup_12m(c.book.payments, AS_OF)


@query("calls_rollup_180d", "SELECT * FROM calls_roll")
def _(c):
    return customer360.calls_rollup_180d(c.book.call_transcripts, AS_OF)


@query("ai_signals", "SELECT * FROM ai")
def _(c):
    return customer360.ai_signals(c.book.insights, AS_OF)


@query("customer_360", "SELECT * FROM c360")
def _(c):
    return c.book.c360


@query("coverage_summary", """SELECT count(*) AS n_customers, count(product_lines) AS with_policies,
 count(*) FILTER (n_claims > 0) AS with_claims, count(*) FILTER (n_payments_due_12m > 0) AS with_payments,
 count(*) FILTER (n_calls_180d > 0) AS with_calls, count(*) FILTER (has_ai_insights) AS with_ai_insights,
 CAST(sum(total_annual_premium) AS BIGINT) AS total_premium FROM c360""")
def _(c):
    return customer360.coverage_summary(c.book.c360)


# --- churn score ---------------------------------------------------------------------------------
def _risk_column(name: str, *extra: str) -> None:
    columns = ("customer_id", name, *extra)
    query(name, f"SELECT {', '.join(columns)} FROM risk")(lambda c: c.book.risk.select(*columns))


for _name in K.POINT_COLUMNS:
    _risk_column(_name)
_risk_column("risk_score", "risk_band")
_risk_column("expected_premium_loss")


@query("premium_at_risk", "SELECT customer_id, premium_at_risk FROM nba")
def _(c):
    return c.book.risk.select("customer_id", churn.premium_at_risk().alias("premium_at_risk"))



@query("churn_risk", "SELECT risk.*, coalesce(drivers, '') AS risk_drivers FROM risk "
       "LEFT JOIN driver_text USING (customer_id)")
def _(c):
    return c.book.risk.withColumn("risk_drivers", driver_text(F.col("risk_drivers")))


@query("risk_drivers", "SELECT customer_id, factor, points, detail FROM drivers")
def _(c):
    return risk.driver_rows(c.book.risk).drop("position")


@query("drivers_ranked", """SELECT customer_id, coalesce(top_two, '') AS top_two, coalesce(top_three, '') AS top_three,
 coalesce(top_three_points, '') AS top_three_points FROM risk LEFT JOIN top_text USING (customer_id)""")
def _(c):
    return risk.drivers_ranked(c.book.risk)


@query("driver_share", f"""SELECT customer_id, factor, points, max_points,
 {r('points * 100 / max_points', 1)} AS share_pct FROM drivers JOIN (VALUES
 {', '.join(f"('{n}', {m}::DOUBLE)" for n, m in K.DRIVER_MAXIMA.items())}) m(factor, max_points) USING (factor)""")
def _(c):
    return risk.driver_share(c.book.risk)


@query("risk_by_archetype", """SELECT archetype, count(*) FILTER (risk_band = 'High') AS high,
 count(*) FILTER (risk_band = 'Medium') AS medium, count(*) FILTER (risk_band = 'Low') AS low
 FROM risk JOIN archetypes USING (customer_id) GROUP BY archetype""")
def _(c):
    return risk.risk_by_archetype(c.book.risk, c.book.archetypes)


@query("archetype_quality", f"""SELECT hits, n_target, n_high, {r('hits / n_target * 100', 1)} AS recall_pct,
 {r('hits / n_high * 100', 1)} AS precision_pct FROM (SELECT
 count(*) FILTER (risk_band = 'High' AND archetype = 'at_risk') AS hits,
 count(*) FILTER (archetype = 'at_risk') AS n_target, count(*) FILTER (risk_band = 'High') AS n_high
 FROM risk JOIN archetypes USING (customer_id)) t""")
def _(c):
    return risk.archetype_quality(c.book.risk, c.book.archetypes)


# --- next best action ----------------------------------------------------------------------------
@query("action_category", "SELECT customer_id, action_category FROM categorised")
def _(c):
    return c.book.risk.select("customer_id", actions.action_category().alias("action_category"))


@query("cross_sell_product", """SELECT customer_id, CASE WHEN has_health = 0 THEN 'Health Shield Family Floater'
 WHEN has_life = 0 THEN 'Term Secure life cover' WHEN has_home = 0 THEN 'Home Protect'
 ELSE 'Super Top-Up health cover' END AS offer FROM c360""")
def _(c):
    return c.book.c360.select("customer_id", actions.cross_sell_product(WORDING).alias("offer"))


@query("action_text", "SELECT customer_id, action_category, action, customer_message FROM nba")
def _(c):
    category = F.col("action_category")
    return c.book.risk.withColumn("action_category", actions.action_category()).select(
        "customer_id", "action_category", actions.action_text(category, WORDING).alias("action"),
        actions.customer_message(category, WORDING).alias("customer_message"))


@query("evidence_calls", "SELECT customer_id, action_category, evidence FROM nba")
def _(c):
    return actions.evidence_calls(c.book.risk, c.book.insights, AS_OF).withColumn(
        "evidence", F.array_join("evidence", ","))


@query("action_reason", "SELECT customer_id, reason FROM nba")
def _(c):
    return c.book.risk.select("customer_id", actions.action_reason(
        actions.action_category(), F.col("risk_drivers")).alias("reason"))


@query("next_best_actions", "SELECT * FROM nba")
def _(c):
    return flat(c.book.nba)


@query("staged_next_best_actions", "SELECT * FROM nba")
def _(c):
    return flat(run_stages(c.spark, c.book, c.scratch("stages"))["next_best_actions"])


@query("enrichment_queue", """SELECT customer_id, risk_score, risk_band,
 CAST(row_number() OVER (ORDER BY risk_score DESC, customer_id) AS INT) AS queue_no FROM (
 SELECT customer_id, risk_score, risk_band FROM risk
 WHERE (risk_band IN ('High', 'Medium') OR n_upsell_interest_180d > 0)
 AND customer_id NOT IN (SELECT customer_id FROM status WHERE status = 'Done' AND ts >= TIMESTAMP '2001-11-03')
 ORDER BY risk_score DESC, customer_id
 LIMIT greatest(0, least(50, 150 - (SELECT count(DISTINCT customer_id) FROM status
  WHERE status = 'Done' AND ts >= TIMESTAMP '2001-11-03')))) t""")
def _(c):
    done = c.book.status.where((F.col("status") == "Done") & (F.col("ts") >= F.lit("2001-11-03").cast("timestamp_ntz")))
    return actions.enrichment_queue(c.book.risk, done)


@query("grounding_context", f"""SELECT customer_id, 'CUSTOMER | ' || customer_id || ' | ' || full_name || ' | ' || segment
 || ' | ' || city || coalesce(' | ' || product_lines, '') || ' | ' || tenure_years || ' years' || chr(10) ||
 'SIGNALS | premium ' || total_annual_premium || ' | active policies ' || n_active_policies || ' | open claims ' ||
 n_open_claims || ' | late ' || n_late_12m || ' | missed ' || n_missed_12m || ' | calls ' || n_calls_180d ||
 coalesce(' | sentiment ' || {f2('avg_sentiment_90d')}, '') || chr(10) || 'RISK | ' || {f2('risk_score', 1)} || ' ' ||
 risk_band || ' | ' || coalesce(ranked, '') || chr(10) || 'RULE | ' || rule_category || ' | ' || action ||
 coalesce(chr(10) || 'CALLS | ' || calls, '') AS context
 FROM nba JOIN (SELECT customer_id, tenure_years, n_active_policies, n_open_claims, n_late_12m, n_missed_12m,
  n_calls_180d, avg_sentiment_90d FROM c360) x USING (customer_id) LEFT JOIN driver_text USING (customer_id)
 LEFT JOIN (SELECT e.customer_id, string_agg(transcript_id || ' | ' || strftime(call_ts, '%Y-%m-%d') || ' | ' ||
  primary_intent || ' | ' || {f2('sentiment_score')} || ' | ' || summary, chr(10) ORDER BY nth) AS calls
  FROM evidence e JOIN (SELECT transcript_id, call_ts, primary_intent, sentiment_score, summary FROM insights) i
  USING (transcript_id) GROUP BY e.customer_id) k USING (customer_id)""")
def _(c):
    return actions.grounding_context(c.book.nba, c.book.c360, actions.cited_calls_in_words(
        c.book.nba, c.book.call_transcripts, AS_OF, WORDING))


@query("apply_model_response", """SELECT customer_id, action_category,
 CASE WHEN risk_band = 'High' THEN 'Call today' ELSE action END AS action,
 CASE WHEN risk_band = 'High' THEN 'Asked twice' ELSE reason END AS reason,
 CASE WHEN risk_band = 'High' THEN split_part(evidence, ',', 1) ELSE evidence END AS evidence, customer_message,
 CASE WHEN risk_band = 'High' THEN 'Phone' ELSE channel END AS channel,
 CASE WHEN risk_band = 'High' THEN 'model' ELSE generated_by END AS generated_by FROM nba""")
def _(c):
    own = F.coalesce(F.get("evidence", F.lit(0)), F.lit("none"))
    response = (F.when(F.col("risk_band") == "High", F.concat(
        F.lit('Sure:\n{"action": "Call today", "reason": "Asked twice", "evidence": ["T-someone-else", "'), own,
        F.lit('"], "channel": "Phone"}\nDone.')))
        .when(F.col("risk_band") == "Medium", "I cannot say.").otherwise('{"action": "Call'))
    responses = c.book.nba.select("customer_id", response.alias("response"))
    return flat(actions.apply_model_response(c.book.nba, responses, c.book.insights)).select(
        "customer_id", "action_category", "action", "reason", "evidence", "customer_message", "channel", "generated_by")


@query("rule_vs_final", f"""SELECT generated_by, count(*) AS n_actions,
 count(*) FILTER (agrees) AS n_agree, {r('count(*) FILTER (agrees) / count(*)', 4)} AS agreement FROM (
 SELECT CASE WHEN risk_band = 'High' THEN 'model' ELSE generated_by END AS generated_by,
  risk_band <> 'High' OR rule_category = CASE WHEN segment = 'BUILDING' THEN 'RETENTION_CALL' ELSE 'NURTURE' END AS agrees
 FROM nba) t GROUP BY generated_by""")
def _(c):
    """After answers that name a category of their own for the High band."""
    named = F.when(F.col("segment") == "BUILDING", "RETENTION_CALL").otherwise("NURTURE")
    answers = c.book.nba.where("risk_band = 'High'").select("customer_id", F.concat(
        F.lit('{"action": "Call", "action_category": "'), named, F.lit('"}')).alias("response"))
    final = actions.rule_vs_final(actions.apply_model_response(c.book.nba, answers, c.book.insights))
    return final.withColumn("agreement", F.rint(F.col("agreement") * 1e4) / 1e4)


# --- customer-level views ------------------------------------------------------------------------
@query("customer_card", """SELECT c360.*, risk_score, risk_band, risk_drivers, expected_premium_loss, premium_at_risk,
 action_category, action, reason, evidence, customer_message, channel, rule_category, generated_by, generated_at,
 coalesce(avg_sentiment_90d, avg_sentiment_180d) AS card_sentiment
 FROM c360 JOIN (SELECT customer_id, risk_score, risk_band, risk_drivers, expected_premium_loss, premium_at_risk,
 action_category, action, reason, evidence, customer_message, channel, rule_category, generated_by, generated_at
 FROM nba) n USING (customer_id)""")
def _(c):
    return flat(serving.customer_card(c.book.nba, c.book.c360))


def keyed_book(c: Context) -> Book:
    """The book stored by customer and opened again."""
    folder = c.scratch("keyed")
    store_keyed(c.spark, c.book, folder, int(c.spark.conf.get("spark.sql.shuffle.partitions")), spread=2)
    return open_keyed_book(c.spark, c.book, folder)


@query("customer_card_stored")
def _(c):
    book = keyed_book(c)
    return flat(serving.customer_card(book.nba, book.c360))


@query("source_health_stored")
def _(c):
    b = keyed_book(c)
    return serving.source_health(b.c360, b.policies, b.claims, b.payments, b.insights)


@query("call_timeline", "SELECT customer_id, call_ts, transcript_id, agent_id, primary_intent, sentiment_score, "
       "sentiment_label, summary FROM insights")
def _(c):
    return serving.call_timeline(c.book.insights)


@query("sentiment_trend", "SELECT customer_id, call_ts, transcript_id, sentiment_score FROM insights")
def _(c):
    return serving.sentiment_trend(c.book.insights)


@query("payments_by_month", """SELECT customer_id, CAST(date_trunc('month', due_date) AS DATE) AS month,
 count(*) FILTER (payment_status = 'On-time') AS on_time, count(*) FILTER (payment_status = 'Late') AS late,
 count(*) FILTER (payment_status = 'Missed') AS missed FROM payments GROUP BY ALL""")
def _(c):
    return serving.payments_by_month(c.book.payments)


INR_SQL = (  # label with `d` decimals for lakh and Indian digit groups below
    "CASE WHEN abs({v}) >= 10000000 THEN '₹' || printf('%.2f', round_even({v} / 10000000.0::DOUBLE * 100, 0) / 100) || "
    "' Cr' WHEN abs({v}) >= 100000 THEN '₹' || printf('%.{d}f', round_even({v} / 100000.0::DOUBLE * {s}, 0) / {s}) || "
    "' L' ELSE '₹' || CASE WHEN length(CAST(CAST(round_even({v}, 0) AS BIGINT) AS VARCHAR)) > 3 THEN "
    "CAST(CAST(round_even({v}, 0) AS BIGINT) // 1000 AS VARCHAR) || ',' || "
    "lpad(CAST(CAST(round_even({v}, 0) AS BIGINT) % 1000 AS VARCHAR), 3, '0') "
    "ELSE CAST(CAST(round_even({v}, 0) AS BIGINT) AS VARCHAR) END END")


def inr_sql(value: str, decimals: int) -> str:
    return INR_SQL.format(v=f"CAST(coalesce({value}, 0) AS DOUBLE)", d=decimals, s=f"{10**decimals}.0::DOUBLE")


@query("source_health", f"""WITH wide AS (SELECT c360.*, coalesce(n_pol, 0) AS n_pol, coalesce(n_bad, 0) AS n_bad,
 coalesce(n_clm, 0) AS n_clm, coalesce(n_open, 0) AS n_open, coalesce(n_rejected, 0) AS n_rejected,
 coalesce(n_pay, 0) AS n_pay, coalesce(n_late, 0) AS n_late, coalesce(n_missed, 0) AS n_missed,
 coalesce(n_ins, 0) AS n_ins, coalesce(n_cancel, 0) AS n_cancel,
 coalesce(avg_sentiment_90d, avg_sentiment_180d) AS mood FROM c360
 LEFT JOIN (SELECT customer_id, count(*) AS n_pol, count(*) FILTER (status <> 'Active') AS n_bad FROM policies
  GROUP BY 1) p USING (customer_id)
 LEFT JOIN (SELECT customer_id, count(*) AS n_clm, count(*) FILTER (status IN ('Pending', 'Under Review')) AS n_open,
  count(*) FILTER (status = 'Rejected') AS n_rejected FROM claims GROUP BY 1) k USING (customer_id)
 LEFT JOIN (SELECT customer_id, count(*) AS n_pay, count(*) FILTER (payment_status = 'Late') AS n_late,
  count(*) FILTER (payment_status = 'Missed') AS n_missed FROM payments GROUP BY 1) y USING (customer_id)
 LEFT JOIN (SELECT customer_id, count(*) AS n_ins,
  count(*) FILTER (primary_intent = 'cancellation_intent') AS n_cancel FROM insights GROUP BY 1) i USING (customer_id))
SELECT customer_id, 'policies' AS source, n_pol AS n_rows,
 CASE WHEN n_bad > 0 THEN 'bad' WHEN coalesce(days_to_renewal, 999) <= 30 THEN 'warn' ELSE 'good' END AS health,
 n_active_policies || ' active · ' || {inr_sql('total_annual_premium', 2)} || '/yr' AS headline,
 CASE WHEN n_bad > 0 THEN n_bad || ' in cancellation / grace'
  ELSE 'Next renewal ' || coalesce(strftime(next_renewal_date, '%d %b %Y'), '—') END AS sub FROM wide
UNION ALL SELECT customer_id, 'claims', n_clm,
 CASE WHEN n_rejected > 0 OR n_slow_claims > 0 THEN 'bad' WHEN n_open > 0 THEN 'warn' ELSE 'good' END,
 CASE WHEN n_clm > 0 THEN n_open || ' open · ' || n_rejected || ' rejected' ELSE 'No claims filed' END,
 CASE WHEN max_open_claim_days > 0 THEN 'Oldest open: ' || max_open_claim_days || ' days'
  ELSE 'Avg settle ' || coalesce(CAST(floor(nullif(avg_days_to_settle, 0) + 0.5) AS INT) || 'd', '—') END FROM wide
UNION ALL SELECT customer_id, 'payments', n_pay,
 CASE WHEN n_missed > 0 THEN 'bad' WHEN n_late > 0 THEN 'warn' ELSE 'good' END,
 n_late || ' late · ' || n_missed || ' missed',
 'On-time rate ' || coalesce(CAST(floor(on_time_rate_12m * 100 + 0.5) AS INT) || '%', '—') || ' (12m)' FROM wide
UNION ALL SELECT customer_id, 'calls', n_ins,
 CASE WHEN n_cancel > 0 OR coalesce(mood, 0) < -0.2 THEN 'bad' WHEN coalesce(mood, 0) < 0.2 THEN 'warn' ELSE 'good' END,
 n_ins || ' calls · sentiment ' || coalesce({f2('mood')}, '—'),
 'Last intent: ' || replace(coalesce(last_intent, '—'), '_', ' ') FROM wide""")
def _(c):
    b = c.book
    return serving.source_health(b.c360, b.policies, b.claims, b.payments, b.insights)


@query("evidence_detail", """SELECT e.customer_id, CAST(nth - 1 AS INT) AS position, e.transcript_id, call_ts,
 primary_intent, sentiment_score, summary FROM evidence e JOIN insights USING (transcript_id)""")
def _(c):
    return serving.evidence_detail(c.book.nba, c.book.call_transcripts, AS_OF, WORDING)


@query("recent_payments", """SELECT payment_id, customer_id, due_date, amount_due, payment_status, days_late,
 CAST(row_number() OVER (PARTITION BY customer_id ORDER BY due_date DESC, payment_id DESC) AS INT) AS nth
 FROM payments QUALIFY nth <= 12""")
def _(c):
    return serving.recent_payments(c.book.payments).select(
        "payment_id", "customer_id", "due_date", "amount_due", "payment_status", "days_late", "nth")


@query("customer_index", f"""SELECT customer_id, full_name || ' · ' || customer_id || ' · ' || city || ' · ' || risk_band
 || ' ' || {f2('risk_score', 0)} AS label, risk_score FROM nba""")
def _(c):
    return serving.customer_index(c.book.nba)


@query("customer_search", """SELECT customer_id, full_name, city, product_lines, segment, risk_score, risk_band FROM nba
 WHERE contains(lower(concat_ws(' ', customer_id, full_name, city, product_lines, segment)), 'nation_7')
 ORDER BY risk_score DESC, customer_id LIMIT 8""")
def _(c):
    return serving.customer_search(c.book.nba, " Nation_7 ")


@query("filter_options", "SELECT DISTINCT 'segment' AS field, segment AS value FROM nba UNION ALL "
       "SELECT DISTINCT 'city', city FROM nba")
def _(c):
    return serving.filter_options(c.book.nba)


@query("renewal_line", f"""SELECT customer_id, next_renewal_plan || ' (' || next_renewal_policy_id || ') on ' ||
 strftime(next_renewal_date, '%d %b %Y') || ' · ' || {inr_sql('next_renewal_premium', 1)} AS renewal_line FROM c360
 WHERE next_renewal_date IS NOT NULL""")
def _(c):
    return serving.renewal_line(c.book.c360)


# --- portfolio -----------------------------------------------------------------------------------
COHORT = dict(products=("Health", "Life"), segments=("BUILDING", "MACHINERY"), cities=CITIES[:12])
COHORT_SQL = """(SELECT * FROM nba WHERE segment IN ('BUILDING', 'MACHINERY') AND city IN ({cities})
 AND customer_id IN (SELECT customer_id FROM policies WHERE product_line IN ('Health', 'Life'))) cohort""".format(
    cities=", ".join(f"'{city}'" for city in CITIES[:12]))


def cohort_of(c: Context) -> DataFrame:
    return portfolio.portfolio_filter(c.book.nba, c.book.policies, **COHORT)


@query("portfolio_filter", f"SELECT customer_id, segment, city, risk_band FROM {COHORT_SQL}")
def _(c):
    return cohort_of(c).select("customer_id", "segment", "city", "risk_band")


KPI_SQL = """SELECT count(*) AS n_customers, count(*) FILTER (risk_band = 'High') AS n_high,
 count(*) FILTER (risk_band = 'High') / count(*) AS high_share,
 CAST(sum(total_annual_premium) AS BIGINT) AS premium,
 CAST(coalesce(sum(total_annual_premium) FILTER (risk_band = 'High'), 0) AS BIGINT) AS high_premium,
 CAST(coalesce(sum(total_annual_premium) FILTER (risk_band = 'High'), 0) AS DOUBLE) / CAST(sum(total_annual_premium)
  AS DOUBLE) AS high_premium_share, sum(expected_premium_loss) AS expected_loss,
 count(*) FILTER (risk_band = 'High' AND days_to_renewal <= 30) AS high_renewals_30d FROM """


@query("portfolio_kpis", KPI_SQL + "nba")
def _(c):
    return portfolio.portfolio_kpis(c.book.nba)


@query("portfolio_kpis_cohort", KPI_SQL + COHORT_SQL)
def _(c):
    return portfolio.portfolio_kpis(cohort_of(c))


def _band_sums(value: str) -> str:
    return ", ".join(f"CAST(coalesce(sum({value}) FILTER (risk_band = '{b}'), 0) AS BIGINT) AS {b.lower()}"
                     for b in K.BANDS)


@query("premium_by_product_band", f"""SELECT product_line, {_band_sums('annual_premium')} FROM policies
 JOIN (SELECT customer_id, risk_band FROM nba) n USING (customer_id) WHERE status <> 'Lapsed' GROUP BY product_line""")
def _(c):
    return portfolio.premium_by_product_band(c.book.nba, c.book.policies)


@query("intent_by_sentiment", """SELECT primary_intent, count(*) FILTER (sentiment_label = 'negative') AS negative,
 count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'positive') AS positive,
 count(*) AS n_calls FROM recent WHERE customer_id IN (SELECT customer_id FROM nba) GROUP BY primary_intent""")
def _(c):
    return portfolio.intent_by_sentiment(c.book.nba, c.book.insights, AS_OF)


@query("renewal_pipeline", f"""SELECT CAST(date_trunc('week', renewal_date) AS DATE) AS week,
 {_band_sums('annual_premium')} FROM policies JOIN (SELECT customer_id, risk_band FROM nba) n USING (customer_id)
 WHERE renewal_date BETWEEN DATE '2001-11-05' AND DATE '2001-11-05' + 90 GROUP BY 1""")
def _(c):
    return portfolio.renewal_pipeline(c.book.nba, c.book.policies, AS_OF)


@query("plays", "SELECT action_category, count(*) AS n_customers FROM nba GROUP BY action_category")
def _(c):
    return portfolio.plays(c.book.nba)


@query("call_list", """SELECT customer_id, full_name, city, segment, risk_score, risk_band, total_annual_premium,
 next_renewal_product, days_to_renewal, coalesce(top_three_points, '') AS top_drivers, action FROM nba
 LEFT JOIN top_text USING (customer_id) ORDER BY risk_score DESC, total_annual_premium DESC, customer_id LIMIT 25""")
def _(c):
    return portfolio.call_list(c.book.nba)


@query("at_risk_list", f"""SELECT customer_id, full_name, segment, city, risk_score, risk_band, premium_at_risk,
 {inr_sql('premium_at_risk', 2)} AS premium_label, action_category FROM nba WHERE risk_band <> 'Low'
 ORDER BY premium_at_risk DESC, risk_score DESC, customer_id LIMIT 20""")
def _(c):
    return portfolio.at_risk_list(c.book.nba)


@query("portfolio_summary", f"""SELECT count(*) AS n_customers,
 count(*) FILTER (risk_band = 'High') / count(*) * 100 AS pct_high_risk,
 CAST(sum(premium_at_risk) AS BIGINT) AS premium_at_risk, sum(expected_premium_loss) AS expected_premium_loss,
 CAST(sum(total_annual_premium) AS BIGINT) AS total_premium,
 (SELECT count(*) FROM insights) AS n_transcripts, {r('''(SELECT
 CAST(sum(CAST(round(sentiment_score * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 FROM insights)''', 6)}
 AS avg_sentiment FROM nba""")
def _(c):
    totals = portfolio.portfolio_totals(c.book.nba, c.book.insights)
    return totals.withColumn("avg_sentiment", F.rint(F.col("avg_sentiment") * 1e6) / 1e6)


@query("portfolio_breakdown", """SELECT 'risk_bands' AS section, risk_band AS name, count(*) AS n FROM nba GROUP BY 2
 UNION ALL SELECT 'actions', action_category, count(*) FROM nba GROUP BY 2
 UNION ALL SELECT 'intents', primary_intent, count(*) FROM insights GROUP BY 2""")
def _(c):
    return portfolio.portfolio_breakdown(c.book.nba, c.book.insights)


@query("risk_histogram", """SELECT low || '-' || (low + 9) AS bucket, count(customer_id) AS n_customers
 FROM range(0, 100, 10) b(low) LEFT JOIN nba ON risk_score >= low AND risk_score < low + 10 GROUP BY low""")
def _(c):
    return portfolio.risk_histogram(c.book.nba)


@query("inr_label", f"""SELECT policy_id, {inr_sql('sum_insured', 1)} AS one_decimal,
 {inr_sql('annual_premium', 2)} AS two_decimals FROM policies""")
def _(c):
    return c.book.policies.select("policy_id", inr_label(F.col("sum_insured"), 1).alias("one_decimal"),
                                  inr_label(F.col("annual_premium"), 2, indian_groups=True).alias("two_decimals"))


# --- questions -----------------------------------------------------------------------------------
def answer(c: Context, question: str) -> ask.Answer:
    b = c.book
    return ask.ask(question, b.nba, b.policies, b.insights, AS_OF, CITIES, SEGMENTS, WORDING)


def _policies_where(condition: str) -> str:
    return f"(SELECT * FROM policies WHERE status <> 'Lapsed' AND {condition}) m"


def _called(intent: str) -> str:
    return f"customer_id IN (SELECT customer_id FROM recent WHERE primary_intent = '{intent}')"


NEXT_MONTH = "renewal_date BETWEEN DATE '2001-12-01' AND DATE '2001-12-31'"
NEXT_30 = "renewal_date BETWEEN DATE '2001-11-05' AND DATE '2001-12-05'"
HEALTH_RENEWALS = _policies_where(f"product_line = 'Health' AND {NEXT_MONTH}")
ASK_HEALTH = "Which health policyholders renewing next month are at high churn risk and why?"
ASK_PLACE = "How much premium is at risk in NATION_7?"
ASK_TOP = "Top 10 customers threatening to cancel"
ASK_SEGMENT = "Which BUILDING customers are interested in upsell?"
ASK_CLAIMS = "Customers with claim complaints renewing in the next 30 days"
ASK_PERSON = "What should I do for Customer#000000012?"


def _policy_table(policies: str, condition: str) -> str:
    return f"""SELECT customer_id, full_name, city, segment, risk_score, risk_band, n_policies, renewal_date,
 policy_premium, total_annual_premium, coalesce(top_three, '') AS top_drivers, action FROM nba
 JOIN (SELECT customer_id, count(*) AS n_policies, CAST(sum(annual_premium) AS BIGINT) AS policy_premium,
 min(renewal_date) AS renewal_date FROM {policies} GROUP BY customer_id) p USING (customer_id)
 LEFT JOIN top_text USING (customer_id) WHERE {condition}"""


def _plain_table(condition: str, tail: str = "") -> str:
    return f"""SELECT customer_id, full_name, city, segment, risk_score, risk_band, next_renewal_product,
 next_renewal_date, total_annual_premium, coalesce(top_three, '') AS top_drivers, action FROM nba
 LEFT JOIN top_text USING (customer_id) WHERE {condition} {tail}"""


@query("ask_health_renewals", _policy_table(HEALTH_RENEWALS, "risk_band = 'High'"))
def _(c):
    return answer(c, ASK_HEALTH).table


@query("ask_premium_in_place", f"""SELECT n_customers, premium, expected_loss, {inr_sql('premium', 1)} AS premium_label,
 {inr_sql('expected_loss', 1)} AS expected_loss_label FROM (SELECT count(*) AS n_customers,
 CAST(coalesce(sum(total_annual_premium), 0) AS BIGINT) AS premium, coalesce(sum(expected_premium_loss), 0)
 AS expected_loss FROM nba WHERE city = 'NATION_7' AND risk_band IN ('High', 'Medium')) t""")
def _(c):
    return answer(c, ASK_PLACE).totals


@query("ask_top_cancelling", _plain_table(_called("cancellation_intent"),
                                          "ORDER BY risk_score DESC, customer_id LIMIT 10"))
def _(c):
    return answer(c, ASK_TOP).table


@query("ask_segment_upsell", _plain_table(f"segment = 'BUILDING' AND {_called('upsell_interest')}"))
def _(c):
    return answer(c, ASK_SEGMENT).table


@query("ask_claims_renewing", _policy_table(_policies_where(NEXT_30), _called("claim_issue")))
def _(c):
    return answer(c, ASK_CLAIMS).table


@query("ask_lookup_customer", """SELECT customer_id, full_name, risk_band, risk_score,
 coalesce(top_three_listed, '') AS drivers, action, coalesce(nullif(replace(evidence, ',', ', '), ''), '—') AS evidence
 FROM nba LEFT JOIN top_text USING (customer_id) WHERE full_name = 'Customer#000000012'""")
def _(c):
    return answer(c, ASK_PERSON).customer


@query("ask_policy_window", f"""SELECT customer_id, count(*) AS n_policies, min(renewal_date) AS renewal_date,
 CAST(sum(annual_premium) AS BIGINT) AS policy_premium FROM {HEALTH_RENEWALS} GROUP BY customer_id""")
def _(c):
    spec = ask.read_question(ASK_HEALTH, AS_OF)
    return ask.ask_policy_window(c.book.policies, spec.products, spec.window)


@query("ask_policy_list", "SELECT customer_id, renewal_date, policy_id FROM policies WHERE status <> 'Lapsed'")
def _(c):
    return ask.ask_policy_list(c.book.policies)


WINDOWS = {
    "renewing next month": "DATE '2001-12-01' AND DATE '2001-12-31'",
    "renewing this month": "DATE '2001-11-05' AND DATE '2001-11-30'",
    "due next week": "DATE '2001-11-05' AND DATE '2001-11-12'",
    "due in the next 45 days": "DATE '2001-11-05' AND DATE '2001-12-20'",
    "up for renewal": "DATE '2001-11-05' AND DATE '2002-01-04'",
}


@query("renewal_window", " UNION ALL ".join(
    f"SELECT '{q}' AS question, count(*) AS n_policies FROM policies WHERE renewal_date BETWEEN {w}"
    for q, w in WINDOWS.items()))
def _(c):
    spans = [(q, ask.renewal_window(q, AS_OF)) for q in WINDOWS]
    asked = F.array(*[F.when(F.col("renewal_date").between(F.lit(a), F.lit(b)), F.lit(q)) for q, (a, b) in spans])
    return (c.book.policies.select(F.explode(F.array_compact(asked)).alias("question"))
            .groupBy("question").agg(F.count("*").alias("n_policies")))


@query("ask_risk_filter", "SELECT risk_band, count(*) AS n FROM nba WHERE risk_band IN ('High', 'Medium') GROUP BY 1")
def _(c):
    bands = ask.read_question("Who might leave us?", AS_OF).bands
    return ask.ask_risk_filter(c.book.nba, bands).groupBy("risk_band").agg(F.count("*").alias("n"))


@query("ask_place_segment", "SELECT customer_id, city, segment FROM nba WHERE city = 'NATION_7' "
       "AND segment = 'FURNITURE'")
def _(c):
    spec = ask.read_question("Furniture customers in nation_7", AS_OF, CITIES, SEGMENTS)
    return ask.ask_place_segment(c.book.nba, spec.cities, spec.segment).select("customer_id", "city", "segment")


@query("ask_intent_filter", f"SELECT customer_id FROM nba WHERE {_called('claim_issue')} AND {_called('price_concern')}")
def _(c):
    return ask.ask_intent_filter(c.book.nba, c.book.insights, (K.CLAIM, K.PRICE), AS_OF).select("customer_id")


@query("ask_top_n", "SELECT customer_id, risk_score FROM nba ORDER BY risk_score DESC, customer_id LIMIT 7")
def _(c):
    top = ask.read_question("top 7", AS_OF).top
    return ask.ask_top_n(c.book.nba, top).select("customer_id", "risk_score")


@query("ask_answer_totals", f"""SELECT n_customers, premium, expected_loss, {inr_sql('premium', 1)} AS premium_label,
 {inr_sql('expected_loss', 1)} AS expected_loss_label FROM (SELECT count(*) AS n_customers,
 CAST(coalesce(sum(total_annual_premium), 0) AS BIGINT) AS premium, coalesce(sum(expected_premium_loss), 0)
 AS expected_loss FROM nba WHERE risk_band = 'High' AND customer_id IN (SELECT customer_id FROM {HEALTH_RENEWALS})) t""")
def _(c):
    return answer(c, ASK_HEALTH).totals


@query("ask_driver_frequency", """SELECT factor, count(*) AS n_customers FROM drivers WHERE points > 0
 AND customer_id IN (SELECT customer_id FROM nba WHERE segment = 'BUILDING')
 GROUP BY factor ORDER BY n_customers DESC, factor LIMIT 3""")
def _(c):
    return ask.ask_driver_frequency(c.book.nba.where(F.col("segment") == "BUILDING"))


@query("ask_plays", f"""SELECT action_category, count(*) AS n_customers FROM nba WHERE {_called('claim_issue')}
 AND customer_id IN (SELECT customer_id FROM {_policies_where(NEXT_30)})
 GROUP BY action_category ORDER BY n_customers DESC, action_category LIMIT 3""")
def _(c):
    return answer(c, ASK_CLAIMS).plays


@query("ask_table", _plain_table("risk_band = 'High'"))
def _(c):
    return ask.ask_table(ask.CohortSpec(), ask.ask_risk_filter(c.book.nba, ["High"]))


@query("governed_select", """SELECT segment, risk_band, count(*) AS n, CAST(sum(total_annual_premium) AS BIGINT) AS premium
 FROM nba GROUP BY segment, risk_band""")
def _(c):
    return ask.governed_select(
        c.spark, "```sql\nSELECT segment, risk_band, count(*) AS n, sum(total_annual_premium) AS premium "
        "FROM next_best_actions GROUP BY segment, risk_band;\n```",
        lambda session: make_book(session, c.folder).queryable)


@query("governed_select_log", """SELECT segment, status, count(*) AS n, max(a.note) AS note FROM status a
 JOIN nba USING (customer_id) GROUP BY segment, status""")
def _(c):
    return ask.governed_select(
        c.spark, "SELECT segment, status, count(*) AS n, max(a.note) AS note FROM app.action_status a "
        "JOIN app.next_best_actions USING (customer_id) GROUP BY segment, status",
        lambda session: make_book(session, c.folder).queryable, rows=1000)


@query("ask_policies", f"""SELECT customer_id, renewal_date, policy_id FROM {HEALTH_RENEWALS}
 WHERE customer_id IN (SELECT customer_id FROM nba WHERE risk_band = 'High')""")
def _(c):
    return answer(c, ASK_HEALTH).policies


@query("ask_filters", """SELECT 'renewing 2001-12-01 to 2001-12-31; product: Health; risk: High' AS filters, count(*) AS n_customers
 FROM nba WHERE risk_band = 'High' AND customer_id IN (SELECT customer_id FROM """ + HEALTH_RENEWALS + ")")
def _(c):
    told = answer(c, ASK_HEALTH)
    return told.totals.select(F.lit("; ".join(told.spec.filters)).alias("filters"), "n_customers")


ASKED = (ASK_HEALTH, ASK_PLACE, ASK_TOP, ASK_SEGMENT, ASK_CLAIMS)


def batch(c: Context) -> tuple[DataFrame, DataFrame]:
    b = c.book
    questions = c.spark.createDataFrame(list(enumerate(ASKED)), "question_id bigint, question string")
    specs = ask_batch.read_questions(questions, AS_OF, CITIES, SEGMENTS)
    return specs, ask_batch.cohorts(specs, b.nba, b.policies, b.insights, AS_OF)


_AT_RISK_PLACE = "city = 'NATION_7' AND risk_band IN ('High', 'Medium')"
_TOP_CALLERS = f"(SELECT customer_id FROM nba WHERE {_called('cancellation_intent')} ORDER BY risk_score DESC, customer_id LIMIT 10)"
_COHORTS = (f"risk_band = 'High' AND customer_id IN (SELECT customer_id FROM {HEALTH_RENEWALS})", _AT_RISK_PLACE,
            f"customer_id IN {_TOP_CALLERS}", f"segment = 'BUILDING' AND {_called('upsell_interest')}",
            f"{_called('claim_issue')} AND customer_id IN (SELECT customer_id FROM {_policies_where(NEXT_30)})")


@query("ask_batch_totals", f"""SELECT question_id, n_customers, premium, expected_loss, {inr_sql('premium', 1)} AS premium_label,
 {inr_sql('expected_loss', 1)} AS expected_loss_label FROM (""" + " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS question_id, count(*) AS n_customers, CAST(coalesce(sum(total_annual_premium), 0) AS BIGINT) AS premium,
 coalesce(sum(expected_premium_loss), 0) AS expected_loss FROM nba WHERE {where}""" for i, where in enumerate(_COHORTS)) + ") t")
def _(c):
    return ask_batch.batch_totals(*batch(c))


_SHOWN = "customer_id, full_name, city, segment, risk_score, risk_band, total_annual_premium, top_drivers, action"


@query("ask_batch_table", " UNION ALL ".join(
    [f"SELECT CAST({i} AS BIGINT) AS question_id, {_SHOWN}, n_policies, renewal_date, policy_premium, "
     f"CAST(NULL AS VARCHAR) AS next_renewal_product, CAST(NULL AS DATE) AS next_renewal_date FROM ({sql}) t"
     for i, sql in ((0, _policy_table(HEALTH_RENEWALS, "risk_band = 'High'")), (4, _policy_table(_policies_where(NEXT_30), _called("claim_issue"))))]
    + [f"SELECT CAST({i} AS BIGINT) AS question_id, {_SHOWN}, CAST(NULL AS BIGINT) AS n_policies, CAST(NULL AS DATE) AS renewal_date, "
       f"CAST(NULL AS BIGINT) AS policy_premium, next_renewal_product, next_renewal_date FROM ({_plain_table(_COHORTS[i])}) t" for i in (1, 2, 3)]))
def _(c):
    return ask_batch.batch_table(batch(c)[1])


def _most_frequent_of_each(counted: str, name: str) -> str:
    return f"""SELECT question_id, {name}, n_customers FROM (SELECT question_id, {name}, count(*) AS n_customers,
 row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, {name}) AS nth FROM {counted} GROUP BY question_id, {name}) t
 WHERE nth <= 3"""


_ASKED_ABOUT = "(" + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS question_id, customer_id, action_category FROM nba WHERE {where}" for i, where in enumerate(_COHORTS)) + ") m"


@query("ask_batch_drivers", _most_frequent_of_each(f"{_ASKED_ABOUT} JOIN drivers USING (customer_id) WHERE points > 0", "factor"))
def _(c):
    return ask_batch.batch_drivers(batch(c)[1])


@query("ask_batch_plays", _most_frequent_of_each(_ASKED_ABOUT, "action_category"))
def _(c):
    return ask_batch.batch_plays(batch(c)[1])


@query("ask_batch_policies", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS question_id, customer_id, renewal_date, policy_id FROM {meant} "
    f"WHERE customer_id IN (SELECT customer_id FROM nba WHERE {who})"
    for i, meant, who in ((0, HEALTH_RENEWALS, "risk_band = 'High'"), (4, _policies_where(NEXT_30), _called("claim_issue")))))
def _(c):
    specs, cohort = batch(c)
    return ask_batch.batch_policies(specs, cohort, c.book.policies)


@query("lookup_batch", """SELECT CAST(substr(asked.customer_id, 2) AS BIGINT) AS question_id, nba.customer_id, nba.full_name, nba.risk_band,
 nba.risk_score, coalesce(top_three_listed, '') AS drivers, nba.action,
 coalesce(nullif(replace(nba.evidence, ',', ', '), ''), '—') AS evidence
 FROM nba asked JOIN nba ON nba.customer_id = (SELECT min(x.customer_id) FROM nba x WHERE x.full_name = asked.full_name)
 LEFT JOIN top_text ON top_text.customer_id = nba.customer_id""")
def _(c):
    """On the actions written once: questions, ids, names and answers are read from them."""
    nba = io.snapshot_360(c.book.nba, c.scratch("nba"))
    questions = nba.select(F.expr("substr(customer_id, 2)").cast("bigint").alias("question_id"),
                           F.concat(F.lit("What about "), "full_name", F.lit("?")).alias("question"))
    return ask_batch.lookup_batch(questions, nba, WORDING)


@query("customer_search_batch", """SELECT needle_id, needle_id AS text, customer_id, full_name, city, product_lines, segment, risk_score, risk_band
 FROM (SELECT w.needle_id, nba.*, row_number() OVER (PARTITION BY w.needle_id ORDER BY risk_score DESC, customer_id) AS nth
       FROM (SELECT DISTINCT city AS needle_id FROM nba UNION SELECT DISTINCT segment FROM nba UNION SELECT substr(city, 8) FROM nba) w
       JOIN nba ON contains(lower(concat_ws(' ', customer_id, full_name, city, product_lines, segment)), lower(w.needle_id))) t
 WHERE nth <= 8""")
def _(c):
    nba = c.book.nba
    values = F.array("city", "segment", F.expr("substr(city, 8)"))
    needles = nba.select(F.explode(values).alias("needle_id")).distinct().withColumn("text", F.col("needle_id"))
    return ask_batch.customer_search_batch(nba, needles)


# --- search --------------------------------------------------------------------------------------
CALL_SEARCHES = (
    search.SearchQuery("stuck_claim", "hospital discharge summary submitted twice, claim still pending",
                       {"sentiment_label": "negative", "primary_intent": "claim_issue"}),
    search.SearchQuery("leaving", "cancel or port my policy"),
    search.SearchQuery("pricing", "premium hike, cheaper plan online", {"primary_intent": "price_concern"}),
)
DOCUMENT_SEARCHES = tuple(
    search.SearchQuery(f"label_{i}", text) for i, text in enumerate((
        "there and the threeaing by", "license of the", "les mentre que la", "der und die", "el los de",
        "reader email address", "that with tion", "on the it is", "whst for and", "in ing on")))
CORPUS_SQL = f"""SELECT transcript_id, customer_id, coalesce(policy_id, '') AS policy_id,
 strftime(call_ts, '%Y-%m-%d') AS call_date, primary_intent, sentiment_label, {f2('sentiment_score')} AS sentiment_score,
 summary, transcript_text, summary || chr(10) || transcript_text AS search_text FROM insights"""


def _bm25(docs: str, id_column: str, text_column: str, searches, k: int, per: str = "", members: str = "") -> str:
    """Ranked BM25 rows. `docs` is a sub-query with the id, the text and the filter columns."""
    wanted = ", ".join(f"('{q.query_id}', '{t}', {n})" for q in searches for t, n in sorted(q.terms.items()))
    passes = " OR ".join(
        f"(w.query_id = '{q.query_id}'" + "".join(f" AND d.{c} = '{v}'" for c, v in q.filters.items()) + ")"
        for q in searches)
    extra = f", d.{per}" if per else ""
    keep = f"AND d.{per} IN ({members})" if members else ""
    return f"""SELECT query_id{extra.replace('d.', '')}, {id_column}, CAST(rank AS INT) AS rank,
 {r('score', 6)} AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id{extra.replace('d.', '')}
  ORDER BY round(score, 9) DESC, {id_column}) AS rank FROM (
 SELECT w.query_id{extra}, d.{id_column}, sum(w.n * ln(1 + (s.n_docs - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) *
  t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / (s.total / s.n_docs)))) AS score
 FROM (VALUES {wanted}) w(query_id, term, n)
 JOIN tf t ON t.term = w.term JOIN df f ON f.term = w.term JOIN lens l ON l.id = t.id
 JOIN docs d ON d.{id_column} = t.id CROSS JOIN sizes s WHERE ({passes}) {keep} GROUP BY ALL) a) b WHERE rank <= {k}"""


def _bm25_check(docs: str, id_column: str, text_column: str, searches, k: int, per: str = "", members: str = "",
                final: str = "SELECT * FROM ranked") -> str:
    return f"""WITH docs AS MATERIALIZED ({docs}), words AS MATERIALIZED (SELECT {id_column} AS id, unnest(list_filter(
 regexp_split_to_array(lower({text_column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM docs),
 lens AS (SELECT {id_column} AS id, len(list_filter(regexp_split_to_array(lower({text_column}),
 '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS len FROM docs),
 sizes AS (SELECT count(*) AS n_docs, CAST(sum(len) AS DOUBLE) AS total FROM lens),
 tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 ranked AS ({_bm25(docs, id_column, text_column, searches, k, per, members)}) {final}"""


def shown_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.rint(F.col("score") * 1e6) / 1e6)


@query("search_corpus", CORPUS_SQL)
def _(c):
    return search.search_corpus(c.book.insights)


@query("keyword_search", _bm25_check(CORPUS_SQL, "transcript_id", "search_text", CALL_SEARCHES, 5))
def _(c):
    return shown_score(search.keyword_search(search.search_corpus(c.book.insights), CALL_SEARCHES))


@query("keyword_search_documents", _bm25_check("SELECT doc_id, text FROM documents", "doc_id", "text",
                                               DOCUMENT_SEARCHES, 10))
def _(c):
    return shown_score(search.keyword_search(c.table("documents"), DOCUMENT_SEARCHES, 10, "doc_id", "text"))


CENTROIDS_SQL = """(SELECT label, list(mean ORDER BY i) AS centre FROM (
 SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM (
 SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) a GROUP BY ALL) b GROUP BY label)"""


def label_centres(vectors: DataFrame) -> DataFrame:
    """Mean vector per label, as the vectors to search for."""
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("mean"))
    centre = F.transform(F.sort_array(F.collect_list(F.struct("i", "mean"))), lambda p: p.getField("mean"))
    return means.groupBy("label").agg(centre.alias("query_vector")).withColumn(
        "query_id", F.concat(F.lit("label_"), F.col("label").cast("string")))


def _nearest(join: str, k: int) -> str:
    return f"""SELECT 'label_' || c.label AS query_id, vec_id, CAST(row_number() OVER (PARTITION BY c.label ORDER BY
 round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 9) DESC, vec_id) AS INT) AS rank,
 {r('list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre)', 6)} AS score
 FROM embeddings e JOIN {CENTROIDS_SQL} c ON {join} QUALIFY rank <= {k}"""


@query("vector_search", _nearest("true", 5))
def _(c):
    vectors = c.table("embeddings")
    return shown_score(search.vector_search(vectors, label_centres(vectors).drop("label")))


@query("vector_search_filtered", _nearest("e.label = c.label", 5))
def _(c):
    vectors = c.table("embeddings")
    return shown_score(search.vector_search(vectors, label_centres(vectors), on=["label"]))


@query("vector_search_index", _nearest("e.label = c.label", 5))
def _(c):
    """On a stored index that two loads have filled; further cells are read while one may hold a nearer vector."""
    path, vectors = c.scratch("vectors"), c.table("embeddings")
    vector_index.append_vectors(vectors.where("vec_id % 4 > 0"), path, ["label"])
    vector_index.append_vectors(vectors, path, ["label"])
    found = vector_index.search_vector_index(label_centres(vectors), path, on=["label"], exact=True)
    return shown_score(found.withColumnRenamed("id", "vec_id"))


@query("hybrid_search", _bm25_check(
    "SELECT doc_id, text FROM documents", "doc_id", "text", DOCUMENT_SEARCHES, 20, final=f"""
 SELECT query_id, doc_id, {r('score', 6)} AS score, CAST(row_number() OVER (PARTITION BY query_id
 ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM (
 SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM ranked
 UNION ALL SELECT query_id, vec_id, rank FROM ({_nearest('true', 20)}) v) u GROUP BY ALL) g QUALIFY rank <= 5"""))
def _(c):
    vectors = c.table("embeddings")
    by_text = search.keyword_search(c.table("documents"), DOCUMENT_SEARCHES, 20, "doc_id", "text")
    by_vector = search.vector_search(vectors, label_centres(vectors).drop("label"), 20)
    return shown_score(search.hybrid_search(by_text, by_vector.withColumnRenamed("vec_id", "doc_id")))


@query("hybrid_search_index")
def _(c):
    """Both lists from stored indexes."""
    texts, vectors, path = c.table("documents"), c.table("embeddings"), c.scratch("index")
    none = [F.lit(None).cast("string").alias(name) for name in (*search_index.CARRIED, "summary")]
    search_index.append_index(texts.select("doc_id", "text", *none), f"{path}/texts", "doc_id", "text")
    vector_index.append_vectors(vectors, f"{path}/vectors")
    asked = c.spark.createDataFrame([(q.query_id, q.text) for q in DOCUMENT_SEARCHES], "query_id string, text string")
    by_text = search_index.search_index(asked, f"{path}/texts", 20)
    by_vector = vector_index.search_vector_index(label_centres(vectors).drop("label"), f"{path}/vectors", 20, exact=True)
    fused = search.hybrid_search(by_text, by_vector, id_column="id")
    return shown_score(fused.withColumnRenamed("id", "doc_id"))


@query("keyword_search_index", _bm25_check(CORPUS_SQL, "transcript_id", "search_text", CALL_SEARCHES, 5, final="""
 SELECT query_id, transcript_id AS id, rank, score, customer_id, call_date, primary_intent, sentiment_label, summary
 FROM ranked JOIN (SELECT transcript_id, customer_id, call_date, primary_intent, sentiment_label, summary FROM docs) d
 USING (transcript_id)"""))
def _(c):
    """On a stored index that older calls began and newer ones were added to."""
    path, corpus = c.scratch("index"), io.snapshot_360(search.search_corpus(c.book.insights), c.scratch("corpus"))
    search_index.append_index(corpus.where("call_date < '2001-10-06'"), path)
    search_index.append_index(corpus, path)
    asked = [(q.query_id, q.text, q.filters.get("primary_intent"), q.filters.get("sentiment_label")) for q in CALL_SEARCHES]
    queries = c.spark.createDataFrame(asked, "query_id string, text string, primary_intent string, sentiment_label string")
    return shown_score(search_index.search_index(queries, path))


LEAVING = search.SearchQuery("leaving", "cancel or port my policy")


@query("customer_evidence_search", _bm25_check(CORPUS_SQL, "transcript_id", "search_text", [LEAVING], 3, "customer_id"))
def _(c):
    return shown_score(search.customer_evidence_search(search.search_corpus(c.book.insights), LEAVING))


@query("cohort_with_evidence", _bm25_check(
    CORPUS_SQL, "transcript_id", "search_text", [LEAVING], 5, "customer_id",
    "SELECT customer_id FROM nba WHERE risk_band = 'High'", """
 SELECT customer_id, full_name, risk_band, risk_score, action, channel, coalesce(citations, '') AS citations FROM nba
 LEFT JOIN (SELECT customer_id, string_agg('[' || transcript_id || ']', ' ' ORDER BY rank) AS citations FROM ranked
 GROUP BY customer_id) x USING (customer_id) WHERE risk_band = 'High'"""))
def _(c):
    high = c.book.nba.where(F.col("risk_band") == "High")
    return search.cohort_with_evidence(high, search.search_corpus(c.book.insights), LEAVING)


def evidence_index(c: Context) -> tuple[str, DataFrame]:
    """A stored index of all calls, and what is asked of it."""
    path = c.scratch("index")
    search_index.append_index(search.search_corpus(c.book.insights), path)
    return path, c.spark.createDataFrame([(LEAVING.query_id, LEAVING.text)], "query_id string, text string")


@query("customer_evidence_search_index")
def _(c):
    path, asked = evidence_index(c)
    found = search_index.search_index(asked, path, 3, "customer_id")
    return shown_score(found.select("query_id", "customer_id", F.col("id").alias("transcript_id"), "rank", "score"))


@query("cohort_with_evidence_index")
def _(c):
    """The cohort is worked out once, before the index is there: it says who is searched and who is shown."""
    with shuffles_dropped(c.spark):
        high = io.snapshot_360(c.book.nba.where(F.col("risk_band") == "High").select(*search.COHORT), c.scratch("high"))
    path, asked = evidence_index(c)
    found = search_index.search_index(asked, path, 5, "customer_id", high)
    return search.with_citations(high, found.withColumnRenamed("id", "transcript_id"))


@query("refresh_corpus", CORPUS_SQL + " WHERE call_ts >= TIMESTAMP '2001-10-06'")
def _(c):
    stored = c.book.call_transcripts.where(F.col("call_ts") < F.lit("2001-10-06").cast("timestamp_ntz"))
    return search.refresh_corpus(c.book.insights, stored)


# --- semantic layer ------------------------------------------------------------------------------
C360_METRICS_SQL = f"""count(*) AS customer_count, CAST(sum(total_annual_premium) AS BIGINT) AS book_premium,
 {r('avg(avg_days_to_settle)', 6)} AS avg_claim_settlement_days, CAST(sum(n_open_claims) AS BIGINT) AS open_claims,
 count(*) FILTER (days_to_renewal BETWEEN 0 AND 30) AS renewals_due_30d,
 CAST(sum(CASE WHEN days_to_renewal BETWEEN 0 AND 30 THEN next_renewal_premium ELSE 0 END) AS BIGINT)
  AS renewal_premium_due_30d"""
NBA_METRICS_SQL = f"""count(*) FILTER (risk_band = 'High') / count(*) AS churn_rate,
 count(*) FILTER (risk_band = 'High') AS high_risk_customers, {r('avg(risk_score)', 6)} AS avg_risk_score,
 CAST(sum(premium_at_risk) AS BIGINT) AS at_risk_premium, sum(expected_premium_loss) AS expected_loss"""
INS_METRICS_SQL = f"""count(*) AS call_count, {r('avg(sentiment_score)', 6)} AS avg_sentiment,
 count(*) FILTER (sentiment_label = 'negative') / count(*) AS negative_call_share,
 count(*) FILTER (primary_intent = 'cancellation_intent') AS cancellation_calls"""
NBA_NARROW = "(SELECT customer_id, risk_band, premium_at_risk, action_category FROM nba)"
AVERAGES = ("avg_claim_settlement_days", "avg_risk_score", "avg_sentiment")


def shown_metrics(df: DataFrame) -> DataFrame:
    """Averages at six decimals: the engines add doubles in different orders."""
    return df.withColumns({m: F.rint(F.col(m) * 1e6) / 1e6 for m in AVERAGES if m in df.columns})


@query("semantic_book", f"""SELECT * FROM (SELECT {C360_METRICS_SQL} FROM c360) a,
 (SELECT {NBA_METRICS_SQL} FROM nba) b, (SELECT {INS_METRICS_SQL} FROM insights) d""")
def _(c):
    return shown_metrics(semantic.semantic_query(c.book.logical_tables, [], list(semantic.METRICS)))


@query("semantic_by_segment", f"""SELECT * FROM (SELECT segment AS customer_segment, {C360_METRICS_SQL} FROM c360
 GROUP BY 1) a JOIN (SELECT segment AS customer_segment, {NBA_METRICS_SQL} FROM nba GROUP BY 1) b
 USING (customer_segment) JOIN (SELECT segment AS customer_segment, {INS_METRICS_SQL} FROM insights
 JOIN (SELECT customer_id, segment FROM c360) x USING (customer_id) GROUP BY 1) d USING (customer_segment)""")
def _(c):
    return shown_metrics(semantic.semantic_query(
        c.book.logical_tables, ["customer_segment"], list(semantic.METRICS)))


@query("semantic_by_segment_stored")
def _(c):
    return shown_metrics(semantic.semantic_query(keyed_book(c).logical_tables, ["customer_segment"], list(semantic.METRICS)))


@query("semantic_by_band", f"""SELECT risk_band AS churn_risk_band, count(*) AS customer_count,
 CAST(sum(premium_at_risk) AS BIGINT) AS at_risk_premium,
 count(*) FILTER (days_to_renewal BETWEEN 0 AND 30) AS renewals_due_30d FROM nba GROUP BY 1""")
def _(c):
    return semantic.semantic_query(c.book.logical_tables, ["churn_risk_band"],
                                   ["customer_count", "at_risk_premium", "renewals_due_30d"])


@query("semantic_by_call_intent", f"""SELECT * FROM (SELECT primary_intent AS call_intent, count(*) AS customer_count,
 CAST(sum(total_annual_premium) AS BIGINT) AS book_premium FROM c360
 JOIN (SELECT DISTINCT customer_id, primary_intent FROM insights) p USING (customer_id) GROUP BY 1) a
 JOIN (SELECT primary_intent AS call_intent, CAST(sum(premium_at_risk) AS BIGINT) AS at_risk_premium FROM nba
 JOIN (SELECT DISTINCT customer_id, primary_intent FROM insights) p USING (customer_id) GROUP BY 1) b USING (call_intent)
 JOIN (SELECT primary_intent AS call_intent, {INS_METRICS_SQL} FROM insights GROUP BY 1) d USING (call_intent)""")
def _(c):
    return shown_metrics(semantic.semantic_query(
        c.book.logical_tables, ["call_intent"],
        ["customer_count", "book_premium", "at_risk_premium", "call_count", "avg_sentiment", "negative_call_share",
         "cancellation_calls"]))


@query("semantic_by_call_intent_stored")
def _(c):
    return shown_metrics(semantic.semantic_query(
        keyed_book(c).logical_tables, ["call_intent"],
        ["customer_count", "book_premium", "at_risk_premium", "call_count", "avg_sentiment", "negative_call_share",
         "cancellation_calls"]))


@query("semantic_filtered", f"""SELECT city AS customer_city, risk_band AS churn_risk_band, count(*) AS customer_count,
 CAST(sum(total_annual_premium) AS BIGINT) AS book_premium, {NBA_METRICS_SQL} FROM nba
 JOIN (SELECT customer_id, has_health, state FROM c360) h USING (customer_id)
 WHERE has_health = 1 AND state IN ('ASIA', 'EUROPE') GROUP BY ALL""")
def _(c):
    return shown_metrics(semantic.semantic_query(
        c.book.logical_tables, ["customer_city", "churn_risk_band"],
        ["customer_count", "book_premium", "churn_rate", "high_risk_customers", "avg_risk_score", "at_risk_premium",
         "expected_loss"],
        where={"has_health_policy": True, "customer_state": ["ASIA", "EUROPE"]}))


def _metric(name: str) -> None:
    """One metric by risk band and segment."""
    table, expression, _ = semantic.METRICS[name]
    sql = {"c360": C360_METRICS_SQL, "nba": NBA_METRICS_SQL, "ins": INS_METRICS_SQL}[table]
    source = {
        "c360": f"c360 JOIN {NBA_NARROW} n USING (customer_id)",
        "nba": "nba",
        "ins": "insights JOIN (SELECT customer_id, segment, risk_band FROM nba) n USING (customer_id)",
    }[table]
    query(f"metric_{name}", f"""SELECT customer_segment, churn_risk_band, {name} FROM (
 SELECT segment AS customer_segment, risk_band AS churn_risk_band, {sql} FROM {source} GROUP BY ALL) t""")(
        lambda c: shown_metrics(semantic.semantic_query(
            c.book.logical_tables, ["customer_segment", "churn_risk_band"], [name])))


for _name in semantic.METRICS:
    _metric(_name)


@query("semantic_dimensions_customer", """SELECT customer_id AS cust_id, full_name AS customer_name, city AS customer_city,
 state AS customer_state, city_tier AS customer_city_tier, segment AS customer_segment,
 annual_income_band AS income_band, age AS customer_age, tenure_years AS customer_tenure_years,
 preferred_channel AS contact_channel, preferred_language AS contact_language, product_lines AS product_mix,
 has_health = 1 AS has_health_policy, has_life = 1 AS has_life_policy, has_motor = 1 AS has_motor_policy,
 has_home = 1 AS has_home_policy, next_renewal_product AS renewal_product, next_renewal_policy_id AS renewal_policy_id,
 next_renewal_date AS renewal_date, days_to_renewal AS days_until_renewal, last_intent AS last_call_intent FROM c360""")
def _(c):
    names = [n for n, d in semantic.DIMENSIONS.items() if d[0] == "c360"]
    return semantic.semantic_dimensions(c.book.logical_tables, names)


@query("semantic_dimensions_action", """SELECT risk_band AS churn_risk_band, action_category AS nba_category,
 action AS recommended_action, reason AS action_reason, replace(evidence, ',', ', ') AS evidence_transcripts,
 customer_message AS suggested_message, channel AS outreach_channel, generated_by AS action_source FROM nba""")
def _(c):
    names = [n for n, d in semantic.DIMENSIONS.items() if d[0] == "nba"]
    return semantic.semantic_dimensions(c.book.logical_tables, names)


@query("semantic_dimensions_call", """SELECT transcript_id AS call_transcript_id, CAST(call_ts AS DATE) AS call_date,
 policy_id AS call_policy_id, primary_intent AS call_intent, sentiment_label AS call_sentiment, summary AS call_summary
 FROM insights""")
def _(c):
    names = [n for n, d in semantic.DIMENSIONS.items() if d[0] == "ins"]
    return semantic.semantic_dimensions(c.book.logical_tables, names)


FACTS_SQL = {
    "c360": """SELECT customer_id, total_annual_premium AS annual_premium_inr, total_sum_insured AS sum_insured_inr,
 next_renewal_premium AS renewal_premium_inr, avg_days_to_settle AS settlement_days, n_claims AS claims_count,
 n_open_claims AS open_claims_count, n_late_12m AS late_payments_12m, n_missed_12m AS missed_payments_12m FROM c360""",
    "nba": """SELECT customer_id, risk_score AS risk_points, premium_at_risk AS premium_at_risk_inr,
 expected_premium_loss AS expected_loss_inr FROM nba""",
    "ins": "SELECT transcript_id, sentiment_score AS sentiment FROM insights",
}
for _table, _sql in FACTS_SQL.items():
    query(f"semantic_facts_{_table}", _sql)(lambda c, table=_table: semantic.semantic_facts(c.book.logical_tables, table))


@query("semantic_synonyms", """SELECT word, kind, logical_table, name, count(*) AS n_calls FROM insights
 JOIN (VALUES ('claim_issue', 'intent'), ('price_concern', 'premium'), ('cancellation_intent', 'cancel requests'),
 ('upsell_interest', 'recommendation'), ('service_praise', 'mood'), ('general_service', 'due date'))
 i(primary_intent, word) USING (primary_intent) JOIN (VALUES
 ('intent', 'dimension', 'ins', 'call_intent'), ('premium', 'fact', 'c360', 'annual_premium_inr'),
 ('cancel requests', 'metric', 'ins', 'cancellation_calls'), ('recommendation', 'dimension', 'nba', 'recommended_action'),
 ('mood', 'dimension', 'ins', 'call_sentiment'), ('due date', 'dimension', 'c360', 'renewal_date'))
 s(word, kind, logical_table, name) USING (word) GROUP BY ALL""")
def _(c):
    word = F.create_map(*[F.lit(v) for pair in (
        ("claim_issue", "intent"), ("price_concern", "premium"), ("cancellation_intent", "cancel requests"),
        ("upsell_interest", "recommendation"), ("service_praise", "mood"), ("general_service", "due date"))
        for v in pair])
    words = c.book.insights.select(F.try_element_at(word, F.col("primary_intent")).alias("word"))
    return semantic.semantic_synonyms(words).groupBy("word", "kind", "logical_table", "name").agg(
        F.count("*").alias("n_calls"))


# --- action log ----------------------------------------------------------------------------------
@query("action_status", "SELECT * FROM status")
def _(c):
    return c.book.status


@query("action_uptake", """SELECT count(*) AS reviewed, count(*) FILTER (status = 'Accepted') AS accepted,
 count(*) FILTER (status = 'Done') AS done, count(*) FILTER (status = 'Rejected') AS rejected,
 count(*) FILTER (status IN ('Accepted', 'Done')) / nullif(count(*), 0) AS uptake_rate FROM status""")
def _(c):
    return decisions.action_uptake(c.book.status)


@query("action_uptake_by_category", """SELECT action_category, count(*) AS reviewed,
 count(*) FILTER (status IN ('Accepted', 'Done')) / count(*) AS uptake_rate FROM status GROUP BY action_category""")
def _(c):
    return decisions.action_uptake_by_category(c.book.status)


# --- streams -------------------------------------------------------------------------------------
@query("stream_enrich", "SELECT * FROM insights")
def _(c):
    arriving, store, checkpoint = c.scratch("calls"), c.scratch("insights"), c.scratch("progress")
    c.book.call_transcripts.repartition(4).write.parquet(arriving)
    stream = c.spark.readStream.schema(schemas.CALL_TRANSCRIPTS).option("maxFilesPerTrigger", 2).parquet(arriving)
    jobs.stream_enrich(stream, store, checkpoint, WORDING, STAMP).awaitTermination()
    return c.spark.read.parquet(store).drop("month")


@query("stream_action_log", f"""SELECT {LOG_VALUES} FROM (
 SELECT * REPLACE (coalesce(agent, 'desk') AS agent, coalesce(ts, TIMESTAMP '2001-11-05 06:00:00') AS ts) FROM status) s""")
def _(c):
    arriving, path, checkpoint = c.scratch("decisions"), c.scratch("log"), c.scratch("progress")
    c.book.status.repartition(4).write.parquet(arriving)
    stream = c.spark.readStream.schema(c.book.status.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    jobs.stream_action_log(stream, path, checkpoint, "desk", STAMP).awaitTermination()
    return decisions.read_log(c.spark, path).select(*LOG_VALUES.split(", "))


@query("stream_action_status", "SELECT * FROM status")
def _(c):
    arriving, store, checkpoint = c.scratch("log"), c.scratch("status"), c.scratch("progress")
    c.book.action_log.repartition(4).write.parquet(arriving)
    stream = c.spark.readStream.schema(schemas.ACTION_LOG).option("maxFilesPerTrigger", 2).parquet(arriving)
    jobs.stream_action_status(stream, store, checkpoint).awaitTermination()
    return jobs.current_status(c.spark, store)


#: A query of the stored book or index is checked as the one that starts from the sources.
CHECKS |= {f"{name}_stored": CHECKS[name] for name in ("customer_card", "source_health", "semantic_by_segment", "semantic_by_call_intent")}
CHECKS |= {f"{name}_index": CHECKS[name] for name in ("customer_evidence_search", "cohort_with_evidence", "hybrid_search")}
