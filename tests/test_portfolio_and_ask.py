from __future__ import annotations

import datetime as dt

import pytest
from sample_days import AS_OF
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.operators import ask, portfolio, semantic, serving


def test_pivots_add_up(book):
    table = portfolio.premium_by_product_band(book.nba, book.policies)
    pivoted = table.agg(F.sum(F.expr("high + medium + low"))).first()[0]
    assert pivoted == book.policies.where("status <> 'Lapsed'").agg(F.sum("annual_premium")).first()[0]
    moods = portfolio.intent_by_sentiment(book.nba, book.insights, AS_OF)
    assert all(r.n_calls == r.negative + r.neutral + r.positive for r in moods.collect())


def test_a_score_of_one_hundred_is_in_no_bucket(spark):
    nba = spark.createDataFrame([(0.0,), (9.9,), (100.0,), (99.9,)], "risk_score double")
    got = {r.bucket: r.n_customers for r in portfolio.risk_histogram(nba).collect()}
    assert len(got) == 10 and got["0-9"] == 2 and got["90-99"] == 1 and sum(got.values()) == 3


def test_product_filter_includes_lapsed_holders(book):
    cohort = portfolio.portfolio_filter(book.nba, book.policies, products=["Motor"])
    assert "lapsed" in {r.customer_id for r in cohort.collect()}
    empty = portfolio.portfolio_filter(book.nba, book.policies, segments=["HNI"])
    assert portfolio.portfolio_kpis(empty).first().premium == 0


def test_search_is_case_insensitive_and_limited(book):
    assert serving.customer_search(book.nba, " PUNE ").count() == 8
    assert [r.customer_id for r in serving.customer_search(book.nba, "renew-10").collect()] == ["renew-10"]


def test_source_health_has_four_rows_per_customer(book):
    health = serving.source_health(book.c360, book.policies, book.claims, book.payments, book.insights)
    by = {(r.customer_id, r.source): r for r in health.collect()}
    assert len(by) == 4 * book.customers.count()
    assert by["none", "claims"].headline == "No claims filed" and by["none", "calls"].headline == "0 calls · sentiment —"
    assert by["lapsed", "policies"].health == "bad" and by["late3", "payments"].health == "bad"


@pytest.mark.parametrize("question, window", [
    ("renewing next month", (dt.date(2001, 12, 1), dt.date(2001, 12, 31))),
    ("renewing this month", (AS_OF, dt.date(2001, 11, 30))),
    ("due next week", (AS_OF, dt.date(2001, 11, 12))),
    ("in the next 3 days", (AS_OF, dt.date(2001, 11, 8))),
    ("renewals", (AS_OF, dt.date(2002, 1, 4))),
    ("anything", None),
])
def test_renewal_windows(question, window):
    assert ask.renewal_window(question, AS_OF) == window


@pytest.mark.parametrize("question, spec", [
    ("Which health policyholders renewing next month are at high churn risk and why?", ask.CohortSpec(
        products=("Health",), window=(dt.date(2001, 12, 1), dt.date(2001, 12, 31)), bands=("High",))),
    ("How much premium is at risk in Bangalore?", ask.CohortSpec(bands=("High", "Medium"), cities=("Bengaluru",))),
    ("Top 10 customers threatening to cancel", ask.CohortSpec(intents=(K.CANCELLATION,), top=10)),
    ("Which HNI customers are interested in upsell?", ask.CohortSpec(segment="HNI", intents=(K.UPSELL,))),
    ("Customers with claim complaints renewing in the next 30 days", ask.CohortSpec(
        window=(AS_OF, dt.date(2001, 12, 5)), intents=(K.CLAIM,))),
    ("Premium of those who complain", ask.CohortSpec()),
    ("Loyal customers who care about the report", ask.CohortSpec(
        products=("Motor",), bands=("Low",), intents=(K.CANCELLATION,))),
    ("Who may leave?", ask.CohortSpec(bands=("High", "Medium"), intents=(K.CANCELLATION,))),
])
def test_questions(question, spec):
    assert ask.read_question(question, AS_OF) == spec


def test_policies_are_listed_in_one_shape_however_many_there_are(book, sample):
    lines = ask.ask_policy_list(sample["policies"])
    ids = [r.policy_id for r in lines.where("customer_id = 'hot'").collect()]
    assert sorted(ids) == [f"H{i:04d}" for i in range(2500)]
    assert lines.where("customer_id = 'tie'").columns == ["customer_id", "renewal_date", "policy_id"]
    spec = ask.CohortSpec(window=(AS_OF, AS_OF + dt.timedelta(days=400)))
    cohort = ask.ask_cohort(spec, book.nba, book.policies, book.insights, AS_OF)
    table = ask.ask_table(spec, cohort).collect()
    assert len({r.customer_id for r in table}) == len(table)
    assert {r.customer_id: r.n_policies for r in table}["hot"] == 2500
    behind = ask.ask_policies(spec, cohort, book.policies).collect()
    assert [r.policy_id for r in behind if r.customer_id == "hot"][:3] == ["H0000", "H0080", "H0160"]
    assert list(dict.fromkeys(r.customer_id for r in behind)) == [r.customer_id for r in table]


def test_filters_in_words():
    spec = ask.read_question("Top 5 HNI customers at high risk with health policies renewing next month", AS_OF)
    assert spec.filters == ("renewing 2001-12-01 to 2001-12-31", "product: Health", "risk: High", "segment: HNI", "first: 5")
    assert ask.CohortSpec().filters == ()


def test_lookup_by_name_takes_the_first_id(book):
    got = ask.ask_lookup_customer("What should I do for ana lee?", book.nba).collect()
    assert [r.customer_id for r in got] == [min(r.customer_id for r in book.customers.collect())]
    assert ask.ask_lookup_customer("What about C9999?", book.nba).count() == 0


def test_callers_are_found_by_one_pass_that_works_an_intent_out_once(plain_book, book):
    asked = (K.CANCELLATION, K.PRICE)
    found = ask.ask_intent_filter(plain_book.customers, plain_book.insights, asked, AS_OF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the words of a call stand once in the plan: in the projection, in no filter below it
    assert plan.count("split(transcript_text") == 1
    recent = [r for r in book.insights.collect() if (AS_OF - r.call_ts.date()).days <= 180]
    callers = [{r.customer_id for r in recent if r.primary_intent == intent} for intent in asked]
    assert {r.customer_id for r in found.collect()} == callers[0] & callers[1] == {"hot"}
    assert ask.ask_intent_filter(plain_book.customers, plain_book.insights, (), AS_OF) is plain_book.customers


def test_calls_without_an_intent_or_a_customer_are_no_callers(spark):
    calls = spark.createDataFrame(
        [("a", K.PRICE), ("a", None), ("b", None), (None, K.PRICE), ("c", K.CLAIM)], "customer_id string, primary_intent string").withColumn(
        "call_ts", F.lit(dt.datetime.combine(AS_OF, dt.time()).isoformat()).cast("timestamp_ntz"))
    people = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "customer_id string")
    assert [r.customer_id for r in ask.ask_intent_filter(people, calls, [K.PRICE], AS_OF).collect()] == ["a", "a"]


def test_governed_select(spark, book):
    def build(session):
        return {"policies": session.createDataFrame([("p1", 5), ("p2", 7)], "policy_id string, premium int"),
                "claims": session.createDataFrame([(1,)], "x int")}

    spark.sql("CREATE TABLE hidden_stock USING parquet AS SELECT 1 AS x")
    spark.range(3).selectExpr("id AS x").createOrReplaceGlobalTempView("secret")
    try:
        for allowed, rows in (("SELECT 'please call; update' AS x", 1), ("SELECT policy_id FROM app.policies", 2),
                              ("```sql\nSELECT 'app.policies' AS x FROM CURATED.policies\n```", 2),
                              ("SELECT * FROM (VALUES (1), (2), (3)) v(x)", 3), ("SELECT id FROM range(4)", 4)):
            assert ask.governed_select(spark, allowed, build).count() == rows
        assert ask.governed_select(spark, "SELECT 'app.policies' AS x", build).first().x == "app.policies"
        got = ask.governed_select(spark, "WITH t AS (SELECT premium FROM policies) SELECT sum(premium) AS s FROM t;", build)
        assert got.first().s == 12
        for refused in ("DELETE FROM policies", "SELECT 1; SELECT 2", "SELECT * FROM claims", "DROP TABLE policies",
                        "SELECT * FROM hidden_stock", "SELECT * FROM default.hidden_stock",
                        "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'exit', 1)",
                        "SELECT * FROM policies) --", "SELECT * FROM global_temp.secret", "TABLE global_temp.secret",
                        "SELECT (SELECT max(x) FROM global_temp.secret) AS x FROM policies",
                        "SELECT * FROM policies WHERE premium IN (SELECT x FROM hidden_stock)",
                        "WITH policies AS (SELECT * FROM hidden_stock) SELECT * FROM policies",
                        "SELECT * FROM session.policies", "SELECT * FROM other.app.policies", "SHOW TABLES",
                        "SELECT reflect/**/('java.lang.System', 'exit', 1)", "SELECT 1; DROP TABLE policies",
                        "SELECT try_reflect('java.lang.System', 'exit', 1) FROM policies", "SELECT * FROM (SELECT x FROM spark_catalog.default.hidden_stock) h"):
            with pytest.raises(ask.QueryRefused):
                ask.governed_select(spark, refused, build)
        many = "SELECT explode(sequence(1, 40)) AS n, policy_id FROM policies"
        assert ask.governed_select(spark, many, build).count() == 50
    finally:
        spark.sql("DROP TABLE hidden_stock")
        spark.catalog.dropGlobalTempView("secret")


def test_metrics_do_not_change_when_another_table_joins_the_question(book):
    tables = book.logical_tables
    alone = {r.churn_risk_band: r for r in semantic.semantic_query(
        tables, ["churn_risk_band"], ["customer_count", "book_premium"]).collect()}
    together = {r.churn_risk_band: r for r in semantic.semantic_query(
        tables, ["churn_risk_band"], ["customer_count", "book_premium", "call_count", "at_risk_premium"]).collect()}
    for band, r in alone.items():
        assert (together[band].customer_count, together[band].book_premium) == (r.customer_count, r.book_premium)
    assert sum(r.call_count for r in together.values()) == book.insights.count()


def test_call_dimensions_count_a_customer_once_per_value(book):
    got = {r.call_intent: r for r in semantic.semantic_query(
        book.logical_tables, ["call_intent"], ["customer_count", "call_count"]).collect()}
    assert got[K.CANCELLATION].customer_count == 2 and got[K.CANCELLATION].call_count > 1000


def test_calls_are_summed_before_they_meet_customers(book):
    asked = semantic.semantic_query(book.logical_tables, ["churn_risk_band", "call_intent"], [
        "call_count", "avg_sentiment", "negative_call_share", "cancellation_calls"])
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join ")
    assert "Aggregate [customer_id" in plan[join:] and "n_calls" in plan[join:]
    calls = book.insights.join(book.nba.select("customer_id", "risk_band"), "customer_id").groupBy("risk_band", "primary_intent").agg(
        F.count("*").alias("n"), F.avg("sentiment_score").alias("mood"), F.avg((F.col("sentiment_label") == "negative").cast("int")).alias("bad"))
    want = {(r.risk_band, r.primary_intent): r for r in calls.collect()}
    got = {(r.churn_risk_band, r.call_intent): r for r in asked.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert r.call_count == want[key].n and abs(r.avg_sentiment - want[key].mood) < 1e-9 and abs(r.negative_call_share - want[key].bad) < 1e-9
        assert r.cancellation_calls == (r.call_count if key[1] == K.CANCELLATION else 0)


def test_null_dimension_values_meet(book):
    got = semantic.semantic_query(book.logical_tables, ["renewal_product"], ["customer_count", "high_risk_customers"])
    assert got.where("renewal_product IS NULL").count() == 1


def test_inventory_of_names(spark):
    assert (len(semantic.DIMENSIONS), len(semantic.FACTS), len(semantic.METRICS)) == (35, 12, 15)
    words = spark.createDataFrame([("GWP",), (" Mood",), ("nothing",)], "word string")
    got = {(r.word, r.kind, r.name) for r in semantic.semantic_synonyms(words).collect()}
    assert got == {("GWP", "fact", "annual_premium_inr"), ("GWP", "metric", "book_premium"),
                   (" Mood", "dimension", "call_sentiment")}
