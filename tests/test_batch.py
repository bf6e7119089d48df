"""Many questions, lookups and searches at once against the single ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sample_days import AS_OF

from havenlens import constants as K
from havenlens.operators import ask, ask_batch, serving
from havenlens.operators.grams import containing, meeting

QUESTIONS = [
    "Which motor policyholders renewing in the next 60 days are at risk?", "How much premium is at risk in Pune?",
    "Top 3 customers threatening to cancel", "Customers with a price concern who want to cancel",
    "top 5", "What should I do?", "Health and life policies due next month", "car renewals this month, top 2",
    "policies due in the next 9000 days", "low risk mass customers", "Medium risk motor renewals with claim complaints", "",
    "high risk in Pune or Mumbai renewing"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def batch(spark, book):
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)) + [(99, None)], "question_id long, question string")
    specs = ask_batch.read_questions(questions, AS_OF)
    return specs, ask_batch.cohorts(specs, book.nba, book.policies, book.insights, AS_OF)


def by_question(df):
    out = {}
    for row in df.collect():
        row = row.asDict()
        out.setdefault(row.pop("question_id"), []).append(row)
    return out


def test_specs_are_the_single_ones(batch):
    rows = {r.question_id: r for r in batch[0].collect()}
    for i, question in enumerate(QUESTIONS):
        spec, row = ask.read_question(question, AS_OF), rows[i]
        assert (tuple(row.products), tuple(row.bands), tuple(row.cities), row.segment, tuple(row.intents), row.top) == (
            spec.products, spec.bands, spec.cities, spec.segment, spec.intents, spec.top)
        assert (row.first, row.last) == (spec.window or (None, None)) and row.by_policy == spec.by_policy


def test_answers_are_the_single_ones(batch, book):
    specs, cohort = batch
    cohort = cohort.cache()
    totals, tables = by_question(ask_batch.batch_totals(specs, cohort)), by_question(ask_batch.batch_table(cohort))
    drivers, plays = by_question(ask_batch.batch_drivers(cohort)), by_question(ask_batch.batch_plays(cohort))
    behind = by_question(ask_batch.batch_policies(specs, cohort, book.policies))
    filled = 0
    for i, question in enumerate(QUESTIONS):
        one = ask.ask(question, book.nba, book.policies, book.insights, AS_OF)
        assert totals[i] == [one.totals.first().asDict()], question
        table = [r.asDict() for r in one.table.collect()]
        mine = sorted(tables.get(i, []), key=lambda r: (-r["risk_score"], r["customer_id"]))
        assert [{k: r[k] for k in t} for r, t in zip(mine, table)] == table and len(mine) == len(table), question
        assert drivers.get(i, []) == [r.asDict() for r in one.drivers.collect()]
        assert plays.get(i, []) == [r.asDict() for r in one.plays.collect()]
        listed = [] if one.policies is None else [r.asDict() for r in one.policies.collect()]
        assert sorted(behind.get(i, []), key=lambda r: r["policy_id"]) == sorted(listed, key=lambda r: r["policy_id"]), question
        filled += bool(table)
    cohort.unpersist()
    assert filled >= 8 and totals[99] == totals[5]


def test_no_question_meets_all_customers_in_a_loop(batch, book):
    specs, cohort = batch
    for df in (cohort, ask_batch.batch_totals(specs, cohort), ask_batch.batch_table(cohort),
               ask_batch.batch_policies(specs, cohort, book.policies)):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan_of(cohort)


def test_containing_is_substring_search(spark):
    chance = random.Random(4)
    texts = [(i, "".join(chance.choices("abcé 😀", k=chance.randint(0, 14)))) for i in range(150)] + [(900, None), (901, "aaaaaa")]
    needles = sorted({"".join(chance.choices("abcé 😀", k=chance.randint(0, 5))) for _ in range(120)})
    rows = list(enumerate(needles)) + [(5000, None), (5001, "zzz"), (5002, "a"), (5003, "a" * 40)]
    hits = containing(spark.createDataFrame(texts, "text_id long, hay string"), spark.createDataFrame(rows, "needle_id long, needle string"))
    got = sorted((r.text_id, r.needle_id) for r in hits.collect())
    assert got == sorted((t, n) for t, hay in texts for n, needle in rows if hay is not None and needle is not None and needle in hay)
    assert "NestedLoop" not in plan_of(hits)


def test_names_that_differ_in_a_digit_hardly_meet(spark):
    """Needles of three-letter grams met every name with the same three digits, which grew with the square of the names."""
    names = [f"customer#{i:09d}" for i in range(1500)]
    texts = spark.createDataFrame([(i, f"what about {n}?") for i, n in enumerate(names)], "text_id int, hay string")
    needles = spark.createDataFrame([(n, n) for n in [*names, "customer#00000001", ""]], "needle_id string, needle string")
    assert meeting(texts, needles.where("length(needle) > 17")).count() <= 2 * len(names)
    found = {(r.text_id, r.needle) for r in containing(texts, needles).select("text_id", "needle").collect()}
    assert found == {(i, n) for i, name in enumerate(names) for n in (name, "customer#00000001", "") if n in name}


def test_lookups_with_names_inside_names(spark, book, tmp_path):
    columns = [c for c in book.nba.columns if c not in ("customer_id", "full_name")]
    base = book.nba.where("customer_id = 'claims'").select(*columns)
    names = [("c0001", "Ana Lee"), ("c0002", "Diana Leeds"), ("c0003", "Ana Lee"), ("c0004", "Bo"), ("c0005", "X"), ("c0006", None), ("c0007", "ANA LEEDS"), ("c0008", "Éva É")]
    spark.createDataFrame(names, "customer_id string, full_name string").join(base).select(*book.nba.columns).write.parquet(f"{tmp_path}/nba")
    nba = spark.read.parquet(f"{tmp_path}/nba")
    questions = ["Is ana lee leaving?", "and Diana Leeds?", "call c0004 or Ana Lee", "call c9999, Ana Lee", "nobody", "a Bo", "xylophone", "ÉVA É!", "", None]
    rows = list(enumerate(questions))
    told = {r.question_id: r for r in ask_batch.lookup_batch(spark.createDataFrame(rows, "question_id int, question string"), nba).collect()}
    for i, question in rows:
        one = ask.ask_lookup_customer(question or "", nba).first()
        assert (told[i].asDict() | {"question_id": None} if i in told else None) == (one.asDict() | {"question_id": None} if one else None), question
    assert told[1].customer_id == "c0001" and told[2].customer_id == "c0004" and 3 not in told
    assert "NestedLoop" not in plan_of(ask_batch.lookup_batch(spark.createDataFrame(rows, "question_id int, question string"), nba))


def test_searches(spark, book):
    texts = ["Ana", " pune ", "r", "re", "renew", "motor", "zzz", "", "  ", "LEE", "t m", "hot", "ho"]
    needles = spark.createDataFrame(list(enumerate(texts)), "needle_id long, text string")
    got = {}
    for r in ask_batch.customer_search_batch(book.nba, needles).orderBy("needle_id", F.desc("risk_score"), "customer_id").collect():
        got.setdefault(r.needle_id, []).append(r.customer_id)
    for i, text in enumerate(texts):
        assert got.get(i, []) == [r.customer_id for r in serving.customer_search(book.nba, text).collect()], text
