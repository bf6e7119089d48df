"""Many questions, name lookups and searches at once, each kind in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.functions.numeric import inr_label
from havenlens.operators import ask
from havenlens.operators.customer360 import since
from havenlens.operators.grams import containing

SPEC = ("question_id bigint, question string, products array<string>, first date, last date, bands array<string>, "
        "cities array<string>, segment string, intents array<string>, top int")
#: Days of a bucket of renewal dates, and the buckets of a window above which it is checked for every policy instead.
BUCKET_DAYS, MOST_BUCKETS = 32, 64
ANY = "*"


def read_questions(questions: DataFrame, as_of: dt.date, cities: Sequence[str] = K.CITIES,
                   segments: Mapping[str, str] = K.SEGMENT_WORDS) -> DataFrame:
    """One spec per (question_id, question): sets of values, empty where the question does not say; a null asks for all."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, question in zip(batch["question_id"], batch["question"]):
                spec = ask.read_question(question or "", as_of, cities, segments)
                first, last = spec.window or (None, None)
                rows.append((number, question, list(spec.products), first, last, list(spec.bands), list(spec.cities),
                             spec.segment, list(spec.intents), spec.top))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPEC.split(", ")])

    specs = questions.select(F.col("question_id").cast("bigint"), "question").mapInPandas(read, SPEC)
    return specs.withColumn("by_policy", (F.size("products") > 0) | F.col("first").isNotNull())


def _or_any(values: str) -> Column:
    return F.when(F.size(values) > 0, F.col(values)).otherwise(F.array(F.lit(ANY)))


def _bucket(day: str) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def _asked_policies(specs: DataFrame, policies: DataFrame) -> DataFrame:
    """(question_id, customer_id, policy_id, renews, annual_premium): the policies that questions about policies mean.

    An interval join: a window is cut into buckets of days and joined with the policies that renew in them by equality, as
    are products; the days at its ends are then checked. Windows of very many buckets meet every policy of their products.
    """
    buckets = F.sequence(_bucket("first"), _bucket("last"))
    whole = F.col("first").isNull() | (_bucket("last") - _bucket("first") >= MOST_BUCKETS)
    asked = specs.where("by_policy AND (first IS NULL OR first <= last)").select(
        "question_id", "first", "last", F.explode(_or_any("products")).alias("product_key"),
        F.when(whole, F.array(F.lit(-1))).otherwise(buckets).alias("buckets")).select("*", F.explode("buckets").alias("bucket")).drop("buckets")
    live = policies.where(F.col("status") != K.LAPSED).select(
        "customer_id", "policy_id", F.col("renewal_date").alias("renews"), "annual_premium", "product_line",
        F.explode(F.array("product_line", F.lit(ANY))).alias("product_key")).select(
        "*", F.explode(F.array(_bucket("renews"), F.lit(-1))).alias("bucket"))
    met = asked.join(live, ["product_key", "bucket"]).where("first IS NULL OR renews BETWEEN first AND last")
    return met.select("question_id", "customer_id", "policy_id", "renews", "annual_premium")


def policy_matches(specs: DataFrame, policies: DataFrame) -> DataFrame:
    """(question_id, customer_id, n_policies, renewal_date, policy_premium) for questions about policies."""
    return _asked_policies(specs, policies).groupBy("question_id", "customer_id").agg(
        F.count("*").alias("n_policies"), F.min("renews").alias("renewal_date"), F.sum("annual_premium").alias("policy_premium"))


def caller_matches(specs: DataFrame, insights: DataFrame, as_of: dt.date) -> DataFrame:
    """(question_id, customer_id) of customers with a recent call of every intent that a question names."""
    asked = specs.select("question_id", F.size("intents").alias("n_asked"), F.explode("intents").alias("primary_intent"))
    recent = since(insights, as_of, 180).select("customer_id", "primary_intent").distinct()
    return asked.join(recent, "primary_intent").groupBy("question_id", "customer_id", "n_asked").agg(
        F.count("*").alias("n")).where("n = n_asked").select("question_id", "customer_id")


def cohorts(specs: DataFrame, nba: DataFrame, policies: DataFrame, insights: DataFrame, as_of: dt.date) -> DataFrame:
    """(question_id, by_policy, policy columns, all columns of nba): the customers of every question.

    Questions about policies start from the policies they meet, others with intents from the callers, and what is left from
    the customers by band, city and segment, each of which may be open: a customer stands under all combinations of its own
    values and "any", so this is a join by equality too. No question is compared with a customer that none of its sets holds.
    """
    people = nba.select("customer_id", F.col("risk_band").alias("band"), F.col("city").alias("place"),
                        F.col("segment").alias("class"), F.col("risk_score").alias("score"))
    callers = caller_matches(specs, insights, as_of)
    no_policy = [F.lit(None).cast(kind).alias(name) for name, kind in (("n_policies", "bigint"), ("renewal_date", "date"), ("policy_premium", "bigint"))]
    held = policy_matches(specs, policies)
    calling = specs.where("NOT by_policy AND size(intents) > 0").select("question_id").join(callers, "question_id").select("question_id", "customer_id", *no_policy)
    named = (
        (F.size("bands") == 0) | F.array_contains("bands", F.col("band")),
        (F.size("cities") == 0) | F.array_contains("cities", F.col("place")),
        F.col("segment").isNull() | (F.col("segment") == F.col("class")))
    some = held.join(specs.where("size(intents) = 0").select("question_id"), "question_id").unionByName(
        held.join(specs.where("size(intents) > 0").select("question_id"), "question_id").join(callers, ["question_id", "customer_id"], "left_semi")
    ).unionByName(calling)
    some = some.join(people, "customer_id").join(specs.select("question_id", "bands", "cities", "segment"), "question_id").where(
        named[0] & named[1] & named[2]).select("question_id", "customer_id", "score", "n_policies", "renewal_date", "policy_premium")
    open_ = specs.where("NOT by_policy AND size(intents) = 0").select(
        "question_id", F.explode(_or_any("bands")).alias("band_key"), "cities", "segment").select(
        "question_id", "band_key", F.explode(_or_any("cities")).alias("place_key"), F.coalesce("segment", F.lit(ANY)).alias("class_key"))
    under = people.select("customer_id", "score", "place", "class", F.explode(F.array("band", F.lit(ANY))).alias("band_key")).select(
        "*", F.explode(F.array("place", F.lit(ANY))).alias("place_key")).select("*", F.explode(F.array("class", F.lit(ANY))).alias("class_key"))
    others = open_.join(under, ["band_key", "place_key", "class_key"]).select("question_id", "customer_id", "score", *no_policy)
    met = _first_of_each(some.unionByName(others), specs)
    return met.join(specs.select("question_id", "by_policy"), "question_id").join(nba, "customer_id")


def _first_of_each(met: DataFrame, specs: DataFrame) -> DataFrame:
    """The riskiest of each question that asks for so many, all of the others.

    The largest number asked for, one number that comes to the driver, lets Spark limit each question before the exchange.
    """
    most = specs.agg(F.max("top")).first()[0] or 0
    tops = specs.select("question_id", "top")
    told = met.join(tops, "question_id")
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "customer_id"))
    # a top of 0 asks for no limit, as in a single question
    limited = told.where("top > 0").withColumn("nth", nth).where(F.col("nth") <= most).where("nth <= top").drop("nth")
    return told.where("top IS NULL OR top <= 0").unionByName(limited).drop("top", "score")


def batch_totals(specs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Totals of every question, of those without a customer too."""
    sums = cohort.groupBy("question_id").agg(
        F.count("*").alias("n_customers"), F.sum("total_annual_premium").alias("premium"), F.sum("expected_premium_loss").alias("expected_loss"))
    told = specs.select("question_id").join(sums, "question_id", "left").fillna(0, ["n_customers", "premium"]).fillna(0.0, ["expected_loss"])
    return told.withColumns({"premium_label": inr_label(F.col("premium"), 1), "expected_loss_label": inr_label(F.col("expected_loss"), 1)})


def batch_table(cohort: DataFrame) -> DataFrame:
    """The rows of all answers' tables: policy columns are null where a question is not about policies, and the next renewal where it is."""
    plain = ~F.col("by_policy")
    return cohort.select(
        "question_id", "customer_id", "full_name", "city", "segment", "risk_score", "risk_band", "n_policies", "renewal_date",
        "policy_premium", F.when(plain, F.col("next_renewal_product")).alias("next_renewal_product"),
        F.when(plain, F.col("next_renewal_date")).alias("next_renewal_date"), "total_annual_premium",
        churn.top_drivers(F.col("risk_drivers"), 3).alias("top_drivers"), "action")


def batch_policies(specs: DataFrame, cohort: DataFrame, policies: DataFrame) -> DataFrame:
    """The policies behind the answers' tables, a row each; questions that are not about policies have none."""
    told = _asked_policies(specs, policies).join(cohort.select("question_id", "customer_id"), ["question_id", "customer_id"])
    return told.select("question_id", "customer_id", F.col("renews").alias("renewal_date"), "policy_id")


def _most_frequent(counts: DataFrame, name: str, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n_customers"), name))
    return counts.withColumn("nth", nth).where(F.col("nth") <= k).select("question_id", name, "n_customers")


def batch_drivers(cohort: DataFrame, k: int = 3) -> DataFrame:
    """The k drivers that add risk for the most customers of each question."""
    adding = cohort.select("question_id", F.explode(F.filter("risk_drivers", lambda d: d.getField("points") > 0)).alias("d"))
    return _most_frequent(adding.groupBy("question_id", F.col("d.factor").alias("factor")).agg(F.count("*").alias("n_customers")), "factor", k)


def batch_plays(cohort: DataFrame, k: int = 3) -> DataFrame:
    return _most_frequent(cohort.groupBy("question_id", "action_category").agg(F.count("*").alias("n_customers")), "action_category", k)


def lookup_batch(questions: DataFrame, nba: DataFrame, wording: K.Wording = K.DEFAULT_WORDING) -> DataFrame:
    """(question_id, columns of a lookup): the customer each question names, as ask_lookup_customer tells one.

    An id in the question decides. Else it is the first id among all customers whose full name stands in it, also within
    other words. Names are the needles of a gram join, each once, so a name that many share is no hot key.
    """
    asked = questions.select(F.col("question_id").cast("bigint").alias("question_id"), F.lower("question").alias("hay")).withColumn(
        "asked_id", F.regexp_extract("hay", wording.customer_pattern, 0))
    ids = nba.select("customer_id", F.lower("customer_id").alias("asked_id"))
    by_id = asked.where("asked_id <> ''").join(ids, "asked_id").select("question_id", "customer_id")
    names = nba.where("full_name IS NOT NULL").groupBy(F.lower("full_name").alias("needle")).agg(F.min("customer_id").alias("customer_id"))
    by_name = containing(asked.where("asked_id = ''").select("question_id", "hay"), names.withColumn("needle_id", F.col("needle")))
    first = by_id.unionByName(by_name.select("question_id", "customer_id")).groupBy("question_id").agg(F.min("customer_id").alias("customer_id"))
    return first.join(nba, "customer_id").select("question_id", *ask.lookup_columns())


def customer_search_batch(nba: DataFrame, needles: DataFrame, n: int = 8) -> DataFrame:
    """(needle_id, text, customer columns) of the n riskiest customers for each (needle_id, text), as customer_search finds them.

    Every length of needle is defined: blanks around it do not count, one or two code points are sought as they are, and an
    empty one is in all.
    """
    hay = F.lower(F.concat_ws(" ", "customer_id", "full_name", "city", "product_lines", "segment"))
    shown = ("customer_id", "full_name", "city", "product_lines", "segment", "risk_score", "risk_band")
    asked = needles.select("needle_id", "text", F.lower(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("needle"))
    hits = containing(nba.select(*shown, hay.alias("hay")), asked)
    nth = F.row_number().over(Window.partitionBy("needle_id").orderBy(F.desc("risk_score"), "customer_id"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= n).select("needle_id", "text", *shown)
