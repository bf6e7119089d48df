from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens import schemas
from havenlens.functions import text as tx
from havenlens.functions.numeric import fixed, half_even, inr_label
from havenlens.operators import insights


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.withColumn("x", build(F.col("v"))).orderBy("i").collect()]


def test_customer_text_keeps_only_the_customer(spark):
    texts = ["Agent: hi\nCustomer: I am: here \n  Customer:  twice\n", "Agent: alone", "", None,
             "\tCustomer: tab ", "Customer:\nCustomer: x"]
    assert column(spark, texts, tx.customer_text) == ["I am: here twice", "", "", "", "tab", " x"]


def brute_sentiment(text: str) -> float:
    n = sum(text.count(w) for w in K.NEGATIVE_TERMS)
    p = sum(text.count(w) for w in K.POSITIVE_TERMS)
    return round(max(-0.95, min(0.95, (p - 1.3 * n) / (p + n + 1.5))), 3)


def test_sentiment_counts_every_term_also_when_they_overlap(spark):
    rng = random.Random(3)
    words = [*K.NEGATIVE_TERMS, *K.POSITIVE_TERMS, "report", "all good good", "é", "", "claim"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)]
    assert column(spark, texts, tx.sentiment_score) == [brute_sentiment(t) for t in texts]


@pytest.mark.parametrize("said, intent", [
    ("please cancel it", K.CANCELLATION), ("i want to port", K.CANCELLATION), ("port my plan", K.CANCELLATION),
    ("send the report", K.GENERAL), ("uncancelled", K.GENERAL), ("i will not renew", K.CANCELLATION),
    ("my claim is still open", K.CLAIM), ("my claim was paid", K.GENERAL), ("at the garage", K.CLAIM),
    ("any discount?", K.PRICE), ("get me a quote.", K.UPSELL), ("get me a quote now", K.GENERAL),
    ("very easy app", K.PRAISE), ("claim pending, cheaper elsewhere", K.CLAIM), ("cancel, claim pending", K.CANCELLATION),
])
def test_first_matching_intent_wins(spark, said, intent):
    assert column(spark, [said], tx.primary_intent) == [intent]


def test_summaries_fall_back_when_nothing_is_named(spark, rows):
    calls = rows(schemas.CALL_TRANSCRIPTS, [
        dict(transcript_id="1", customer_id="c", transcript_text="Customer: stuck at the garage"),
        dict(transcript_id="2", customer_id="c", transcript_text="Customer: claim pending, I call IRDAI"),
        dict(transcript_id="3", customer_id="c", transcript_text="Customer: cancel ABC-HE-12 now, ₹2,500 less elsewhere"),
        dict(transcript_id="4", customer_id="c", transcript_text="Customer: 12 percent up, cheaper at ₹900"),
        dict(transcript_id="5", customer_id="c", transcript_text="Agent: CLM-9\nCustomer: it was very easy"),
    ])
    got = [r.summary for r in insights.interaction_insights(calls).orderBy("transcript_id").collect()]
    assert got[0].startswith("Angry that motor claim is stuck at garage several days and only ₹— approved")
    assert got[1].startswith("Frustrated that claim is unresolved after ~many days")
    assert "threatened an IRDAI complaint; priority" in got[1]
    assert got[2].startswith("Asked how to cancel ABC-HE-12") and "₹2,500 cheaper" in got[2]
    assert got[3] == ("Questioned ~12% renewal hike on their policy with no claims; found plan ₹900 cheaper online; "
                      "revised quote to be sent.")
    assert "claim CLM-9 settled" in got[4]


def test_enriching_twice_adds_nothing(spark, sample):
    calls = sample["call_transcripts"]
    once = insights.interaction_insights(calls)
    assert insights.enrich_incremental(calls, once).count() == 0


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(11.25, 0.125), (11.35, -0.125), (None, None)], "a double, b double")
    got = df.select(half_even(F.col("a"), 1).alias("a"), fixed(F.col("b"), 2).alias("b")).collect()
    assert [tuple(r) for r in got] == [(11.2, "0.12"), (11.4, "-0.12"), (None, None)]


def test_money_labels(spark):
    df = spark.createDataFrame([(12_345_678,), (123_456,), (99_999,), (999,), (None,), (-1_234,)], "v long")
    one = [r.x for r in df.select(inr_label(F.col("v"), 1).alias("x")).collect()]
    two = [r.x for r in df.select(inr_label(F.col("v"), 2, indian_groups=True).alias("x")).collect()]
    assert one == ["₹1.23 Cr", "₹1.2 L", "₹99,999", "₹999", "₹0", "₹-1,234"]
    assert two == ["₹1.23 Cr", "₹1.23 L", "₹99,999", "₹999", "₹0", "₹-1,234"]
