"""Call transcripts to one enriched row per call."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import text as tx
from havenlens.functions.numeric import exact_mean, half_even
from havenlens.functions.times import moment

ENRICHED_BY = "rules (lexicon sentiment + keyword intent + template summary)"


def dialogue_turns(transcripts: DataFrame) -> DataFrame:
    """One row per transcript line with its position and speaker."""
    lines = transcripts.select("transcript_id", F.posexplode(F.split("transcript_text", "\n")).alias("line_no", "line"))
    spoken = F.instr("line", F.lit(":"))
    return lines.select(
        "transcript_id", "line_no",
        F.when(F.startswith(tx.strip(F.col("line")), F.lit("Customer:")), "customer").otherwise("agent")
        .alias("speaker"),
        F.when(spoken > 0, tx.strip(F.substr(F.col("line"), spoken + 1))).otherwise(tx.strip(F.col("line")))
        .alias("words"))


def with_customer_text(transcripts: DataFrame) -> DataFrame:
    """Adds the customer's words and their lower-cased form, each computed once in its own projection."""
    return (transcripts
            .withColumn("customer_text", tx.customer_text(F.col("transcript_text")))
            .withColumn("lowered", F.lower("customer_text")))


def entities(transcripts: DataFrame, wording: K.Wording = K.DEFAULT_WORDING) -> DataFrame:
    said = with_customer_text(transcripts)
    found = tx.extract_entities(F.col("transcript_text"), F.col("customer_text"), wording)
    return said.select("transcript_id", *[column.alias(name) for name, column in found.items()])


def interaction_insights(transcripts: DataFrame, wording: K.Wording = K.DEFAULT_WORDING,
                         enriched_at: dt.datetime | None = None) -> DataFrame:
    """Thirteen columns per call in one pass without a shuffle."""
    lowered = F.col("lowered")
    return (
        with_customer_text(transcripts)
        .withColumns({"sentiment_score": tx.sentiment_score(lowered), "primary_intent": tx.primary_intent(lowered)})
        .select(
            "transcript_id", "customer_id", "policy_id", "call_ts", "agent_id", "customer_text", "sentiment_score",
            tx.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"), "primary_intent",
            tx.call_summary(F.col("primary_intent"), F.col("transcript_text"), F.col("customer_text"), lowered, wording)
            .alias("summary"),
            "transcript_text", F.lit(ENRICHED_BY).alias("enriched_by"), moment(enriched_at).alias("enriched_at")))


def not_yet_stored(transcripts: DataFrame, stored: DataFrame) -> DataFrame:
    """Calls whose id is not in the stored table; only the id column of the stored side is read."""
    return transcripts.join(stored.select("transcript_id"), "transcript_id", "left_anti")


def enrich_incremental(transcripts: DataFrame, stored: DataFrame, wording: K.Wording = K.DEFAULT_WORDING,
                       enriched_at: dt.datetime | None = None) -> DataFrame:
    """Enriched rows for the calls not stored yet, to be appended."""
    return interaction_insights(not_yet_stored(transcripts, stored), wording, enriched_at)


def intent_accuracy(insights: DataFrame, labels: DataFrame) -> DataFrame:
    """Percentage of labelled calls whose intent equals the label."""
    scored = insights.select("transcript_id", "primary_intent").join(labels, "transcript_id")
    right = F.count_if(F.col("primary_intent") == F.col("true_intent"))
    return scored.agg(
        F.count("*").alias("n_labelled"), right.alias("n_right"),
        half_even(right.cast("double") * 100 / F.nullif(F.count("*"), F.lit(0)), 1).alias("intent_accuracy_pct"))


def intent_distribution(insights: DataFrame) -> DataFrame:
    return insights.groupBy("primary_intent").agg(
        F.count("*").alias("n_calls"), exact_mean(F.col("sentiment_score"), 3).alias("avg_sentiment"))


def intent_confusion(insights: DataFrame, labels: DataFrame) -> DataFrame:
    return (insights.select("transcript_id", "primary_intent").join(labels, "transcript_id")
            .groupBy("true_intent", "primary_intent").agg(F.count("*").alias("n_calls")))
