"""Churn score per customer and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions import churn
from havenlens.functions.numeric import half_even, ratio


def churn_risk(c360: DataFrame, weights: churn.Weights = churn.DEFAULT_WEIGHTS,
               wording: K.Wording = K.DEFAULT_WORDING) -> DataFrame:
    """360 columns plus points, score, band, expected loss and drivers. Projections only."""
    return (c360.withColumns(churn.points(weights))
            .withColumn("risk_score", churn.risk_score())
            .withColumn("risk_band", churn.risk_band())
            .withColumn("expected_premium_loss", churn.expected_premium_loss())
            .withColumn("risk_drivers", churn.risk_drivers(wording)))


def driver_rows(risk: DataFrame) -> DataFrame:
    """One row per customer and non-zero driver, in the fixed driver order."""
    return risk.select("customer_id", F.posexplode("risk_drivers").alias("position", "d")).select(
        "customer_id", "position", F.col("d.factor").alias("factor"), F.col("d.points").alias("points"),
        F.col("d.detail").alias("detail"))


def drivers_ranked(risk: DataFrame) -> DataFrame:
    """Strongest drivers as the three texts the screens use."""
    drivers = F.col("risk_drivers")
    return risk.select(
        "customer_id", churn.top_drivers(drivers, 2).alias("top_two"), churn.top_drivers(drivers, 3).alias("top_three"),
        churn.top_drivers(drivers, 3, " · ", with_points=True).alias("top_three_points"))


def driver_share(risk: DataFrame) -> DataFrame:
    """Points as a percentage of the most that driver can add. The maxima are a fixed six-row lookup."""
    maxima = F.create_map(*[F.lit(v) for pair in K.DRIVER_MAXIMA.items() for v in pair])
    rows = driver_rows(risk).withColumn("max_points", F.try_element_at(maxima, F.col("factor")))
    return rows.where(F.col("max_points").isNotNull()).select(
        "customer_id", "factor", "points", "max_points",
        half_even(F.col("points") * 100 / F.col("max_points"), 1).alias("share_pct"))


def risk_by_archetype(risk: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Archetype × band counts."""
    return (risk.select("customer_id", "risk_band").join(archetypes, "customer_id")
            .groupBy("archetype").agg(*[F.count_if(F.col("risk_band") == band).alias(band.lower()) for band in K.BANDS]))


def archetype_quality(risk: DataFrame, archetypes: DataFrame, target: str = "at_risk") -> DataFrame:
    """Recall and precision (per cent) of the High band for one archetype."""
    labelled = risk.select("customer_id", "risk_band").join(archetypes, "customer_id")
    high, wanted = F.col("risk_band") == "High", F.col("archetype") == target
    hit = F.count_if(high & wanted)
    return labelled.agg(
        hit.alias("hits"), F.count_if(wanted).alias("n_target"), F.count_if(high).alias("n_high"),
        half_even(ratio(hit, F.count_if(wanted)) * 100, 1).alias("recall_pct"),
        half_even(ratio(hit, F.count_if(high)) * 100, 1).alias("precision_pct"))
