"""Points, score and band as column builders over a 360 row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions.numeric import clip, fixed, half_even


@dataclass(frozen=True)
class Weights:
    """Most points per driver."""

    sentiment: float = 25.0
    cancel_recent: float = 20.0
    cancel_older: float = 8.0
    price: float = 10.0
    payment: float = 15.0
    claims: float = 15.0
    renewal: tuple = ((30, 15.0), (60, 10.0), (90, 5.0))
    loyalty: float = -5.0
    advocacy: float = -5.0


DEFAULT_WEIGHTS = Weights()


def known_sentiment() -> Column:
    return F.coalesce("avg_sentiment_90d", "avg_sentiment_180d")


def p_sentiment(w: Weights = DEFAULT_WEIGHTS) -> Column:
    gap = F.lit(0.25) - F.coalesce(known_sentiment(), F.lit(0.25))
    return half_even(F.lit(w.sentiment) * clip(gap, 0.0, 1.0), 1)


def p_cancel(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return (F.when(F.col("n_cancel_intent_90d") > 0, w.cancel_recent)
            .when(F.col("n_cancel_intent_180d") > 0, w.cancel_older).otherwise(0.0))


def p_price(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return F.when(F.col("n_price_concern_90d") > 0, w.price).otherwise(0.0)


def p_payment(w: Weights = DEFAULT_WEIGHTS) -> Column:
    stress = (F.col("n_late_12m") + 2 * F.col("n_missed_12m")) / 4
    return half_even(F.lit(w.payment) * F.least(stress, F.lit(1.0)), 1)


def p_claims(w: Weights = DEFAULT_WEIGHTS) -> Column:
    friction = (F.col("n_slow_claims") + F.col("n_rejected_claims")) / 2
    return half_even(F.lit(w.claims) * F.least(friction, F.lit(1.0)), 1)


def p_renewal(w: Weights = DEFAULT_WEIGHTS) -> Column:
    """Days may be negative; no renewal scores nothing."""
    days, ((near, near_points), *rest) = F.col("days_to_renewal"), w.renewal
    points = F.when(days <= near, near_points)
    for limit, value in rest:
        points = points.when(days <= limit, value)
    return points.otherwise(0.0)


def p_loyalty(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return F.when(F.col("tenure_years") >= 8, w.loyalty).otherwise(0.0)


def p_advocacy(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return F.when(F.col("n_service_praise_180d") > 0, w.advocacy).otherwise(0.0)


def points(w: Weights = DEFAULT_WEIGHTS) -> dict[str, Column]:
    builders = (p_sentiment, p_cancel, p_price, p_payment, p_claims, p_renewal, p_loyalty, p_advocacy)
    return dict(zip(K.POINT_COLUMNS, [build(w) for build in builders]))


def risk_score() -> Column:
    total = F.col(K.POINT_COLUMNS[0])
    for name in K.POINT_COLUMNS[1:]:
        total = total + F.col(name)
    return half_even(clip(total, 0.0, 100.0), 1)


def risk_band() -> Column:
    score = F.col("risk_score")
    return F.when(score >= K.HIGH_FROM, "High").when(score >= K.MEDIUM_FROM, "Medium").otherwise("Low")


def expected_premium_loss() -> Column:
    return half_even(F.col("total_annual_premium") * F.col("risk_score") / 100)


def premium_at_risk() -> Column:
    return F.when(F.col("risk_band") == "High", F.col("total_annual_premium")).otherwise(F.lit(0).cast("long"))


def risk_drivers(wording: K.Wording = K.DEFAULT_WORDING) -> Column:
    """Non-zero drivers in their fixed order, each with its points and the numbers behind it."""
    def driver(factor: str, points_column: str, detail: Column) -> Column:
        return F.struct(F.lit(factor).alias("factor"), F.col(points_column).alias("points"),
                        F.coalesce(detail, F.lit("")).alias("detail"))

    drivers = F.array(
        driver("Negative sentiment", "p_sentiment",
               F.concat(F.lit("Avg customer sentiment "), fixed(known_sentiment(), 2), F.lit(" (90d)"))),
        driver("Cancellation / porting intent", "p_cancel",
               F.concat(F.col("n_cancel_intent_180d").cast("string"), F.lit(" call(s) mentioning cancel/port"))),
        driver("Price sensitivity", "p_price",
               F.concat(F.col("n_price_concern_90d").cast("string"), F.lit(" price-concern call(s) in 90d"))),
        driver("Payment stress", "p_payment",
               F.concat(F.col("n_late_12m").cast("string"), F.lit(" late, "), F.col("n_missed_12m").cast("string"),
                        F.lit(" missed payments (12m)"))),
        driver("Claim friction", "p_claims",
               F.concat(F.col("n_slow_claims").cast("string"), F.lit(" slow/open >30d, "),
                        F.col("n_rejected_claims").cast("string"), F.lit(" rejected"))),
        driver("Renewal due soon", "p_renewal",
               F.concat(F.col("next_renewal_product"), F.lit(" renewal in "), F.col("days_to_renewal").cast("string"),
                        F.lit(" days"))),
        driver("Long tenure (protective)", "p_loyalty",
               F.concat(F.col("tenure_years").cast("string"), F.lit(f" years with {wording.brand}"))),
        driver("Recent praise (protective)", "p_advocacy", F.lit("Service-praise call in last 180d")),
    )
    return F.filter(drivers, lambda d: d.getField("points") != 0)


def drivers_ranked(drivers: Column) -> Column:
    """Drivers by points, largest first; equal points keep their order."""
    keyed = F.transform(drivers, lambda d, i: F.struct(
        (-d.getField("points")).alias("key"), i.alias("position"), d.alias("driver")))
    return F.transform(F.sort_array(keyed), lambda k: k.getField("driver"))


def top_drivers(drivers: Column, k: int, separator: str = "; ", with_points: bool = False) -> Column:
    """Names of the k strongest drivers that add risk, as one text."""
    adding = F.slice(F.filter(drivers_ranked(drivers), lambda d: d.getField("points") > 0), 1, k)

    def name(d: Column) -> Column:
        factor = d.getField("factor")
        return F.concat(factor, F.lit(" +"), fixed(d.getField("points"), 0)) if with_points else factor

    return F.array_join(F.transform(adding, name), separator)
