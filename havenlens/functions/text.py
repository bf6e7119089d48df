"""Column builders over a call transcript: who said what, how they felt, what they wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens.functions.numeric import clip, half_even
from havenlens.functions.rules import fill, first_match

WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def customer_text(text: Column, speaker: str = "Customer:") -> Column:
    """Everything the speaker said, one space between lines; empty when they said nothing."""
    lines = F.transform(F.split(text, "\n"), strip)
    spoken = F.filter(lines, lambda line: F.startswith(line, F.lit(speaker)))
    return F.concat_ws(" ", F.transform(spoken, lambda line: strip(F.substr(line, F.lit(len(speaker) + 1)))))


def term_hits(lowered: Column, terms: Sequence[str]) -> Column:
    """Summed non-overlapping occurrences of each term. Terms may overlap one another and each still counts.

    Most terms are absent from most texts, so a cheap `contains` pass keeps only the present ones for counting. Written
    over an array of literals: the unrolled sum of 42 columns scans no faster and takes seconds to compile.
    """
    present = F.filter(F.array(*[F.lit(term) for term in terms]), lambda term: F.contains(lowered, term))
    return F.aggregate(present, F.lit(0.0), lambda hits, term: hits + (
        F.length(lowered) - F.length(F.replace(lowered, term, F.lit("")))) / F.length(term))


def sentiment_from_hits(positive: Column, negative: Column) -> Column:
    raw = (positive - F.lit(1.3) * negative) / (positive + negative + F.lit(1.5))
    return half_even(clip(raw, -0.95, 0.95), 3)


def sentiment_score(lowered: Column, positive: Sequence[str] = K.POSITIVE_TERMS,
                    negative: Sequence[str] = K.NEGATIVE_TERMS) -> Column:
    """Lexicon score in [-0.95, 0.95] at three decimals. Pass lower-cased customer text from an earlier projection."""
    return sentiment_from_hits(term_hits(lowered, positive), term_hits(lowered, negative))


def sentiment_label(score: Column) -> Column:
    return (F.when(score <= -K.SENTIMENT_CUT, "negative").when(score >= K.SENTIMENT_CUT, "positive")
            .otherwise("neutral"))


def mentions(lowered: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs; plain substring search is far cheaper than a regular expression of alternatives."""
    return F.exists(F.array(*[F.lit(phrase) for phrase in phrases]), lambda phrase: F.contains(lowered, phrase))


def primary_intent(lowered: Column) -> Column:
    """First intent whose words occur in the lower-cased customer text."""
    leaving = ((mentions(lowered, ("cancel", "port")) & lowered.rlike(K.CANCELLATION_WHOLE_WORDS))
               | mentions(lowered, K.CANCELLATION_PHRASES))
    return first_match([
        (leaving, K.CANCELLATION),
        ((lowered.contains("claim") & mentions(lowered, K.CLAIM_TROUBLE_PHRASES)) | lowered.contains("garage"), K.CLAIM),
        (mentions(lowered, K.PRICE_PHRASES), K.PRICE),
        (mentions(lowered, K.UPSELL_PHRASES), K.UPSELL),
        (mentions(lowered, K.PRAISE_PHRASES), K.PRAISE),
    ], K.GENERAL)


def first_group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_entities(text: Column, said: Column, wording: K.Wording = K.DEFAULT_WORDING) -> dict[str, Column]:
    """Policy and claim ids from the whole text; first amount, day count and percentage from the customer's words."""
    return {
        "policy_ids": F.regexp_extract_all(text, F.lit(wording.policy_pattern), F.lit(0)),
        "claim_ids": F.regexp_extract_all(text, F.lit(wording.claim_pattern), F.lit(0)),
        "amount": first_group(said, r"₹([\d,]+)", 1),
        "days": first_group(said, r"(\d+) days", 1),
        "percent": first_group(said, r"(\d+) percent", 1),
    }


def call_summary(intent: Column, text: Column, said: Column, lowered: Column,
                 wording: K.Wording = K.DEFAULT_WORDING) -> Column:
    """One line per call, chosen by intent and keywords and filled with what the text names."""
    claim = first_group(text, wording.claim_pattern, 0)
    amount = first_group(said, r"₹([\d,]+)", 1)
    days = first_group(said, r"(\d+) days", 1)
    slots = {
        "policy": F.coalesce(first_group(text, wording.policy_pattern, 0), F.lit("their policy")),
        "brand": wording.brand,
        "home_plan": wording.home_plan,
    }

    def line(name: str, **extra: Column) -> Column:
        return fill(K.SUMMARY[name], {**slots, **extra})

    regulator = F.when(said.contains("IRDAI"), K.SUMMARY["claim_regulator"]).otherwise("")
    stuck = line("claim", claim=F.coalesce(claim, F.lit("")), days=F.coalesce(days, F.lit("many")), regulator=regulator)
    garage = line("claim_garage", days=F.coalesce(days, F.lit("several")), amount=F.coalesce(amount, F.lit("—")))
    return first_match([
        ((intent == K.CLAIM) & said.contains("garage"), garage),
        (intent == K.CLAIM, F.replace(stuck, F.lit("  "), F.lit(" "))),
        ((intent == K.CANCELLATION) & lowered.contains("port"), line("port")),
        (intent == K.CANCELLATION, line("cancel", amount=F.coalesce(amount, F.lit("lower")))),
        ((intent == K.PRICE) & said.contains("percent"),
         line("price_percent", percent=F.coalesce(first_group(said, r"(\d+) percent", 1), F.lit("")),
              amount=F.coalesce(amount, F.lit("")))),
        (intent == K.PRICE, line("price")),
        ((intent == K.UPSELL) & said.contains("baby"), line("upsell_baby")),
        (intent == K.UPSELL, line("upsell")),
        ((intent == K.PRAISE) & claim.isNotNull(), line("praise_claim", claim=claim)),
        (intent == K.PRAISE, line("praise")),
        (said.contains("address"), line("address")),
        (said.contains("certificate"), line("certificate")),
    ], line("general"))


def ordered_text(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, customer_text): what was said in a conversation whose turns are rows, in order, null turns left out."""
    said = F.sort_array(F.collect_list(F.struct(order, text)))
    return turns.where(F.col(text).isNotNull()).groupBy(key).agg(
        F.array_join(F.transform(said, lambda t: t.getField(text)), " ").alias("customer_text"))
