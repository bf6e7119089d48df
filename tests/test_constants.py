"""Fixed values by literal expectation, so that a slip in them cannot pass a check that is made from them too."""
from __future__ import annotations

from havenlens import constants as K
from havenlens.operators import semantic


def test_words_and_phrases():
    assert K.POSITIVE_TERMS == (
        "thank", "great", "wonderful", "smooth", "very easy", "convenient", "good", "perfect", "nice", "recommended", "keep it up",
        "congratulations", "happy", "all good", "sounds good")
    assert K.CANCELLATION_PHRASES == ("port my", "not renew", "stop the auto-debit") and K.CANCELLATION_WHOLE_WORDS == r"\bcancel|\bport\b"
    assert K.PRICE_PHRASES == ("premium has increased", "cheaper", "discount", "quotes", "price is higher", "budget", "aggregator")
    assert K.CLAIM_TROUBLE_PHRASES == ("still", "pending", "delay", "surveyor", "approved only", "verification", "nobody")
    assert K.UPSELL_PHRASES == ("add her", "top-up", "home insurance", "term plan", "sum insured enough", "quote.")
    assert K.PRAISE_PHRASES == ("say thanks", "very easy", "very smooth", "keep it up", "recommended you")
    assert {"frustrat", "disappoint", "nightmare", "cancel", "forever"} <= set(K.NEGATIVE_TERMS)


def test_numbers_and_domains():
    assert (K.HIGH_FROM, K.MEDIUM_FROM, K.SENTIMENT_CUT) == (55, 30, 0.25)
    assert K.DRIVER_MAXIMA == {"Negative sentiment": 25.0, "Cancellation / porting intent": 20.0, "Price sensitivity": 10.0,
                               "Payment stress": 15.0, "Claim friction": 15.0, "Renewal due soon": 15.0}
    assert K.INTENTS == ("cancellation_intent", "claim_issue", "price_concern", "upsell_interest", "service_praise", "general_service")
    assert K.OPEN_CLAIM_STATUSES == ("Pending", "Under Review") and K.PAYMENT_STATUSES == ("On-time", "Late", "Missed")
    assert K.ACTIVE_STATUSES == ("Active", "Grace Period", "Cancellation Requested") and K.LAPSED == "Lapsed"
    assert K.DECISION_STATUSES == ("Accepted", "Rejected", "Done") and K.PRODUCTS == ("Health", "Motor", "Life", "Home")
    assert K.EVIDENCE_INTENT == {"RETENTION_CALL": "cancellation_intent", "CLAIM_ESCALATION": "claim_issue", "PRICE_MATCH": "price_concern",
                                 "CROSS_SELL": "upsell_interest", "ADVOCACY": "service_praise"}


def test_names_of_the_semantic_layer():
    assert semantic.FACTS["annual_premium_inr"] == ("c360", "total_annual_premium", ("premium", "annual premium", "GWP"))
    assert {n: f[1] for n, f in semantic.FACTS.items() if f[0] == "nba"} == {
        "risk_points": "risk_score", "premium_at_risk_inr": "premium_at_risk", "expected_loss_inr": "expected_premium_loss"}
    assert semantic.DIMENSIONS["call_intent"] == ("ins", "primary_intent", ("intent", "reason for call", "call reason", "topic"))
