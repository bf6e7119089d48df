"""Word lists, patterns, templates and weights that define the results."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: sentiment lexicon, matched as lower-case substrings ------------------------
NEGATIVE_TERMS = (
    "frustrat", "disappoint", "nightmare", "poor", "nobody", "complain", "not hopeful", "forever",
    "promised last time", "failing", "doesn't even", "not what i was promised", "can't justify",
    "stop the auto-debit", "cancel", "port", "still showing", "only ₹", "increased", "big jump",
    "higher than others", "tight budget", "not renew", "made up my mind", "nothing", "own pocket",
    "this is how claims are handled",
)
POSITIVE_TERMS = (
    "thank", "great", "wonderful", "smooth", "very easy", "convenient", "good", "perfect", "nice",
    "recommended", "keep it up", "congratulations", "happy", "all good", "sounds good",
)

# --- fixed values: intents and the patterns that reveal them ----------------------------------
CANCELLATION = "cancellation_intent"
CLAIM = "claim_issue"
PRICE = "price_concern"
UPSELL = "upsell_interest"
PRAISE = "service_praise"
GENERAL = "general_service"
INTENTS = (CANCELLATION, CLAIM, PRICE, UPSELL, PRAISE, GENERAL)

CANCELLATION_WHOLE_WORDS = r"\bcancel|\bport\b"
CANCELLATION_PHRASES = ("port my", "not renew", "stop the auto-debit")
CLAIM_TROUBLE_PHRASES = ("still", "pending", "delay", "surveyor", "approved only", "verification", "nobody")
PRICE_PHRASES = ("premium has increased", "cheaper", "discount", "quotes", "price is higher", "budget", "aggregator")
UPSELL_PHRASES = ("add her", "top-up", "home insurance", "term plan", "sum insured enough", "quote.")
PRAISE_PHRASES = ("say thanks", "very easy", "very smooth", "keep it up", "recommended you")

SENTIMENT_LABELS = ("negative", "neutral", "positive")
SENTIMENT_CUT = 0.25

# --- fixed values: status domains ---------------------------------------------------------------
ACTIVE_STATUSES = ("Active", "Grace Period", "Cancellation Requested")
LAPSED = "Lapsed"
OPEN_CLAIM_STATUSES = ("Pending", "Under Review")
PAYMENT_STATUSES = ("On-time", "Late", "Missed")
PRODUCTS = ("Health", "Motor", "Life", "Home")
BANDS = ("High", "Medium", "Low")
HIGH_FROM, MEDIUM_FROM = 55, 30
DECISION_STATUSES = ("Accepted", "Rejected", "Done")

# --- fixed values: 360 columns that read 0 when a customer has no such rows --------------------
ZERO_FILLED = (
    "n_active_policies", "total_annual_premium", "n_claims", "n_open_claims", "n_rejected_claims",
    "n_slow_claims", "total_claimed", "total_approved", "n_payments_due_12m", "n_late_12m",
    "n_missed_12m", "n_calls_180d", "n_cancel_intent_90d", "n_cancel_intent_180d",
    "n_price_concern_90d", "n_claim_issue_90d", "n_upsell_interest_180d", "n_service_praise_180d",
)

# --- fixed values: driver labels with the most points each can add ------------------------------
DRIVER_MAXIMA = {
    "Negative sentiment": 25.0,
    "Cancellation / porting intent": 20.0,
    "Price sensitivity": 10.0,
    "Payment stress": 15.0,
    "Claim friction": 15.0,
    "Renewal due soon": 15.0,
}
POINT_COLUMNS = (
    "p_sentiment", "p_cancel", "p_price", "p_payment", "p_claims", "p_renewal", "p_loyalty", "p_advocacy",
)

# --- fixed values: action categories, their texts and the intent that evidences them -----------
ACTION_TEXT = {
    "RETENTION_CALL": "Senior retention call within 24h with a personalised renewal offer",
    "CLAIM_ESCALATION": "Escalate open claim to claims manager and give a proactive status callback",
    "PRICE_MATCH": "Send personalised renewal quote: loyalty discount or higher-deductible option",
    "PAYMENT_FLEX": "Offer instalment switch to monthly e-NACH and a grace-period reminder",
    "RENEWAL_NUDGE": "Early-bird renewal reminder with one-click payment link",
    "CROSS_SELL": "Cross-sell {offer} with multi-policy discount",
    "ADVOCACY": "Invite to refer-a-friend programme and request a review",
    "NURTURE": "No outreach needed — keep in nurture journey",
}
CUSTOMER_MESSAGE = {
    "RETENTION_CALL": "Hi {first}, we are sorry your recent experience with {brand} fell short. A senior advisor will "
    "call you within 24 hours with a personalised offer on policy {policy} before it renews. Reply CALL to pick a time.",
    "CLAIM_ESCALATION": "Hi {first}, your claim has been escalated to our claims manager today. You will get a status "
    "update within 48 hours and a direct contact for any documents needed. We apologise for the delay.",
    "PRICE_MATCH": "Hi {first}, thank you for being with {brand}. We have prepared a personalised renewal quote for "
    "{policy} with a loyalty discount and a lower-premium deductible option. Tap here to compare before {renews}.",
    "PAYMENT_FLEX": "Hi {first}, to make premiums easier we can split your payment into monthly e-NACH instalments at no "
    "extra cost. Reply YES and we will set it up so your cover stays uninterrupted.",
    "RENEWAL_NUDGE": "Hi {first}, your {product} policy {policy} renews on {renews}. Renew in one click and keep your "
    "benefits: [link]",
    "CROSS_SELL": "Hi {first}, as a valued {brand} customer you are eligible for up to 10% multi-policy discount on "
    "{offer}. Shall our advisor share a quick quote?",
    "ADVOCACY": "Hi {first}, thank you for your kind words about {brand}! Refer a friend and you both get a ₹500 voucher "
    "on renewal.",
}
EVIDENCE_INTENT = {
    "RETENTION_CALL": CANCELLATION,
    "CLAIM_ESCALATION": CLAIM,
    "PRICE_MATCH": PRICE,
    "CROSS_SELL": UPSELL,
    "ADVOCACY": PRAISE,
}

# --- fixed values: one-line call summaries; {…} are filled from the text ------------------------
SUMMARY = {
    "claim_garage": "Angry that motor claim is stuck at garage {days} days and only ₹{amount} approved; senior claims "
    "callback promised.",
    "claim": "Frustrated that claim {claim} is unresolved after ~{days} days despite resubmitting documents{regulator}; "
    "priority escalation promised.",
    "claim_regulator": " and threatened an IRDAI complaint",
    "port": "Wants to port {policy} to another insurer citing poor claims and app issues; asked to stop auto-debit.",
    "cancel": "Asked how to cancel {policy}: unhappy with claim service and premium hike, holds a quote ₹{amount} "
    "cheaper; senior advisor callback in 24h.",
    "price_percent": "Questioned ~{percent}% renewal hike on {policy} with no claims; found plan ₹{amount} cheaper "
    "online; revised quote to be sent.",
    "price": "Comparing renewal quotes, finds {brand} pricier and asked for discounts; may switch if not competitive.",
    "upsell_baby": "Wants to add newborn to health policy and asked about higher cover; interested in super top-up quote.",
    "upsell": "Bought a new home; wants {home_plan} quote with multi-policy discount and is considering a term plan.",
    "praise_claim": "Called to thank {brand} — claim {claim} settled within a week via smooth cashless process; "
    "referred a relative.",
    "praise": "Praised quick 2-minute app renewal and instant policy delivery on WhatsApp.",
    "address": "Requested address update on policy records; endorsement within 3 working days.",
    "certificate": "Requested premium-paid certificate for {policy} for tax filing and confirmed nominee.",
    "general": "Asked renewal due date for {policy} and wants e-NACH auto-debit set up.",
}

# --- fixed values: question vocabulary ----------------------------------------------------------
CITIES = (
    "Mumbai", "Pune", "Delhi", "Bengaluru", "Chennai", "Hyderabad", "Kolkata", "Ahmedabad", "Jaipur",
    "Lucknow", "Kochi", "Indore", "Chandigarh", "Nagpur", "Coimbatore", "Nashik", "Mysuru", "Vadodara",
)
CITY_ALIASES = {"bangalore": "Bengaluru"}
SEGMENT_WORDS = {"hni": "HNI", "sme": "SME Owner", "mass affluent": "Mass Affluent", "affluent": "Mass Affluent"}
INTENT_WORDS = {
    CANCELLATION: ("cancel", "port", "leave", "switch"),
    CLAIM: ("claim", "complain", "complaint"),
    PRICE: ("price", "premium hike", "discount", "expensive", "cheaper"),
    UPSELL: ("upsell", "cross-sell", "cross sell", "upgrade", "interested in", "add cover"),
    PRAISE: ("happy", "praise", "promoter", "advocate", "satisfied"),
}
QUERYABLE_TABLES = ("next_best_actions", "customer_360", "interaction_insights", "policies", "action_status",
                    "action_uptake", "action_uptake_by_category", "churn_risk")
SCHEMAS = ("app", "curated")


@dataclass(frozen=True)
class Wording:
    """Names and id formats that differ from one insurer to the next."""

    brand: str = "our company"
    home_plan: str = "Home Protect"
    offers: dict = field(default_factory=lambda: {
        "Health": "Health Shield Family Floater",
        "Life": "Term Secure life cover",
        "Home": "Home Protect",
    })
    fallback_offer: str = "Super Top-Up health cover"
    policy_pattern: str = r"[A-Z]{3}-[A-Z]{2}-\d+"
    claim_pattern: str = r"CLM-\d+"
    customer_pattern: str = r"\bc\d{4}\b"


DEFAULT_WORDING = Wording()
