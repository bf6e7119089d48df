from __future__ import annotations

from sample_days import AS_OF, day

from havenlens import constants as K
from havenlens.operators import customer360


def test_width_and_one_row_per_customer(book):
    assert len(book.c360.columns) == 59
    assert book.c360.count() == book.customers.count() == book.c360.select("customer_id").distinct().count()


def test_customer_without_anything(risk_rows):
    r = risk_rows["none"]
    assert all(r[c] == 0 for c in K.ZERO_FILLED)
    assert r.product_lines is None and r.total_sum_insured is None and r.call_minutes_180d is None
    assert r.has_ai_insights is False and r.n_in_grace is None and r.days_to_renewal is None


def test_lapsed_policies_count_for_products_but_not_for_premium(risk_rows):
    r = risk_rows["lapsed"]
    assert (r.product_lines, r.total_sum_insured, r.has_motor) == ("Motor", 10_000, 1)
    assert (r.total_annual_premium, r.n_active_policies, r.next_renewal_policy_id) == (0, 0, None)


def test_equal_renewal_dates_go_to_the_smaller_policy_id(risk_rows):
    r = risk_rows["tie"]
    assert (r.next_renewal_policy_id, r.next_renewal_product, r.product_lines) == ("T1", "Health", "Health, Life")


def test_claim_windows_are_calendar_months_and_thirty_days_is_not_slow(risk_rows):
    r = risk_rows["claims"]
    assert (r.n_claims, r.n_open_claims, r.n_rejected_claims, r.n_slow_claims) == (3, 2, 0, 2)
    assert (r.total_claimed, r.total_approved, r.avg_days_to_settle, r.max_open_claim_days) == (300, 50, 31.0, 31)


def test_call_windows_include_their_first_day(risk_rows):
    r = risk_rows["calls"]
    assert (r.n_calls_180d, r.n_cancel_intent_90d, r.n_service_praise_180d, r.n_upsell_interest_180d) == (4, 1, 1, 0)
    assert r.call_minutes_180d == 6 and r.last_intent == K.GENERAL


def test_call_without_customer_words_is_neutral(risk_rows):
    assert risk_rows["renew0"].last_sentiment == 0.0


def test_insights_may_be_absent(sample, book):
    wide = customer360.customer_360(*[sample[t] for t in ("customers", "policies", "claims", "payments",
                                                         "call_transcripts")], None, AS_OF)
    assert wide.columns == book.c360.columns
    assert wide.where("has_ai_insights").count() == 0


def test_renewal_rollup_agrees_with_the_profile(sample):
    soon = {r.customer_id: r.next_renewal_date for r in customer360.next_renewal(sample["policies"], AS_OF).collect()}
    assert soon["renew-10"] == day(-10) and "lapsed" not in soon
