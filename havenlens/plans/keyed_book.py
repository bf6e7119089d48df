"""The book stored by customer, so that everything about a customer lies in one bucket of each table."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from havenlens.operators import actions, customer360, insights, risk
from havenlens.plans.book import Book, on_stages
from havenlens.sources import keyed
from havenlens.sources.versions import whole_versions

KEY = "customer_id"
SOURCES = ("customers", "policies", "claims", "payments", "call_transcripts")
#: Columns with a value of their own in most rows of the facts.
OWN_VALUES = ("policy_id", "claim_id", "payment_id", "transcript_id", "transcript_text", "customer_text")


def store_keyed(spark: SparkSession, book: Book, folder: str, buckets: int, spread: int = 4, scored: DataFrame | None = None) -> Book:
    """Write sources and stages in `buckets` buckets by customer, and return the book on them.

    Each source is exchanged once, when it is dealt into its buckets. What follows is grouped and joined by customer without
    another exchange: the 360, the risk and the actions now, and cards, source health and semantic queries later. `scored`
    are insights that exist already, such as those of append_insights; else all calls are scored, file by file of the
    stored calls, so that insights lie in the buckets of their calls without an exchange. Calls and their insights are one
    lane, the other sources a second one beside it.

    A run writes new folders and, last, the layout that names them, so readers see the run before until this one is whole,
    and a run that broke off is never read. Choose so many buckets that one is some hundred megabytes of a fact table.
    """
    run = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    stored: dict[str, DataFrame] = {}
    paths: dict[str, str] = {}

    def keep(name: str, df: DataFrame, files: int = 1) -> DataFrame:
        paths[name] = f"{run}/{name}"
        stored[name] = keyed.write_keyed(df, paths[name], KEY, buckets, files, [c for c in OWN_VALUES if c in df.columns])
        return stored[name]

    def keep_calls() -> None:
        calls = keep("call_transcripts", book.call_transcripts, spread)
        if scored is None:
            keep("interaction_insights", insights.interaction_insights(calls, book.wording, book.stamped_at), 0)
        else:
            keep("interaction_insights", scored, spread)

    def keep_others() -> None:
        for name in ("claims", "payments", "policies", "customers"):
            keep(name, getattr(book, name), 1 if name == "customers" else spread)

    with ThreadPoolExecutor(2) as lanes:
        for lane in [lanes.submit(inheritable_thread_target(spark)(work)) for work in (keep_calls, keep_others)]:
            lane.result()
    on = replace(book, **{name: stored[name] for name in SOURCES})
    told = stored["interaction_insights"]
    c360 = keep("customer_360", customer360.customer_360(
        on.customers, on.policies, on.claims, on.payments, on.call_transcripts, told, book.as_of))
    scores = keep("churn_risk", risk.churn_risk(c360, wording=book.wording))
    keep("next_best_actions", actions.next_best_actions(scores, told, book.as_of, book.wording, book.stamped_at))
    layouts = f"{folder.rstrip('/')}/layouts"
    keyed.write_layout(spark, stored, paths, KEY, buckets, f"{layouts}/version={max(whole_versions(spark, layouts), default=0) + 1}")
    return on_stages(on, stored)


def open_keyed_book(spark: SparkSession, book: Book, folder: str) -> Book:
    """The book on the newest whole run below `folder`, from any session; of `book` only the settings and the log are used."""
    layouts = f"{folder.rstrip('/')}/layouts"
    stored = keyed.open_layout(spark, f"{layouts}/version={max(whole_versions(spark, layouts))}")
    return on_stages(replace(book, **{name: stored[name] for name in SOURCES}), stored)
