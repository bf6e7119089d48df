from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from havenlens import schemas  # noqa: E402
from havenlens.session import build_session  # noqa: E402
from sample_days import AS_OF, at, day  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """DataFrame of a schema from dicts; missing columns are null."""
    def make(schema, dicts):
        names = [f.name for f in schema.fields]
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)

    return make


@pytest.fixture(scope="session")
def sample(spark, rows, tmp_path_factory):
    """Hand-made edge rows, one customer per situation, written once."""
    from decimal import Decimal

    def customer(cid, name="Ana Lee", tenure="1.0", **extra):
        return dict(customer_id=cid, full_name=name, tenure_years=Decimal(tenure), segment="Mass", city="Pune",
                    preferred_channel="Phone", **extra)

    def policy(pid, cid, product="Motor", renews=200, status="Active", premium=1000):
        return dict(policy_id=pid, customer_id=cid, product_line=product, plan_name="Plan " + pid, sum_insured=10_000,
                    annual_premium=premium, renewal_date=day(renews), status=status)

    def call(tid, cid, offset, said, hour=0):
        return dict(transcript_id=tid, customer_id=cid, call_ts=at(offset, hour), duration_sec=90,
                    transcript_text="Agent: Hello\n" + said)

    customers = [customer("none"), customer("lapsed"), customer("tie"), customer("late3"), customer("claims"),
                 customer("calls", tenure="8.0"), customer("hot")]
    customers += [customer(f"renew{d}") for d in (-10, 0, 30, 31, 60, 61, 90, 91)]
    policies = [policy("L1", "lapsed", renews=-40, status="Lapsed"),
                policy("T2", "tie", "Life", 100), policy("T1", "tie", "Health", 100), policy("X1", "late3")]
    policies += [policy(f"R{d}", f"renew{d}", renews=d) for d in (-10, 0, 30, 31, 60, 61, 90, 91)]
    policies += [policy(f"H{i:04d}", "hot", renews=i % 80) for i in range(2500)]
    claims = [dict(claim_id="c30", customer_id="claims", claim_date=day(-40), status="Pending", days_open=30,
                   claim_amount=100),
              dict(claim_id="c31", customer_id="claims", claim_date=day(-41), status="Under Review", days_open=31,
                   claim_amount=100),
              dict(claim_id="edge", customer_id="claims", claim_date=dt.date(2000, 5, 5), status="Settled",
                   days_to_settle=31, approved_amount=50, claim_amount=100),
              dict(claim_id="old", customer_id="claims", claim_date=dt.date(2000, 5, 4), status="Rejected",
                   claim_amount=100)]
    payments = [dict(payment_id=f"p{i}", customer_id="late3", due_date=day(-30 * i - 1), payment_status=s, days_late=d)
                for i, (s, d) in enumerate([("Late", 7), ("Missed", None), ("On-time", 0)])]
    calls = [call("a90", "calls", -90, "Customer: please port my policy"),
             call("b180", "calls", -180, "Customer: very easy, thank you"),
             call("c181", "calls", -181, "Customer: a term plan please"),
             call("d1", "calls", -5, "Customer: when is it due", 9), call("d2", "calls", -5, "Customer: my address", 9),
             call("quiet", "renew0", -10, "Agent: nobody there")]
    calls += [call(f"h{i:05d}", "hot", -1 - i % 170, "Customer: I want to cancel" if i % 3 else "Customer: cheaper?")
              for i in range(3000)]
    made = dict(customers=customers, policies=policies, claims=claims, payments=payments, call_transcripts=calls)
    folder = tmp_path_factory.mktemp("sample")
    for name, dicts in made.items():
        rows(schemas.RAW_TABLES[name], dicts).coalesce(1).write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in made}


@pytest.fixture(scope="session")
def plain_book(sample):
    from havenlens.plans.book import book_from_tables

    return book_from_tables(sample, AS_OF, stamped_at=dt.datetime(2001, 11, 5, 6))


@pytest.fixture(scope="session")
def book(spark, sample, tmp_path_factory):
    """The same book with its derived tables read from written stages."""
    from havenlens.plans.book import book_from_tables, on_stages, run_stages

    made = book_from_tables(sample, AS_OF, stamped_at=dt.datetime(2001, 11, 5, 6))
    return on_stages(made, run_stages(spark, made, str(tmp_path_factory.mktemp("stages"))))


@pytest.fixture(scope="session")
def risk_rows(book):
    return {r.customer_id: r for r in book.risk.collect()}


@pytest.fixture(scope="session")
def nba_rows(book):
    return {r.customer_id: r for r in book.nba.collect()}
