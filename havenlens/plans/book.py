"""The whole book of one insurer: sources and everything derived from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from havenlens import constants as K
from havenlens.operators import actions, customer360, decisions, insights, risk
from havenlens.sources import tables as io


@dataclass(frozen=True)
class Book:
    """Lazy tables. Every property is a plan; nothing runs until a caller acts on it."""

    customers: DataFrame
    policies: DataFrame
    claims: DataFrame
    payments: DataFrame
    call_transcripts: DataFrame
    as_of: dt.date
    wording: K.Wording = K.DEFAULT_WORDING
    stamped_at: dt.datetime | None = None
    action_log: DataFrame | None = None
    labels: DataFrame | None = None
    archetypes: DataFrame | None = None

    @cached_property
    def insights(self) -> DataFrame:
        return insights.interaction_insights(self.call_transcripts, self.wording, self.stamped_at)

    @cached_property
    def c360(self) -> DataFrame:
        return customer360.customer_360(self.customers, self.policies, self.claims, self.payments,
                                        self.call_transcripts, self.insights, self.as_of)

    @cached_property
    def risk(self) -> DataFrame:
        return risk.churn_risk(self.c360, wording=self.wording)

    @cached_property
    def nba(self) -> DataFrame:
        return actions.next_best_actions(self.risk, self.insights, self.as_of, self.wording, self.stamped_at)

    @cached_property
    def status(self) -> DataFrame:
        return decisions.action_status(self.action_log)

    @property
    def logical_tables(self) -> dict[str, DataFrame]:
        return {"c360": self.c360, "nba": self.nba, "ins": self.insights}

    @property
    def queryable(self) -> dict[str, DataFrame]:
        tables = {"next_best_actions": self.nba, "customer_360": self.c360, "churn_risk": self.risk,
                  "interaction_insights": self.insights, "policies": self.policies}
        if self.action_log is not None:
            tables |= {"action_status": self.status, "action_uptake": decisions.action_uptake(self.status),
                       "action_uptake_by_category": decisions.action_uptake_by_category(self.status)}
        return tables


STAGES = ("interaction_insights", "customer_360", "churn_risk", "next_best_actions")


def run_stages(spark: SparkSession, book: Book, folder: str) -> dict[str, DataFrame]:
    """Write the four stages in order, each reading the one before from its table.

    Calls are read and scored once in their life: insights lie by month, and a later run into the same folder appends
    those of new calls only. What looks back 180 days reads the months concerned, and of them the columns it needs. A lost
    executor costs at most the stage that was running.
    """
    def stage(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        io.write_table(df, path)
        return spark.read.parquet(path)

    stored = {"interaction_insights": append_insights(spark, book, f"{folder.rstrip('/')}/interaction_insights")}
    stored["customer_360"] = stage("customer_360", customer360.customer_360(
        book.customers, book.policies, book.claims, book.payments, book.call_transcripts,
        stored["interaction_insights"], book.as_of))
    stored["churn_risk"] = stage("churn_risk", risk.churn_risk(stored["customer_360"], wording=book.wording))
    stored["next_best_actions"] = stage("next_best_actions", actions.next_best_actions(
        stored["churn_risk"], stored["interaction_insights"], book.as_of, book.wording, book.stamped_at))
    return stored


def on_stages(book: Book, stored: Mapping[str, DataFrame]) -> Book:
    """The same book with its derived tables read from written stages: what queries of several tables should run on."""
    made = replace(book)
    made.__dict__.update(insights=stored["interaction_insights"], c360=stored["customer_360"],
                         risk=stored["churn_risk"], nba=stored["next_best_actions"])
    return made


def append_insights(spark: SparkSession, book: Book, path: str) -> DataFrame:
    """The insights table at `path`, by month, after the insights of calls that it did not hold were added."""
    io.create_empty(spark, book.insights, path)
    known = spark.read.schema("transcript_id string").parquet(path)
    new = book.call_transcripts.select("transcript_id").join(known, "transcript_id", "left_anti")
    fresh = book.call_transcripts.join(new, "transcript_id", "left_semi")
    io.write_table(insights.interaction_insights(fresh, book.wording, book.stamped_at), path, "call_ts", "append")
    return spark.read.schema(T.StructType([*book.insights.schema.fields, T.StructField("month", T.StringType())])).parquet(path)


def book_from_tables(tables: Mapping[str, DataFrame], as_of: dt.date, **settings) -> Book:
    return Book(tables["customers"], tables["policies"], tables["claims"], tables["payments"],
                tables["call_transcripts"], as_of, labels=tables.get("eval_transcript_labels"), **settings)
