"""Append-only log of agent decisions and what it says about uptake."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens import constants as K
from havenlens import schemas
from havenlens.functions.numeric import ratio
from havenlens.functions.times import moment
from havenlens.sources.versions import claim

STATUS_COLUMNS = ("action_category", "action", "status", "agent", "ts", "note")


def append_action_log(decisions: DataFrame, path: str, agent: str | None = None,
                      now: dt.datetime | None = None) -> None:
    """Append decisions to the log at `path`, which the first ones start and read_log reads.

    An append is a folder batch=n of its own. Its number is claimed by a file that only one writer can create, and ids are told
    by the number and the row's place, so no stored id is read and several writers may append at once. An append that broke
    off keeps its number and is not read; the next one takes another.
    """
    number = claim(decisions.sparkSession, path, "batch")
    batch_entries(decisions, number, agent, now).write.parquet(f"{path}/batch={number}")


#: Ids of one arriving batch: the high bits are its number, below are the part that holds the row and the row's place there.
BATCH_BITS, BATCH_PARTS = 39, 64


def batch_entries(decisions: DataFrame, batch_id: int, agent: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Log rows for the decisions of one batch, with ids above those of all batches before, told by batch and position.

    Rows are dealt by their content into a fixed number of parts and sorted there, so the same batch gives the same ids
    however often it is replayed, and no stored id is looked at.
    """
    columns = decisions.columns
    dealt = decisions.repartition(BATCH_PARTS, F.xxhash64(*columns)).sortWithinPartitions(*columns)
    rows = dealt.withColumns({
        "log_id": F.lit(batch_id + 1) * F.lit(1 << BATCH_BITS) + F.monotonically_increasing_id(),
        "agent": F.coalesce("agent", F.lit(agent)) if "agent" in columns else F.lit(agent),
        "ts": F.coalesce("ts", moment(now)) if "ts" in columns else moment(now),
    })
    return schemas.conform(rows, schemas.ACTION_LOG)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at `path`, whether it was appended to or fed by a stream."""
    return spark.read.schema(schemas.ACTION_LOG).option("recursiveFileLookup", "true").parquet(path)


def latest_decision(log: DataFrame) -> DataFrame:
    """Latest valid decision per customer with its log id. A max over structs needs no window and combines map-side."""
    valid = log.where(F.col("status").isin(*K.DECISION_STATUSES))
    order = ("ts", "log_id", *[c for c in STATUS_COLUMNS if c != "ts"])
    return valid.groupBy("customer_id").agg(F.max(F.struct(*order)).alias("d")).select(
        "customer_id", F.col("d.log_id").alias("log_id"), *[F.col(f"d.{c}").alias(c) for c in STATUS_COLUMNS])


def action_status(log: DataFrame) -> DataFrame:
    return latest_decision(log).drop("log_id")


def action_uptake(status: DataFrame) -> DataFrame:
    accepted, done = F.count_if(F.col("status") == "Accepted"), F.count_if(F.col("status") == "Done")
    return status.agg(
        F.count("*").alias("reviewed"), accepted.alias("accepted"), done.alias("done"),
        F.count_if(F.col("status") == "Rejected").alias("rejected"),
        ratio(accepted + done, F.count("*")).alias("uptake_rate"))


def action_uptake_by_category(status: DataFrame) -> DataFrame:
    taken = F.count_if(F.col("status").isin("Accepted", "Done"))
    return status.groupBy("action_category").agg(
        F.count("*").alias("reviewed"), ratio(taken, F.count("*")).alias("uptake_rate"))
