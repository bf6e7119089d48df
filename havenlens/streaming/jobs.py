"""New calls and new decisions, processed as they arrive with the batch operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from havenlens import constants as K
from havenlens.operators import decisions, insights, search, search_index
from havenlens.sources.tables import create_empty, write_table
from havenlens.sources.versions import drop, whole_versions


def stream_enrich(calls: DataFrame, path: str, checkpoint: str, wording: K.Wording = K.DEFAULT_WORDING,
                  enriched_at: dt.datetime | None = None) -> StreamingQuery:
    """Enrich arriving calls and append them to the insights table at `path`, each call once.

    Repeats are found against the stored ids, not in bounded stream state, so a late upload is never lost and a
    replayed batch adds nothing.
    """
    shape = insights.interaction_insights(calls, wording, enriched_at)
    create_empty(calls.sparkSession, shape, path)

    def append(batch: DataFrame, _batch_id: int) -> None:
        write_table(fresh_calls(batch, path, wording, enriched_at), path, month_of="call_ts", mode="append")

    return (calls.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def fresh_calls(batch: DataFrame, path: str, wording: K.Wording = K.DEFAULT_WORDING,
                enriched_at: dt.datetime | None = None) -> DataFrame:
    """Insights of the calls of a batch that the table at `path` does not hold yet.

    A call has one time, however late it is uploaded, so only the stored months that the batch holds calls of are read.
    Of repeats within a batch the latest call time stays, then the largest text.
    """
    once = one_of_each(batch)
    months = batch.select(F.date_format("call_ts", "yyyy-MM").alias("month")).distinct()
    kind = T.StructType([T.StructField("transcript_id", T.StringType()), T.StructField("month", T.StringType())])
    known = (batch.sparkSession.read.schema(kind).parquet(path)
             .join(F.broadcast(months), "month", "left_semi").select("transcript_id"))  # one row a month
    return insights.enrich_incremental(once, known, wording, enriched_at)


def one_of_each(batch: DataFrame) -> DataFrame:
    """The calls of a batch, of repeats the one with the latest call time, then the largest text."""
    names = batch.columns
    order = F.struct("call_ts", F.coalesce("transcript_text", F.lit("")), F.xxhash64(*names))
    return batch.groupBy("transcript_id").agg(F.max_by(F.struct(*names), order).alias("call")).select("call.*")


def stream_index(calls: DataFrame, path: str, index_path: str, checkpoint: str, wording: K.Wording = K.DEFAULT_WORDING,
                 enriched_at: dt.datetime | None = None) -> StreamingQuery:
    """Enrich arriving calls into the insights table at `path` and into the keyword index at `index_path`, each call once.

    Both writes skip what they hold, and a load of the index is not read before its own row is there. So a batch that broke
    between or within them is repaired when it is replayed.
    """
    create_empty(calls.sparkSession, insights.interaction_insights(calls, wording, enriched_at), path)

    def advance(batch: DataFrame, _batch_id: int) -> None:
        write_table(fresh_calls(batch, path, wording, enriched_at), path, month_of="call_ts", mode="append")
        told = insights.interaction_insights(one_of_each(batch), wording, enriched_at)
        search_index.append_index(search.search_corpus(told), index_path)

    return (calls.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_action_log(arriving: DataFrame, path: str, checkpoint: str, agent: str | None = None,
                      now: dt.datetime | None = None) -> StreamingQuery:
    """Append arriving decisions to the log at `path`, which decisions.read_log reads.

    Batch n is the folder batch=n, so a replay writes it again instead of appending twice, with the same ids; a folder that is
    not whole is one whose batch has not ended. Default agent and time are filled in. A log has one feeder: a stream or
    append_action_log; checkpoint and log belong together.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        decisions.batch_entries(batch, batch_id, agent, now).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


#: Buckets of the status table. A batch rewrites those its customers are in.
STATUS_BUCKETS = 64
_STATUS = "customer_id string, log_id bigint, action_category string, action string, status string, agent string, ts timestamp_ntz, note string"


def stream_action_status(log: DataFrame, path: str, checkpoint: str, buckets: int = STATUS_BUCKETS) -> StreamingQuery:
    """Keep the latest decision per customer as decisions arrive.

    Customers lie in buckets. Batch n reads the buckets of its own customers as batch n-1 has left them, writes these as
    version n, and at last where every bucket is now, so the other buckets are neither read nor written. A replayed batch
    writes the same version from the same input; what no reader of the last two batches needs is dropped.
    Table and checkpoint belong together: begin a new table when the checkpoint is lost.
    """
    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")
        before = _places(spark, path, batch_id - 1)
        latest = decisions.latest_decision(batch).persist()
        touched = [row.bucket for row in latest.select(bucket.alias("bucket")).distinct().collect()]  # numbers of buckets
        stored = [f"{path}/data/version={before[b]}/bucket={b}" for b in touched if b in before]
        if stored:
            merged = decisions.latest_decision(latest.unionByName(spark.read.schema(_STATUS).parquet(*stored)))
        else:
            merged = latest
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/data/version={batch_id}")
        now = before | {b: batch_id for b in touched}
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/places/version={batch_id}")
        latest.unpersist()
        oldest = _places(spark, path, batch_id - 2)
        for b, version in oldest.items():
            if version not in (before.get(b), now[b]):
                drop(spark, f"{path}/data/version={version}/bucket={b}")
        drop(spark, f"{path}/places/version={batch_id - 2}")

    return (log.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _places(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Which version of each bucket counts after a batch; a number per bucket."""
    if version not in whole_versions(spark, f"{path}/places"):
        return {}
    return {row.bucket: row.version for row in spark.read.schema("bucket int, version long").parquet(f"{path}/places/version={version}").collect()}


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The status table as the newest whole batch has left it."""
    places = _places(spark, path, max(whole_versions(spark, f"{path}/places"), default=-1))
    files = [f"{path}/data/version={version}/bucket={b}" for b, version in places.items()]
    table = spark.read.schema(_STATUS).parquet(*files) if files else spark.createDataFrame([], _STATUS)
    return table.drop("log_id")
