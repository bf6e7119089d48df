"""CSV and Parquet sources, JSON export, snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from havenlens import schemas
from havenlens.functions import churn
from havenlens.functions.times import moment

DATE_COLUMNS = ("customer_since", "next_renewal_date", "start_date", "renewal_date", "claim_date", "settled_date",
                "due_date", "paid_date", "call_ts", "last_call_ts")
JSON_COLUMNS = {"risk_drivers": schemas.DRIVERS, "evidence": T.ArrayType(T.StringType())}
EXPORT_ORDER = {"interaction_insights": ("call_ts", "transcript_id"), "payments": ("due_date", "payment_id")}


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """CSV with one header row; empty and NULL fields are null; a record that does not fit stops the read.

    Fields arrive as text and are cast afterwards, since "NULL" must be null in number columns too. `multiline` allows
    line breaks inside quotes (transcripts); such files cannot be split, so deliver them as many files.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (spark.read.schema(as_text).option("header", True).option("quote", '"').option("escape", '"')
           .option("encoding", "UTF-8").option("multiLine", multiline).option("mode", "FAILFAST").csv(path))
    return raw.select(*[
        F.when(~F.col(f.name).isin("", "NULL"), F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_raw_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema, name == "call_transcripts")
            for name, schema in schemas.RAW_TABLES.items()}


def write_table(df: DataFrame, path: str, month_of: str | None = None, mode: str = "overwrite") -> None:
    """Parquet table; with `month_of`, laid out by the month of that column.

    Rows are rebalanced by month, which splits the busy months instead of sending each to one task and keeps a first load
    of all months, in either mode, from leaving a file of every task in every month.
    """
    if month_of is None:
        df.write.mode(mode).parquet(path)
        return
    by_month = df.withColumn("month", F.date_format(month_of, "yyyy-MM")).hint("rebalance", F.col("month"))
    by_month.write.mode(mode).partitionBy("month").parquet(path)


def create_empty(spark: SparkSession, like: DataFrame, path: str) -> None:
    """A table by month without rows, unless there is one."""
    spark.createDataFrame([], like.schema).withColumn("month", F.lit("none")).write.mode("ignore").partitionBy(
        "month").parquet(path)


def write_parquet_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", "call_ts" if name == "interaction_insights" else None)


def read_parquet_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def load_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows); a table with no rows still shows."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in tables.items()]
    stacked = counts[0]
    for count in counts[1:]:
        stacked = stacked.unionByName(count)
    return stacked


def normalise_types(df: DataFrame, date_columns: Sequence[str] = DATE_COLUMNS,
                    json_columns: Mapping[str, T.DataType] = JSON_COLUMNS) -> DataFrame:
    """Text dates to timestamps (unreadable ones to null), JSON text to arrays (null to empty), drivers strongest first."""
    changed: dict[str, Column] = {}
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name in date_columns and isinstance(field.dataType, T.StringType):
            changed[field.name] = F.try_to_timestamp(column)
        elif field.name in json_columns:
            kind = json_columns[field.name]
            parsed = F.from_json(column, kind) if isinstance(field.dataType, T.StringType) else column
            filled = F.coalesce(parsed, F.array().cast(kind))
            changed[field.name] = churn.drivers_ranked(filled) if field.name == "risk_drivers" else filled
    return df.withColumns(changed) if changed else df


def json_ready(df: DataFrame) -> DataFrame:
    """Values as the JSON export writes them: ISO seconds, no NaN, the replacement character as a dash."""
    def shown(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        elif isinstance(field.dataType, T.StringType):
            column = F.replace(column, F.lit("�"), F.lit("—"))
        return column.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def export_json(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as JSON records; calls and payments in order of time and id, so that a busy day is split over tasks."""
    for name, df in tables.items():
        order = [c for c in EXPORT_ORDER.get(name, ()) if c in df.columns]
        ready = df.orderBy(*order) if order else df
        json_ready(ready).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder.rstrip('/')}/{name}")


def snapshot_360(c360: DataFrame, path: str) -> DataFrame:
    """Write the 360 once and read it back, so that everything downstream sees one version."""
    write_table(c360, path)
    return c360.sparkSession.read.parquet(path)


def run_meta(accuracy: DataFrame, as_of: dt.date, source: str = "rules", note: str = "",
             generated_at: dt.datetime | None = None) -> DataFrame:
    """One row describing a run."""
    return accuracy.select(
        F.lit(source).alias("source"), F.lit(as_of).alias("as_of"), moment(generated_at).alias("generated_at"),
        "intent_accuracy_pct", F.lit(note).alias("note"))


def key_checks(tables: Mapping[str, tuple[DataFrame, str]],
               references: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check_name, n_bad): null and duplicate keys per table, orphans per reference.

    `tables` maps a name to (rows, key); `references` maps a name to (child, column, parent, key).
    """
    reports = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        reports.append(per_key.agg(
            F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count_if(F.col("key").isNotNull() & (F.col("n") > 1)).alias("duplicates"),
        ).select(F.inline(F.array(
            F.struct(F.lit(f"{name}.null_keys").alias("check_name"), F.col("nulls").alias("n_bad")),
            F.struct(F.lit(f"{name}.duplicate_keys").alias("check_name"), F.col("duplicates").alias("n_bad"))))))
    for name, (child, column, parent, key) in references.items():
        linked = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
        orphans = linked.join(parent.select(F.col(key).alias("key")), "key", "left_anti")
        reports.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad")).select(
            F.lit(f"{name}.orphans").alias("check_name"), "n_bad"))
    stacked = reports[0]
    for report in reports[1:]:
        stacked = stacked.unionByName(report)
    return stacked
