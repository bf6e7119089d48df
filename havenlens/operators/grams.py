"""Substring search of many needles in many texts by a join of grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that a gram may have. A needle's grams are the largest of these that fit into it, so that one is most of it.
SIZES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def gram_size(text: Column) -> Column:
    return F.array_max(F.filter(F.array(*[F.lit(n) for n in SIZES]), lambda n: n <= F.length(text)))


def grams(text: Column, size: Column) -> Column:
    """The different runs of `size` code points in a text; the one of none is empty."""
    places = F.length(text) - size + 1
    return F.when(places > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(places, F.lit(1))), lambda at: F.substring(text, at, size)))).otherwise(
        F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Every column of `texts`, which has `hay`, beside every column of `needles`, which has `needle` and a unique
    `needle_id`, where hay contains needle. Names must differ. Nulls contain nothing and are in nothing; an empty needle is in all.

    A text that holds a needle holds all its grams, so the rarest of them among the texts is enough to join by: a needle with
    a gram that no text has costs nothing, and a frequent gram is read for those needles alone that have no rarer one. Grams
    grow with the needle, so that needles that differ, be it in a digit or two, have different ones. What meets is verified.
    Texts give grams of the sizes that needles have, and keep those that needles have.
    """
    return meeting(texts, needles).where(F.contains("hay", "needle"))


def meeting(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """The pairs of `containing` before they are verified: those whose text has the needle's rarest gram."""
    some = needles.where("needle IS NOT NULL")
    wanted = some.select("needle_id", F.explode(grams(F.col("needle"), gram_size(F.col("needle")))).alias("gram"))
    known = wanted.select("gram").distinct()
    sizes = some.agg(F.collect_set(gram_size(F.col("needle"))).alias("sizes")).scalar()
    given = texts.where("hay IS NOT NULL").withColumn("sizes", sizes).withColumn("gram", F.explode(F.flatten(
        F.transform("sizes", lambda size: grams(F.col("hay"), size))))).drop("sizes").join(known, "gram", "left_semi")
    counts = given.groupBy("gram").agg(F.count("*").alias("n"))
    keys = wanted.join(counts, "gram", "left").groupBy("needle_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    keys = keys.where("rarest.n > 0").select("needle_id", F.col("rarest.gram").alias("gram"))
    return given.join(keys, "gram").drop("gram").join(needles, "needle_id")
