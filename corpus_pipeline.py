"""A corpus pipeline in stages, each one of the operators of havenlens.llm over all that the stage before it kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from havenlens.llm import langid, linededup, packing, simhash, substring
from havenlens.llm.common import read, small_batches, stored
from havenlens.llm.queries import FOLD, packed
from havenlens.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def step(stage):
    """A stage whose Python workers get small batches."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@step
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. Any text is given the nearest language that labels teach, so one in another language stays."""
    return langid.keep_known(docs, langid.fit(docs, F.expr(f"{FOLD} != 2")))


@step
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of which nothing is left go."""
    return linededup.deduplicate(docs)


@step
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs, shingle=3, most_bits=2)


@step
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document or line has; documents of which nothing is left go."""
    return substring.deduplicate(docs)


@step
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packed(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", passages),
    ("packing", sequences),
]
#: SQL has no tokenizer; tests/llm compares the stages with a plain version in memory.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it wrote; the last one's rows."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
