"""Quality rules as a ledger: every rule is evaluated once and leaves a bit, policies are masks over the bits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from havenlens.llm.common import let

WORD_BREAK = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over the measurements, under which a document fails. Its bit is its place in the list."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
#: Policies by version: the rules under which a document goes.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(rule.name for rule in RULES),
}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {rule.name: place for place, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


def _windows(words: Column, length: int) -> Column:
    """Hashes of all runs of `length` consecutive words; none in a shorter text."""
    hashes = F.when(F.size(words) >= length, F.transform(words, lambda word: F.xxhash64(word)))
    run = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (length - 1)),
        lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(length)])))
    return F.coalesce(run, F.array().cast("array<bigint>"))


def _covered_by_repeats(windows: Column, length: int) -> Column:
    """How many words lie in windows that occur twice or more.

    Windows are sorted by hash, those equal to a neighbour are kept and sorted back by place; each adds the words up to
    the next one, its own length at most. So the work is n log n in the words, whatever repeats.
    """
    def spread(places):
        steps = F.transform(places, lambda p, i: F.least(
            F.lit(length), F.coalesce(F.get(places, i + 1) - p, F.lit(length))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs):
        twins = F.filter(pairs, lambda p, i: (
            F.coalesce(F.get(pairs, i - 1).getField("hash") == p.getField("hash"), F.lit(False))
            | F.coalesce(F.get(pairs, i + 1).getField("hash") == p.getField("hash"), F.lit(False))))
        return let(F.sort_array(F.transform(twins, lambda p: p.getField("place"))), spread)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, repeated))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every whole text, without a shuffle.

    Words are runs of anything but blanks (space, tab to carriage return); lines are split at line feeds and count if
    they hold a word. A null or empty text measures zero. Rows with equal ids are measured one by one.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))
    split = docs.select(
        docs[id_col].alias("doc_id"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.array_remove(F.split(text, WORD_BREAK), "").alias("words"),
        let(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("n_distinct"))).alias("lines"))
    return split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.n_distinct")).cast("long").alias("n_dup_lines"),
        let(_windows(F.col("words"), window), lambda w: _covered_by_repeats(w, window)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each document and fail_bits, one bit per rule it fails."""
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def passes(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """Whether a document of the ledger fails no rule of a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(book: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(policy, rule, n_docs, n_kept, n_failing, n_only): what each rule of each policy does, from the ledger alone.

    n_failing documents fail the rule, n_only fail no other rule of the policy: leaving the rule out would keep that many
    more. Documents are first counted per distinct fail_bits, so what is expanded is as small as the set of patterns.
    """
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    entries = F.array(*[
        F.struct(F.lit(name).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask(names, rules)).cast("long").alias("all"),
                 F.lit(mask([rule], rules)).cast("long").alias("own"))
        for name, names in policies.items() for rule in names])
    failed = F.col("fail_bits").bitwiseAND(F.col("all"))
    return patterns.select("fail_bits", "n", F.inline(entries)).groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("own")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(failed == F.col("own"), F.col("n")).otherwise(0)).alias("n_only"))
