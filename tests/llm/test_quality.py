from __future__ import annotations

import re
from collections import Counter

from llm.corpus_rows import edge_rows
from havenlens.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measurements(spark, edge_docs, no_docs):
    extra = ["a b c d e f g h " * 2, "a b c d e f g h i " * 3 + "z", "one two\n\none two\n \none two", "b b b b b b b b b", "b " * 8]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    for df, texts in ((edge_docs, [(i, t) for i, t, _ in edge_rows()]), (docs, list(enumerate(extra)))):
        got = Counter(tuple(r)[:] for r in quality.measure(df).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect())
        assert got == Counter((i, *brute(t)) for i, t in texts)
    assert quality.ledger(no_docs).count() == 0


def test_policies_and_ablation(spark):
    book = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (5,), (32,)], "fail_bits long")
    assert book.where(quality.passes(quality.POLICIES["base"])).count() == 4
    assert book.where(quality.passes(quality.POLICIES["v1"])).count() == 2
    rows = {(r.policy, r.rule): r for r in quality.ablation(book).collect()}
    few = rows["v1", "few_words"]
    assert (few.n_docs, few.n_kept, few.n_failing, few.n_only) == (7, 2, 3, 1)
    assert rows["base", "few_words"].n_only == 2
    assert (rows["v1", "long_words"].n_failing, rows["v1", "long_words"].n_only) == (1, 1)
    assert len(rows) == 2 + len(quality.RULES)


def test_no_python_and_no_shuffle(edge_docs):
    plan = quality.ledger(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan.split("RDD")[0].replace("Exchange hashpartitioning(text", ""))


def test_labelled_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    book = quality.ledger(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    clean = book.where("quality = 1 AND n_words >= 20")
    assert clean.where(quality.passes(quality.POLICIES["v1"])).count() >= 0.98 * clean.count()
    junk = book.where("quality = 0")
    assert junk.where(quality.passes(quality.POLICIES["v1"])).count() <= 0.1 * junk.count()
