"""The pipeline against a plain version in memory, and the registered queries against their SQL."""
from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, differences
from havenlens.llm import queries
from llm import test_dedup, test_simhash
from llm.corpus_rows import prose

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    chance = random.Random(8)
    common = [prose(500 + i, 30) for i in range(5)]
    block = "\n".join(prose(600 + i, 8) for i in range(4))
    docs = []
    for i in range(160):
        parts = [prose(i, chance.choice([12, 40, 150]))]
        if i % 4 == 0:
            parts.insert(0, common[i % 5])
        if i % 7 == 0:
            parts.append("\n" + block)
        if i % 9 == 8:
            parts = [docs[chance.randrange(len(docs))][1] or "x"]
        if i % 27 == 5:
            parts = [docs[i - 3][1] + " one more word"]
        docs.append((i, " ".join(parts), ("en", "de", "fr", "es", None)[i % 5], f"src{i % 3}", i))
    return docs + [(200, None, "en", None, None), (201, "", "en", "s", 0), (202, "12 34 --", "fr", "s", 8), (203, prose(700, 6000), "en", "s", 1),
                   (204, prose(700, 6000), "en", "s", 1), (205, "Été.", "fr", "s", 4), (206, "\n\n", "fr", "s", 2)]


def plain(docs):
    """(doc_id, text) that reach packing."""
    rows = [(i, t) for i, t, *_ in docs if any(c.isalpha() for c in t or "")]

    def cut(rows, units, words):
        taken = test_dedup.brute(rows, units, words)
        new = [(i, test_dedup.without(t, taken[i, t]), taken[i, t]) for i, t in rows]
        return [(i, t) for i, t, gone in new if not gone or test_dedup.normal(t)]

    rows = cut(rows, test_dedup.line_units, 0)
    prints = {i: test_simhash.brute_fingerprint(t) for i, t in rows}
    groups = test_simhash.brute_groups(prints.values(), 2)
    first = {min(i for i, _ in rows if prints[i] in g) for g in groups}
    rows = [(i, t) for i, t in rows if i in first]
    return cut(rows, test_dedup.part_units, 25)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_run_is_the_plain_version(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in plain(documents())}
    rows = corpus_pipeline.run(spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys() and len(want) < len(documents()) - 20
    import numpy as np

    for doc_id, ids in want.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= 2048 and total & (total - 1) == 0


def test_stages_keep_the_columns_and_take_an_empty_table(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, folder)
        assert out.columns == docs.columns and out.count() == 0
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_agrees_with_its_check(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= entry.queries().keys()


def test_the_rest_imports_without_these_operators(tmp_path):
    """As if the folder and the pipeline had been deleted."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('havenlens.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries())\n"
        "assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
