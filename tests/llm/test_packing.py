from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.corpus_rows import edge_rows, prose
from havenlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokens():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_plan_uses_every_token_once_and_fills_every_window():
    chance = random.Random(1)
    for last in (True, False):
        for _ in range(200):
            docs = {i: (chance.choice([0, 7]), chance.choice([1, 2, 30, 63, 64, 65, 700, 2048, 2049, chance.randint(1, 9000)]))
                    for i in range(chance.randint(0, 50))}
            sequences, off = packing.plan(docs, last=last)
            assert not (last and off)
            got = defaultdict(list)
            for sequence in [*sequences, off]:
                for doc, start, n in sequence:
                    got[doc].append((start, n))
            for doc, (start, n) in docs.items():
                for at, size in sorted(got[doc]):
                    assert at == start and size > 0
                    start, n = start + size, n - size
                assert n == 0
            sizes = [sum(n for _, _, n in s) for s in sequences]
            assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes)
            assert sum(n not in packing.TIERS for n in sizes) <= 6


def test_short_rests_fill_the_gap_of_a_long_window():
    sequences, _ = packing.plan({0: (0, 1500), 1: (0, 500), 2: (0, 48), 3: (0, 2048)})
    assert [(3, 0, 2048)] in sequences and [(0, 0, 1500), (1, 0, 500), (2, 0, 48)] in sequences


def check(rows, docs, tokens):
    """docs: how often each (doc_id, text) occurs."""
    pieces, sequences, groups = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, zlib.crc32(bytes(r.ids)), bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.window, r.step_group))
        groups[r.step_group] += r.length
    want, got = [], []
    for doc_id, text in docs:
        want.append((doc_id, tokens(text)))
    for doc_id, text in docs:
        if sum(d == doc_id for d, _ in docs) == 1:
            own = sorted(pieces[doc_id])
            assert [s for s, *_ in own] == [sum(n for _, n, *_ in own[:i]) for i in range(len(own))]
            ids = np.frombuffer(b"".join(p[3] for p in own), "<u4").tolist()
            assert ids == tokens(text) and {p[4] for p in own} == {len(ids)}
        got.append(doc_id)
    assert sum(n for p in pieces.values() for _, n, *_ in p) == sum(len(ids) for _, ids in want)
    for own in sequences.values():
        own.sort()
        assert [o for o, *_ in own] == [sum(n for _, n, *_ in own[:i]) for i in range(len(own))]
        total = sum(n for _, n, *_ in own)
        assert total <= 2048 and total & (total - 1) == 0 and {w for _, _, w, _ in own} == {total} and len({g for *_, g in own}) == 1
    return groups


def test_edge_rows(edge_docs, no_docs, tokens):
    rows = packing.pack(edge_docs, PATH).collect()
    check(rows, [(i, t) for i, t, _ in edge_rows()], tokens)
    assert packing.pack(no_docs, PATH).count() == 0


def test_step_groups_are_equal_however_often_a_task_packs(spark, tokens):
    docs = [(i, prose(i, random.Random(i).choice([3, 20, 90, 400, 3000]))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    groups = check(packing.pack(df, PATH, gathered=9000, step_tokens=8192).collect(), docs, tokens)
    assert sorted(groups.values())[1:] == [8192] * (len(groups) - 1) and len(groups) > 5


def test_query(spark, tokens):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["op5_tiered_packing"](spark, folder).collect()
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows:
        ids = np.array(texts[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == len(texts[r.doc_id]) and len(ids) == 4 * r.length
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))
