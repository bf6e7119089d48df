"""Minimum bin slack against all subsets in memory, and packing against the tokenizers library."""
from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from havenlens.llm import binpack
from llm.corpus_rows import edge_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokens():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_the_fullest_combination():
    chance = random.Random(1)
    for _ in range(300):
        have = Counter(chance.choices(range(1, 25), k=chance.randint(0, 9)))
        room = chance.randint(0, 60)
        sums = {sum(c) for n in range(sum(have.values()) + 1) for c in itertools.combinations(have.elements(), n)}
        taken = binpack.fullest(have, room)
        assert all(0 < many <= have[n] for n, many in taken.items())
        assert sum(n * many for n, many in taken.items()) == max(s for s in sums if s <= room)


def first_fit(counts):
    rooms = []
    for n in sorted(counts.elements(), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        rooms[at:at + 1] = [(rooms[at] if at < len(rooms) else 1024) - n]
    return len(rooms)


def test_plans_use_every_piece_once_and_stay_small():
    chance = random.Random(2)
    for scale in (1, 1, 1, 40, 5000):
        counts = {n: chance.randint(0, scale) for n in chance.sample(range(1, 1025), 600)} | {1: 3 * scale, 1024: scale}
        bins = binpack.plan(counts)
        used = Counter()
        for kind, often in bins:
            assert often > 0 and sum(n * many for n, many in kind.items()) <= 1024
            for n, many in kind.items():
                used[n] += many * often
        assert used == {n: c for n, c in counts.items() if c}
        assert len(bins) < 1024 * 9
        if scale == 1:
            assert sum(often for _, often in bins) <= first_fit(used)
    assert binpack.plan({}) == [] and binpack.plan({600: 7}) == [({600: 1}, 7)]


def check(rows, docs, tokens):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = tokens(text)
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            own = np.array(ids[a:b], "<u4").tobytes()
            want[doc_id].append((piece, a, b - a, own, zlib.crc32(own)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    return sequences


def test_edge_rows(edge_docs, no_docs, tokens):
    rows = binpack.pack(edge_docs, PATH).collect()
    sequences = check(rows, [(i, t) for i, t, _ in edge_rows()], tokens)
    total = sum(len(tokens(t)) for _, t, _ in edge_rows())
    assert len(sequences) <= -(-total // 1024) + 1
    assert binpack.pack(no_docs, PATH).count() == 0


def test_a_length_that_a_third_of_all_documents_have(spark, tokens):
    docs = [(i, "word " * 99 if i % 3 == 0 else prose(i, 20 + i % 300)) for i in range(900)]
    for parts in (1, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        sequences = check(binpack.pack(df, PATH).collect(), docs, tokens)
        total = sum(len(tokens(t)) for _, t in docs)
        assert len(sequences) <= -(-total // 1024) + 1


def test_query(spark, tokens):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["op12_minimum_slack"](spark, folder).collect()
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows:
        own = texts[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r.length
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 2
