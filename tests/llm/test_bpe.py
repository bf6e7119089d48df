from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.corpus_rows import edge_rows
from havenlens.llm import bpe
from havenlens.llm.chunks import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.vocabulary(PATH).ids
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode(texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in map(bpe.encoder(PATH, public_tokenizers.PATTERN), texts)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_like_the_library(text):
    ranks = bpe.vocabulary(PATH).ids
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encode([text]) == [library.encode_ordinary(text)]


def test_blanks_marks_and_long_runs(reference):
    chance = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", " \n", "é", "1", "½", "'s", "'", "😀", "\x1c", "\x85", "\xa0", " ", "中文", "!!", "\r\n",
                "<|endoftext|>", "Ⅷ"]
    texts = ["".join(chance.choices(alphabet, k=chance.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 200, "\n" * 30 + "x", "z  ", ""]
    assert encode(texts) == [reference(t) for t in texts]


def test_any_bytes_round_trip():
    vocab, chance = bpe.vocabulary(PATH), random.Random(4)
    for _ in range(300):
        piece = bytes(chance.choices(range(256), k=chance.randint(1, 40)))
        assert vocab.decode(vocab.encode_piece(piece)) == piece


def test_a_token_that_merges_never_reach_stands_for_its_whole_piece_only():
    vocab = bpe.Vocabulary({**{bytes([b]): b for b in range(256)}, b"ab": 256, b"bc": 257, b"abc": 258, b"bcd": 259})
    library = tiktoken.Encoding("small", pat_str=r".+", mergeable_ranks=vocab.ids, special_tokens={})
    for text in ("abc", "abcd", "bcd", "xbcd", "ababc", "bcbcd", "abcabc"):
        assert vocab.encode_piece(text.encode()) == library.encode_ordinary(text), text


def test_memory_of_chunks_is_bounded():
    made = []
    chunks = ChunkEncoder(lambda text: made.append(text) or text.encode(), most=10)
    for i in range(200):
        assert chunks(f"x w{i} always {'long' * 30}") == f"x w{i} always {'long' * 30}".encode()
    assert len(chunks._known) + len(chunks._known._old) <= 40
    assert made.count(" always") == 1 and made.count(" " + "long" * 30) == 200


def test_every_row_whole_and_back(spark, edge_docs, no_docs, reference):
    encoded = bpe.encode(edge_docs, PATH, public_tokenizers.PATTERN)
    got = sorted((r.doc_id is None, r.doc_id, list(r.ids), bytes(r.content)) for r in bpe.decode(encoded, PATH).collect())
    want = sorted((i is None, i, reference(t or ""), (t or "").encode()) for i, t, _ in edge_rows())
    assert [(g[1:]) for g in sorted(got, key=repr)] == [w[1:] for w in sorted(want, key=repr)]
    assert bpe.decode(bpe.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_query_digests(spark, reference):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in entry.queries()["op1_byte_bpe"](spark, folder).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = reference(text)
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
