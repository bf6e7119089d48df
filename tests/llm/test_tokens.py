"""The encoder of packing against the tokenizers library with its own settings."""
from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from havenlens.llm import tokens
from llm.corpus_rows import edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids(text: str, path: str = PATH) -> list[int]:
    return np.frombuffer(tokens.encoder(path)(text), "<u4").tolist()


def test_added_tokens_are_tokens_wherever_they_stand(library):
    special = "<|endoftext|>"
    for text in (special, f"hello {special} world", f"a  {special}", f"a\n\n{special}\n {special}{special}x", f"  {special}  ", f"{special[:-1]} {special[1:]}"):
        assert ids(text) == library(text)
    assert ids(f"hello {special} world") == [31373, 220, 50256, 995]


def test_every_character_and_random_texts(library):
    chance = random.Random(5)
    for code in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)]:
        text = f"a{chr(code)}b {chr(code)} 1{chr(code)}{chr(code)} ."
        assert ids(text) == library(text), hex(code)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aeiounthsrl", "=-_#*.,!? \n\t'", "0123456789", "AaBbCcDdEeéàüñ ", "  \r\n x", "日本語 テキスト"]
    for _ in range(6000):
        text = "".join(chance.choices(chance.choice(kinds), k=chance.randint(1, 60)))
        assert ids(text) == library(text), text


def test_long_runs(library):
    for text in ("x" * 50_000, " " * 300_000, "\n" * 100_000 + "a", "word" + " " * 2000 + "word", " " * 255 + "x", " " * 511 + "x", ("a" + " " * 200) * 50, "12" * 20_000):
        assert ids(text) == library(text)
    for _, text, _ in edge_rows():
        assert ids(text or "") == library(text or "")


def test_a_file_with_options_goes_through_its_library(tmp_path):
    book = json.load(open(PATH, encoding="utf-8"))
    book["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    json.dump(book, open(path, "w", encoding="utf-8"))
    assert ids("hello", path) == Tokenizer.from_file(path).encode("hello", add_special_tokens=False).ids != ids("hello")
    assert tokens._ranks(json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))) is None
