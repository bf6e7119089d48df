"""Token ids of whole texts by a tokenizer file."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from functools import lru_cache

#: How a byte-level tokenizer without options of its own splits text; other kinds go through their library alone.
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Texts with this many blanks in a row at a place divisible by it are left to the tokenizers library: the other one looks
#: for the end of a run of blanks by going back, and a run of a million is too long for its stack.
_BLANKS = 256
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others for
    the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def _ranks(book: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if merging by rank is what this tokenizer does; else None."""
    model, split = book["model"], book.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(o) for o in options) or book.get("normalizer") or any(split.get(k) != v for k, v in _PLAIN.items()):
        return None
    vocabulary = model["vocab"]
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))):
        return None
    byte_of = {c: b for b, c in byte_characters().items()}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(made)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit integers, as the tokenizers library gives them by the file
    at `path` with add_special_tokens=False: the string of an added token in a text is that token.

    Where the file is plain byte-level BPE whose ids are ranks of merges, texts without such a string or long runs of blanks
    are encoded by the tiktoken library, which splits and merges alike at a quarter of the cost (the tests compare both).
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    with open(path, encoding="utf-8") as file:
        book = json.load(file)
    ranks = _ranks(book)
    if ranks is None:
        return whole
    added = [token["content"] for token in book.get("added_tokens", [])]
    plain = tiktoken.Encoding(os.path.basename(path), pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids_of(text: str) -> bytes:
        if any(token in text for token in added) or any(text[at:at + _BLANKS].isspace() for at in range(0, len(text), _BLANKS)):
            return whole(text)
        return array("I", plain.encode_ordinary(text)).tobytes()

    return ids_of
