"""Made-up texts and rows of odd kinds."""

from __future__ import annotations

import random

CLASHING = "row string, row_key string, hits string, spans string, fp string, ids string, size string, part string, words string"


def prose(seed: int, n: int) -> str:
    chance = random.Random(seed)
    words = ["".join(chance.choices(["the", "an", "on", "ti", "re", "ha", "wh", "ed"], k=chance.randint(1, 4))) for _ in range(n)]
    return ". ".join(" ".join(words[i:i + 9]) for i in range(0, n, 9)) + "."


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang): nulls in every column, empty and long texts, ties, repeated rows and ids, copies."""
    a, b = prose(1, 60), prose(2, 45)
    lines = "\n".join(prose(100 + i, 9) for i in range(6))
    rows = [(1, a, "en"), (2, a, "en"), (3, b, None), (3, b, None), (3, b + " more", "fr"), (4, "", "en"), (5, None, None), (None, None, None),
            (None, a, "de"), (None, "", None), (6, " \n\t ", "fr"), (7, "1234 ## 55", "en"), (8, prose(3, 30_000), "en"),
            (9, "x" * 50_000, "de"), (10, lines, "es"), (11, "intro\n" + lines + "\noutro", "es"), (12, lines, "es"), (13, "Été à Ünter ñ 😀 日本", "fr"),
            (14, "same line here\n" * 40, "en"), (15, "a", "en"), (16, "A B", "en"), (17, "a b", "en"), (18, "word " * 500, "en")]
    return rows + [(100 + i, prose(1000 + i, 25), ("en", "fr", "de", "es")[i % 4]) for i in range(40)]
