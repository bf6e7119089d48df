"""First-match rule cascades and text templates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """Value of the first rule whose condition holds; a null condition does not hold."""
    condition, value = rules[0]
    chain = F.when(condition, value)
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def fill(template: str, values: Mapping[str, Column | str]) -> Column:
    """Template text with `{name}` slots replaced by columns or plain strings."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            value = values[piece[1:-1]]
            parts.append(F.lit(value) if isinstance(value, str) else value)
        elif piece:
            parts.append(F.lit(piece))
    return parts[0] if len(parts) == 1 else F.concat(*parts)
