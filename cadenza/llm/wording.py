"""Word-level comparison for verifying candidates: bit-parallel longest common subsequences."""

from __future__ import annotations

import re

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence, one big-integer step for each item of b (Hyyrö 2004)."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        if m := where.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
