"""Longest common subsequences on token arrays by bit vectors.

A row of the dynamic-programming table is one integer: bit ``j`` is 0 where the
row grows at column ``j``. A step is a few operations on integers of
``len(columns)`` bits, so a pair costs ``n * m / 64`` word operations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from math import isqrt


def _masks(tokens: Sequence[str]) -> dict[str, int]:
    """Per token, the bits of its positions."""
    places: dict[str, list[int]] = {}
    for j, t in enumerate(tokens):
        places.setdefault(t, []).append(j)
    out = {}
    for t, at in places.items():
        bits = bytearray(at[-1] // 8 + 1)
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        out[t] = int.from_bytes(bits, "little")
    return out


def _rows(row: int, tokens: Iterable[str], masks: dict[str, int], full: int) -> Iterable[int]:
    for t in tokens:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence; memory ``len(b)`` bits a distinct token at most."""
    if len(b) == 0:
        return 0
    full = (1 << len(b)) - 1
    row = full
    for row in _rows(full, a, _masks(b), full):
        pass
    return len(b) - row.bit_count()


def lcs_positions(ref: Sequence[str], can: Sequence[str]) -> list[int]:
    """Positions in ``ref`` of the subsequence found walking back from the end:
    equal tokens are taken, else a column is skipped if that keeps more than
    skipping a row. Every ``sqrt(len(ref))``-th row is kept and the rows between
    are computed again, so memory is ``2 sqrt(len(ref)) * len(can)`` bits."""
    n, m = len(ref), len(can)
    if not n or not m:
        return []
    full, masks, step = (1 << m) - 1, _masks(can), isqrt(n) + 1
    kept = [full]
    for i, row in enumerate(_rows(full, ref, masks, full), 1):
        if i % step == 0:
            kept.append(row)
    block, rows = -1, []

    def row_at(i: int) -> int:
        nonlocal block, rows
        if i // step != block:
            block = i // step
            first = block * step
            rows = [kept[block], *_rows(kept[block], ref[first:first + step - 1], masks, full)]
        return rows[i % step]

    def value(i: int, j: int) -> int:
        return j - (row_at(i) & ((1 << j) - 1)).bit_count()

    out, i, j = [], n, m
    here = value(i, j)
    above = value(i - 1, j)
    while i and j and here:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i, j, here = i - 1, j - 1, here - 1
            above = value(i - 1, j) if i else 0
        elif above < here and (row_at(i) >> (j - 1)) & 1:    # the left cell holds as much, the upper one less
            j -= 1
            above -= not (row_at(i - 1) >> j) & 1
        else:
            i, here = i - 1, above
            above = value(i - 1, j) if i else 0
    return out[::-1]


def _f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_l_score(pred: Sequence[str], ref: Sequence[str]) -> float:
    """ROUGE-L F1 of two token lists; 0 if one is empty."""
    if len(pred) == 0 or len(ref) == 0:
        return 0.0
    lcs = lcs_length(ref, pred)
    return _f1(lcs / len(pred), lcs / len(ref))


def rouge_lsum_score(pred: Sequence[Sequence[str]], ref: Sequence[Sequence[str]]) -> float:
    """ROUGE-Lsum F1 of two lists of sentences: per reference sentence the union
    of its subsequences with every predicted sentence; a token counts at most as
    often as the prediction holds it."""
    pred, ref = [list(s) for s in pred if len(s)], [list(s) for s in ref if len(s)]
    n, m = sum(map(len, pred)), sum(map(len, ref))
    if not n or not m:
        return 0.0
    held = Counter(t for s in pred for t in s)
    found = Counter(s[i] for s in ref for i in set().union(*(lcs_positions(s, c) for c in pred)))
    hits = sum(min(k, held[t]) for t, k in found.items())
    return _f1(hits / n, hits / m)
