"""How indices beyond an axis of n cells fold back onto it."""

from __future__ import annotations

MODES = ("reflect", "mirror", "nearest", "wrap", "constant")


def fold(i: int, n: int, mode: str) -> int | None:
    """The cell that index i reads; None where a constant stands."""
    if 0 <= i < n:
        return i
    if mode == "reflect":  # d c b a | a b c d | d c b a
        m = i % (2 * n)
        return m if m < n else 2 * n - 1 - m
    if mode == "mirror":  # d c b | a b c d | c b a
        if n == 1:
            return 0
        m = i % (2 * n - 2)
        return m if m < n else 2 * n - 2 - m
    if mode == "nearest":
        return min(max(i, 0), n - 1)
    if mode == "wrap":
        return i % n
    if mode == "constant":
        return None
    raise ValueError(f"{mode} is none of {', '.join(MODES)}")


def ghosts(n: int, before: int, after: int, mode: str) -> dict[int, list[int]]:
    """For each cell, the indices outside the axis that read it."""
    out: dict[int, list[int]] = {}
    for e in [*range(-before, 0), *range(n, n + after)]:
        source = fold(e, n, mode)
        if source is not None:
            out.setdefault(source, []).append(e)
    return out


def fold_sql(i: str, n: int, mode: str) -> str:
    """The same as a SQL expression."""
    if mode == "reflect":
        m = f"((({i}) % {2 * n}) + {2 * n}) % {2 * n}"
        return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END)"
    if mode == "mirror":
        if n == 1:
            return "0"
        m = f"((({i}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
        return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END)"
    if mode == "nearest":
        return f"least(greatest({i}, 0), {n - 1})"
    if mode == "wrap":
        return f"((({i}) % {n}) + {n}) % {n}"
    return f"({i})"
