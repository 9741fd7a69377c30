"""Exact byte budgets over rendered output (M1)."""

from __future__ import annotations

import json
from collections.abc import Callable


class TooSmall(ValueError):
    """No projection fits; ``least`` is a budget that would do."""

    def __init__(self, least: int):
        super().__init__(f"the least output has {least} bytes")
        self.least = least


def settle(render: Callable[[int], str], rounds: int = 20) -> str:
    """Output that states its own size: rendered again until the stated size is the size."""
    used = 0
    for _ in range(rounds):
        text = render(used)
        size = len(text.encode())
        if size == used:
            return text
        used = size
    raise RuntimeError("the output's size does not settle")


def largest_prefix(n: int, render: Callable[[int], str], budget: int, monotone: bool = True) -> tuple[int, str]:
    """The longest prefix of n items whose rendering fits, the whole being tried first.

    Where more items never make the output smaller, prefixes are searched by halves; else
    from the longest down.
    """
    whole = render(n)
    if len(whole.encode()) <= budget:
        return n, whole
    least = render(0)
    if len(least.encode()) > budget:
        raise TooSmall(len(least.encode()))
    if not monotone:
        for k in range(n - 1, 0, -1):
            text = render(k)
            if len(text.encode()) <= budget:
                return k, text
        return 0, least
    lo, hi, best = 0, n, least
    while hi - lo > 1:
        mid = (lo + hi) // 2
        text = render(mid)
        if len(text.encode()) <= budget:
            lo, best = mid, text
        else:
            hi = mid
    return lo, best


def bundle_json(units: list[dict], budget: int | None = None) -> str:
    """Units as one JSON document that states its size, the longest prefix that fits (K1)."""

    def render(k: int) -> str:
        body = {"schema": 2, "omitted": len(units) - k, "units": units[:k]}
        return settle(lambda used: json.dumps(body | {"used": used}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return render(len(units)) if budget is None else largest_prefix(len(units), render, budget)[1]
