"""Exact pair merging of one long symbol sequence, with a heap: for what the array methods leave over."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def merged(symbols: list[int], rank_of: Callable[[int, int], tuple[float, int] | None]) -> list[int]:
    """Merge the adjacent pair of lowest rank, the leftmost of equals, until none can be merged.

    ``rank_of(left, right)`` gives the rank of a pair and the symbol that replaces it, or None.
    """
    n = len(symbols)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = []

    def offer(a: int, b: int) -> None:
        found = rank_of(symbols[a], symbols[b])
        if found is not None:
            heapq.heappush(heap, (found[0], a, b, symbols[a], symbols[b], found[1]))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, was_a, was_b, new = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or symbols[a] != was_a or symbols[b] != was_b:
            continue
        symbols[a], alive[b] = new, False
        right[a] = right[b]
        if right[b] < n:
            left[right[b]] = a
            offer(a, right[b])
        if left[a] >= 0:
            offer(left[a], a)
    return [s for s, on in zip(symbols, alive) if on]
