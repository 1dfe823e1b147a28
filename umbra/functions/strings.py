"""Likeness of two strings, for UDFs."""

from __future__ import annotations


def jaro_winkler(a: str | None, b: str | None, weight: float = 0.1, boost: float = 0.7) -> float | None:
    """Jaro similarity, raised for a common prefix of up to four letters where it is above `boost`; null with a null."""
    if a is None or b is None:
        return None
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, own = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                own.append(x)
                break
    m = len(own)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(own, [y for y, u in zip(b, used, strict=True) if u], strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return jaro + prefix * weight * (1 - jaro) if jaro > boost else jaro


def edits(a: str | None, b: str | None) -> int | None:
    """Damerau-Levenshtein: insertions, deletions, replacements and swaps of neighbours; null with a null."""
    if a is None or b is None:
        return None
    far = len(a) + len(b)
    cost = {(-1, -1): far}
    for i in range(len(a) + 1):
        cost[i, -1], cost[i, 0] = far, i
    for j in range(len(b) + 1):
        cost[-1, j], cost[0, j] = far, j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, p = seen.get(b[j - 1], 0), last
            same = a[i - 1] == b[j - 1]
            if same:
                last = j
            cost[i, j] = min(cost[i - 1, j - 1] + (not same), cost[i, j - 1] + 1, cost[i - 1, j] + 1, cost[k - 1, p - 1] + (i - k - 1) + 1 + (j - p - 1))
        seen[a[i - 1]] = i
    return cost[len(a), len(b)]
