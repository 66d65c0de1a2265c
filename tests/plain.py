"""Plain Python yardsticks."""

from functools import lru_cache

SETS = ["ހޙޚ", "ސޘޞ", "ށޝ", "ޒޛޟޡޜ", "ތޠ", "އޢ", "ގޣ", "ކޤ", "ވޥ", "ނޏޱ"]
PAIRS = {frozenset(p) for p in ("ަާ", "ިީ", "ުޫ", "ެޭ", "ޮޯ")}


def unit_cost(x, y):
    if x == y:
        return 0.0
    sound = 0.0 if x[0] == y[0] else 0.5 if any(x[0] in s and y[0] in s for s in SETS) else 1.0
    sign = 0.0 if x[1] == y[1] else 0.4 if frozenset((x[1], y[1])) in PAIRS or (x[1], y[1]) == ("ް", "_") else 0.7
    return min(sound + sign, 1.5)


def unit_distance(a, b, most=2.0):
    """From the recurrence, entry by entry; a row that is above the limit throughout ends it."""

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return float(i + j)
        best = min(d(i - 1, j) + 1.0, d(i, j - 1) + 1.0, d(i - 1, j - 1) + unit_cost(a[i - 1], b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
            best = min(best, d(i - 2, j - 2) + 0.8)
        return best

    if abs(len(a) - len(b)) > most or any(min(d(i, j) for j in range(len(b) + 1)) > most for i in range(1, len(a) + 1)):
        return most + 1.0
    return d(len(a), len(b))
