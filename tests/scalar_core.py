"""The index, one value at a time in plain Python: the tests' own yardstick."""

from __future__ import annotations

from aerolith.functions import standards as S


def iaqi(c, pollutant, standard="VN_1459"):
    if c is None or c != c or c < 0:
        return None
    for lo, hi, ilo, ihi in S.bands(pollutant, standard):
        if lo <= c <= hi:
            return (ihi - ilo) / (hi - lo) * (c - lo) + ilo
    return 500.0


def level(a):
    if a is None:
        return None
    return next((i for i, u in enumerate(S.LEVEL_UPPER, 1) if a <= u), 6)


def nowcast(h):
    if sum(x is not None for x in h[:3]) < 2:
        return None
    there = [x for x in h if x is not None]
    w = min(there) / max(there) if max(there) else 0.5
    w = max(w, 0.5)
    return sum(w**i * x for i, x in enumerate(h) if x is not None) / sum(w**i for i, x in enumerate(h) if x is not None)


def reduced(parts):
    known = {p: parts[p] for p in S.DOMINANT_ORDER if parts.get(p) is not None}
    if not known:
        return None, None, None
    top = max(known.values())
    return float(round(top)), level(top), next(p for p, v in known.items() if v == top)


def provider(c):
    worst = 1
    for p, limits in S.PROVIDER_THRESHOLDS.items():
        if c.get(p) is not None and c[p] >= 0:
            worst = max(worst, next((k for k, b in enumerate(limits, 1) if c[p] < b), 5))
    return worst
