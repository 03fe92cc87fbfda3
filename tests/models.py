"""Small plain-Python models the operators are checked against."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

T0 = datetime(2026, 1, 1, tzinfo=UTC)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
TOL = {"exact": 0, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "approximate": 21600}


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def us(value: datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=UTC)
    return (value - EPOCH) // timedelta(microseconds=1)


def contradiction_pairs(claims):
    """claims: (id, subject, value, precision)"""
    out = set()
    for i in claims:
        for j in claims:
            if i[0] < j[0] and i[1] == j[1]:
                if abs(us(i[2]) - us(j[2])) > (TOL[i[3]] + TOL[j[3]]) * 1_000_000:
                    out.add((i[1], i[0], j[0]))
    return out


def gap_findings(claims, min_gap, min_n):
    """claims: (id, source, refinement or None, value, precision) -> findings by definition."""
    groups = {}
    for cid, source, ref, value, precision in claims:
        tol = TOL[precision] * 1_000_000
        key = (source, ref is not None, ref or "")
        groups.setdefault(key, []).append((us(value) - tol, us(value) + tol, cid))
    found = []
    for a, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[0], r[2]))
        for k in range(1, len(rows)):
            reach = max(r[1] for r in rows[:k])
            opener = next(r for r in rows[:k] if r[1] == reach)
            if reach >= rows[k][0] or (rows[k][0] - reach) / 1_000_000 < min_gap:
                continue
            for p, others in groups.items():
                if p == a or (p[0] == a[0] and not (p[1] and a[1])):
                    continue
                ids = sorted(o[2] for o in others if o[0] < rows[k][0] and o[1] > reach)
                if len(ids) >= min_n:
                    found.append((
                        a[0], p[0], a[2] if a[1] else None, p[2] if p[1] else None,
                        reach, rows[k][0], opener[2], rows[k][2], tuple(ids),
                    ))
    return found
