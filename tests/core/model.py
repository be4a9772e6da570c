"""Filter semantics in plain Python, independent of the column compiler."""

from __future__ import annotations

import math
from fractions import Fraction

from metasieve.plans.dtypes import BIG, FLOATS, NUMERIC, SIGNED_BITS, DataType
from metasieve.plans.filters import And, Condition, MissingKeyPolicy, Not, NumberComparisonPolicy, Or


def sign(a, b):
    return (a > b) - (a < b)


def as_float(x):
    try:
        return float(x)
    except OverflowError:
        return None


def order(a, b, lossy):
    """-1, 0, 1 or None for two typed numbers."""
    fa, fb = a.tag in FLOATS, b.tag in FLOATS
    if fa and fb:
        return None if math.isnan(a.data) or math.isnan(b.data) else sign(a.data, b.data)
    if not fa and not fb:
        return sign(Fraction(a.data), Fraction(b.data))
    if fa:
        r = order(b, a, lossy)
        return None if r is None else -r
    x, y = a.data, b.data

    def policy():
        d = as_float(x)
        return sign(d, y) if lossy and d is not None and not math.isnan(y) else None

    if a.tag in BIG:
        return policy()
    low, high = (-(1 << 63), (1 << 63) - 1) if a.tag in SIGNED_BITS else (0, (1 << 64) - 1)
    if not low <= x <= high:
        return policy()
    if low == 0 and y < 0:
        return 1
    if math.isfinite(y) and y == int(y) and low <= int(y) <= high:
        return sign(x, int(y))
    if math.isnan(y):
        return None
    if abs(x) <= 1 << 53:
        return sign(float(x), y)
    return policy()


def same(a, b, lossy):
    if a.tag in NUMERIC and b.tag in NUMERIC:
        return order(a, b, lossy) == 0
    return a.tag == b.tag and a.data == b.data


def compared(a, b, lossy):
    if a.tag in NUMERIC and b.tag in NUMERIC:
        return order(a, b, lossy)
    if a.tag == b.tag == DataType.STRING:
        return sign(a.data.encode(), b.data.encode())
    return None


def matches(expr, record, options):
    if expr is None:
        return True
    lossy = options.number_comparison_policy == NumberComparisonPolicy.APPROXIMATE
    absent = options.missing_key_policy == MissingKeyPolicy.MATCH
    if isinstance(expr, Condition):
        v = record.get(expr.key)
        if expr.op == "exists":
            return v is not None
        if expr.op == "not_exists":
            return v is None
        if v is None:
            return expr.op in ("ne", "not_in") and absent
        if expr.op in ("eq", "in"):
            return any(same(v, x, lossy) for x in expr.values)
        if expr.op in ("ne", "not_in"):
            return not any(same(v, x, lossy) for x in expr.values)
        r = compared(v, expr.values[0], lossy)
        return {"lt": r == -1, "le": r in (-1, 0), "gt": r == 1, "ge": r in (0, 1)}[expr.op]
    if isinstance(expr, And):
        return all(matches(c, record, options) for c in expr.children)
    if isinstance(expr, Or):
        return any(matches(c, record, options) for c in expr.children)
    if isinstance(expr, Not):
        return not matches(expr.child, record, options)
    return False
