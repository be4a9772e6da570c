"""Exact comparison of number columns with number literals of any type.

All is decided when the column is made: an integer or decimal column meets a
literal moved to the nearest value that the column can hold, so that the
comparison stays one that Parquet can push down. Only 64-bit integers against
doubles, and what the policy governs, need more.

A result is True or False, or a column that is null only where its operand is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dtypes import BIG, FLOATS, SIGNED_BITS, DataType
from ..plans.values import Value
from .wide import literal_key, wide_key

#: Integers up to here are exact as doubles.
EXACT = 1 << 53
Truth = Column | bool


@dataclass(frozen=True)
class Operand:
    """A number column: its tag, and how it is held.

    ``form`` is ``int`` (an integral Spark type with ``low`` and ``high`` as its
    bounds), ``decimal`` (with ``scale``), ``float``, ``double`` or ``wide``
    (decimal text).
    """

    col: Column
    tag: DataType
    form: str
    low: int = 0
    high: int = 0
    scale: int = 0


def balanced(join: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """One or more columns under a tree of ``join`` whose depth is the logarithm of their number."""
    while len(parts) > 1:
        parts = [reduce(join, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def all_of(*parts: Truth) -> Truth:
    kept = [p for p in parts if p is not True]
    if any(p is False for p in kept):
        return False
    return balanced(and_, kept) if kept else True


def any_of(*parts: Truth) -> Truth:
    kept = [p for p in parts if p is not False]
    if any(p is True for p in kept):
        return True
    return balanced(or_, kept) if kept else False


def none_of(part: Truth) -> Truth:
    return (not part) if isinstance(part, bool) else ~part


def compare(col: Column, op: str, literal) -> Column:
    if op == "eq":
        return col == literal
    return {"lt": col < literal, "le": col <= literal, "gt": col > literal, "ge": col >= literal}[op]


def holds(op: str, left, right) -> bool:
    return {"eq": left == right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[op]


def _on_grid(op: str, q: Fraction, low: int, high: int) -> tuple[str, int] | bool:
    """A comparison of integers in [low, high] with ``q``, as one with an integer in that range."""
    n = math.floor(q)
    if op == "eq":
        return (op, n) if q == n and low <= n <= high else False
    if q != n:
        op = {"lt": "le", "ge": "gt"}.get(op, op)
    if n < low:
        return op in ("gt", "ge")
    if n > high:
        return op in ("lt", "le")
    if n == low and op in ("lt", "ge"):
        return op == "ge"
    if n == high and op in ("le", "gt"):
        return op == "le"
    return op, n


def exact(op: str, x: Operand, q: Fraction) -> Truth:
    """An integer or decimal operand against an exact number."""
    if x.form == "wide":
        key = literal_key(q)
        return compare(wide_key(x.col), op, F.lit(key))
    if x.form == "int":
        got = _on_grid(op, q, x.low, x.high)
        return got if isinstance(got, bool) else compare(x.col, got[0], F.lit(got[1]))
    got = _on_grid(op, q * 10**x.scale, x.low, x.high)
    if isinstance(got, bool):
        return got
    with localcontext(prec=60):
        literal = Decimal(got[1]).scaleb(-x.scale)
    return compare(x.col, got[0], F.lit(literal).cast(f"decimal(38,{x.scale})"))


def as_double(x: Operand) -> Column:
    return x.col.cast("double")


def _lossy(op: str, x: Operand, y: float) -> Truth:
    """Both sides as doubles; a wide number beyond their range does not compare."""
    if x.tag in FLOATS:
        return _floats(op, x, y)
    if math.isnan(y):
        return False
    d = as_double(x)
    if x.form == "wide":
        return (F.abs(d) != math.inf) & compare(d, op, F.lit(y))
    return compare(d, op, F.lit(y))


def _floats(op: str, x: Operand, y: float) -> Truth:
    """IEEE comparison: nothing compares with NaN."""
    if math.isnan(y):
        return False
    if x.form == "float" and (math.isinf(y) or (abs(y) < 3e38 and float(np.float32(y)) == y)):
        return ~F.isnan(x.col) & compare(x.col, op, F.lit(y).cast("float"))
    return ~F.isnan(x.col) & compare(x.col.cast("double") if x.form == "float" else x.col, op, F.lit(y))


def _within(x: Operand, low: int, high: int) -> Truth:
    return all_of(exact("ge", x, Fraction(low)), exact("le", x, Fraction(high)))


def _bounds64(tag: DataType) -> tuple[int, int]:
    return (-(1 << 63), (1 << 63) - 1) if tag in SIGNED_BITS else (0, (1 << 64) - 1)


def _int_with_float(op: str, x: Operand, y: float, lossy: bool) -> Truth:
    """An integer column with a double literal."""
    if math.isnan(y):
        return False
    low, high = _bounds64(x.tag)
    fits = _within(x, low, high)
    whole = math.isfinite(y) and y == math.floor(y) and low <= int(y) <= high
    if low == 0 and y < 0:
        inside: Truth = op in ("gt", "ge")
    elif whole:
        inside = exact(op, x, Fraction(y))
    else:
        side = holds(op, 0, y) if math.isinf(y) else exact(op, x, Fraction(y))
        small = all_of(_within(x, -EXACT, EXACT), side)
        inside = any_of(small, all_of(none_of(_within(x, -EXACT, EXACT)), _lossy(op, x, y))) if lossy else small
    beyond = all_of(none_of(fits), _lossy(op, x, y)) if lossy else False
    return any_of(all_of(fits, inside), beyond)


def _float_with_int(op: str, x: Operand, v: Value, lossy: bool) -> Truth:
    """A double column with an integer literal."""
    n = v.data
    low, high = _bounds64(v.tag)
    if not low <= n <= high:
        return _lossy(op, x, _to_double(n)) if lossy else False
    if abs(n) <= EXACT:
        return _floats(op, x, float(n))
    d = as_double(x)
    whole = ~F.isnan(x.col) & (d == F.rint(d)) & (d >= F.lit(float(low))) & (d < F.lit(float(high + 1)))
    same = whole & _double_with_exact(d, op, n)
    below = ~F.isnan(x.col) & (d < 0) if low == 0 else False
    if low == 0 and op not in ("lt", "le"):
        below = False
    rest = all_of(~F.isnan(x.col), ~(whole if low else whole | (d < 0)), _floats(op, x, float(n))) if lossy else False
    return any_of(same, below, rest)


def _double_with_exact(d: Column, op: str, n: int) -> Truth:
    """Doubles against an integer that may lie between two of them."""
    y = float(n)
    if int(y) == n:
        return compare(d, op, F.lit(y))
    if op == "eq":
        return F.lit(False)
    # y is the double next to n: what is below n is up to y, or below it
    return compare(d, ("le" if int(y) < n else "lt") if op in ("lt", "le") else ("gt" if int(y) < n else "ge"), F.lit(y))


def _to_double(x) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.nan


def numbers(op: str, x: Operand, v: Value, lossy: bool) -> Truth:
    """Whether the operand compares with the literal, and so; incomparable is False."""
    left_float, right_float = x.tag in FLOATS, v.tag in FLOATS
    if left_float and right_float:
        return _floats(op, x, v.data)
    if not left_float and not right_float:
        return exact(op, x, Fraction(v.data))
    if x.tag in BIG or v.tag in BIG:
        return _lossy(op, x, _to_double(v.data)) if lossy else False
    if right_float:
        return _int_with_float(op, x, v.data, lossy)
    return _float_with_int(op, x, v, lossy)


def any_equal(x: Operand, values: list[Value], lossy: bool) -> Truth:
    """Whether the operand equals one of the literals: one IN for all that its type can hold exactly.

    Where the policy allows it, a second IN has what is compared as doubles.
    Only integers with whole doubles beyond 64 bits, and doubles with integers
    that lie between two of them, are compared one by one.
    """
    exactly: dict[Fraction, None] = {}
    doubles: dict[float, None] = {}
    rest: list[Truth] = []
    for v in values:
        y = v.data
        if x.tag in FLOATS:
            if v.tag in FLOATS:
                doubles[y] = None
            elif v.tag in BIG or not _bounds64(v.tag)[0] <= y <= _bounds64(v.tag)[1]:
                if lossy:
                    doubles[_to_double(y)] = None
            elif int(float(y)) == y:
                doubles[float(y)] = None
            elif lossy:
                rest.append(numbers("eq", x, v, lossy))
        elif v.tag not in FLOATS:
            exactly[Fraction(y)] = None
        elif x.tag in BIG:
            if lossy and math.isfinite(y):
                doubles[y] = None
        elif math.isfinite(y) and y == math.floor(y):
            low, high = _bounds64(x.tag)
            if low <= int(y) <= high:
                exactly[Fraction(y)] = None
            elif lossy:
                rest.append(numbers("eq", x, v, lossy))
    return any_of(_in_exact(x, list(exactly)), _in_doubles(x, [y for y in doubles if not math.isnan(y)]), *rest)


def _in_exact(x: Operand, wanted: list[Fraction]) -> Truth:
    if x.form == "wide":
        keys = [k for k in map(literal_key, wanted) if k is not None]
        return wide_key(x.col).isin(keys) if keys else False
    scale = x.scale if x.form == "decimal" else 0
    units = [int(q) for q in (q * 10**scale for q in wanted) if q.denominator == 1 and x.low <= q <= x.high]
    if not units:
        return False
    if x.form == "int":
        return x.col.isin(units)
    with localcontext(prec=60):  # of the column's scale, so that the column need not be cast
        return x.col.isin([Decimal(n).scaleb(-scale) for n in units])


def _in_doubles(x: Operand, wanted: list[float]) -> Truth:
    if x.form == "float":
        wanted = [y for y in wanted if math.isinf(y) or (abs(y) < 3.5e38 and float(np.float32(y)) == y)]
    if 0.0 in wanted:  # a set has two zeros
        wanted = [y for y in wanted if y] + [0.0, -0.0]
    if not wanted:
        return False
    if x.form == "float":
        return x.col.isin([F.lit(y).cast("float") for y in wanted])
    return (x.col if x.tag in FLOATS else as_double(x)).isin(wanted)
