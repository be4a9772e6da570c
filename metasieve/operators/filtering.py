"""From a filter to one boolean column that is never null.

Every predicate is total: over flat columns it is ``c IS NOT NULL AND ...``,
which Catalyst can negate and push down to the scan; ``NOT`` is then plain
negation. Over a bag, a CASE on the type tag picks the comparison.
"""

from __future__ import annotations

from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bag
from ..functions.numbers import Truth, all_of, any_equal, any_of, balanced, compare, numbers
from ..plans.dtypes import FLOATS, NUMERIC, DataType
from ..plans.filters import RANGES, And, Condition, Expr, FilterMatchOptions, MetadataFilter, MissingKeyPolicy, Not, NumberComparisonPolicy, Or
from ..plans.values import Value
from .layouts import Bag, Flat, Layout


def _column(t: Truth) -> Column:
    return F.lit(t) if isinstance(t, bool) else t


def _flat_holds(op: str, layout: Flat, key: str, v: Value, lossy: bool) -> Truth:
    """Whether a present value of a flat column compares with ``v``, and so."""
    tag = layout.tag(key)
    if tag in NUMERIC:
        return numbers(op, layout.operand(key), v, lossy) if v.tag in NUMERIC else False
    if tag != v.tag or (op in RANGES and tag != DataType.STRING):
        return False
    col = layout.column(key)
    if tag == DataType.STRING_MAP:
        return bag.string_map_entries(col) == bag.literal(v)
    return compare(col, op, bag.literal(v))


def _flat_in(layout: Flat, key: str, values: tuple[Value, ...], lossy: bool) -> Truth:
    """Equality with one of ``values``, in one IN for all that the column's type holds."""
    tag, col = layout.tag(key), layout.column(key)
    if tag in NUMERIC:
        return any_equal(layout.operand(key), [v for v in values if v.tag in NUMERIC], lossy)
    if tag == DataType.STRING_MAP:
        col = bag.string_map_entries(col)
    return _lane_in(col, [v for v in values if v.tag == tag])


def _lane_in(lane: Column, values: list[Value]) -> Truth:
    """Equality of a lane that holds no number with one of the values of its type."""
    plain = [v.data if v.tag in _TEXTS else bag.literal(v) for v in dict.fromkeys(values)]
    return lane.isin(plain) if plain else False


_TEXTS = (DataType.STRING, DataType.CHAR, DataType.URL, DataType.JSON)


#: Tags by the lane and comparison that they share; numbers first.
_CLASSES: dict[str, list[DataType]] = {}
for _t in sorted(NUMERIC, key=lambda t: t.value):
    _rank = "128" if _t in (DataType.INT128, DataType.UINT128) else ""
    _CLASSES.setdefault(bag.lane_of(_t) + (_t.value if _rank else ""), []).append(_t)


def _bag_holds(op: str, e: Column, v: Value, lossy: bool) -> Truth:
    """Whether a bag's entry compares with ``v``, and so; null for other tags."""
    if v.tag not in NUMERIC:
        if op in RANGES and v.tag != DataType.STRING:
            return False
        return (e["t"] == v.tag.value) & compare(e[bag.lane_of(v.tag)], op, bag.literal(v))
    found: list[Truth] = []
    for tags in _CLASSES.values():
        truth = numbers(op, bag.operand(e, tags[0]), v, lossy)
        if truth is not False:
            found.append(all_of(e["t"].isin([t.value for t in tags]), truth))
    return any_of(*found)


def _bag_in(e: Column, values: tuple[Value, ...], lossy: bool) -> Truth:
    """Equality of a bag's entry with one of ``values``: an IN for each lane, and for floats one for each class of numbers."""
    found: list[Truth] = []
    exact, floats = [v for v in values if v.tag in NUMERIC - FLOATS], [v for v in values if v.tag in FLOATS]
    for tags in _CLASSES.values():
        # by the lane alone if the values are exact and no policy matters: text lanes of all widths are one
        together = [t for t in NUMERIC - FLOATS if bag.lane_of(t) == bag.lane_of(tags[0])]
        if exact and (tags[0] in FLOATS or tags[0] == min(together, key=lambda t: t.value)):
            found.append(all_of(any_equal(bag.operand(e, tags[0]), exact, lossy), e["t"].isin([t.value for t in together or tags])))
        if floats:
            found.append(all_of(any_equal(bag.operand(e, tags[0]), floats, lossy), e["t"].isin([t.value for t in tags])))
    for tag in dict.fromkeys(v.tag for v in values if v.tag not in NUMERIC):
        found.append(all_of(_lane_in(e[bag.lane_of(tag)], [v for v in values if v.tag == tag]), e["t"] == tag.value))
    return any_of(*found)


def _condition(c: Condition, layout: Layout, options: FilterMatchOptions) -> Column:
    lossy = options.number_comparison_policy == NumberComparisonPolicy.APPROXIMATE
    present = layout.present(c.key)
    if c.op == "exists":
        return present
    if c.op == "not_exists":
        return ~present
    known = not (isinstance(layout, Flat) and layout.tag(c.key) is None)
    op = "eq" if c.op in ("eq", "ne", "in", "not_in") else c.op
    if not known:
        truth: Truth = False
    elif isinstance(layout, Flat):
        truth = _flat_in(layout, c.key, c.values, lossy) if len(c.values) > 1 else any_of(*[_flat_holds(op, layout, c.key, v, lossy) for v in c.values])
    else:
        # the entry is looked up once; lanes of other types, and absent entries, are null: no comparison with them holds
        found = F.transform(F.array(layout.entry(c.key)), lambda e: _column(_bag_holds(op, e, c.values[0], lossy) if len(c.values) == 1 else _bag_in(e, c.values, lossy)))
        truth = F.coalesce(F.element_at(found, 1), F.lit(False))
    if c.op not in ("ne", "not_in"):
        return _column(truth if isinstance(layout, Bag) else all_of(present, truth))
    other = _column(truth) if isinstance(truth, bool) else truth
    if options.missing_key_policy == MissingKeyPolicy.MATCH:
        return ~present | ~other
    return present & ~other


def expr_column(e: Expr | None, layout: Layout, options: FilterMatchOptions) -> Column:
    """A tree as a column; None matches all."""
    if e is None:
        return F.lit(True)
    if isinstance(e, Condition):
        return _condition(e, layout, options)
    if isinstance(e, And):
        return balanced(and_, [expr_column(c, layout, options) for c in e.children])
    if isinstance(e, Or):
        return balanced(or_, [expr_column(c, layout, options) for c in e.children])
    if isinstance(e, Not):
        return ~expr_column(e.child, layout, options)
    return F.lit(False)


def filter_column(f: MetadataFilter, layout: Layout, options: FilterMatchOptions | None = None) -> Column:
    """A filter as a column, with its own options or those given."""
    return expr_column(f.expr, layout, options or f.options)


def apply_filter(df: DataFrame, f: MetadataFilter, layout: Layout | None = None, options: FilterMatchOptions | None = None) -> DataFrame:
    """The rows of ``df``, batch or streaming, that match; by default its columns are the keys."""
    return df.filter(filter_column(f, layout or Flat.of(df), options))


__all__ = ["Bag", "Flat", "apply_filter", "expr_column", "filter_column"]
