"""Filter trees, filters and their builder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from .errors import InvalidFilterExpression
from .values import Value, value_of


class MissingKeyPolicy(Enum):
    """Whether ``ne`` and ``not_in`` match a record without the key."""

    MATCH = "Match"
    NO_MATCH = "NoMatch"


class NumberComparisonPolicy(Enum):
    """Whether numbers that cannot be compared exactly are incomparable, or compared as doubles."""

    CONSERVATIVE = "Conservative"
    APPROXIMATE = "Approximate"


@dataclass(frozen=True)
class FilterMatchOptions:
    missing_key_policy: MissingKeyPolicy = MissingKeyPolicy.MATCH
    number_comparison_policy: NumberComparisonPolicy = NumberComparisonPolicy.CONSERVATIVE


#: Names of the predicates that take one value, a list of values, and none.
ONE, MANY, NONE = ("eq", "ne", "lt", "le", "gt", "ge"), ("in", "not_in"), ("exists", "not_exists")
RANGES = ("lt", "le", "gt", "ge")


@dataclass(frozen=True)
class Condition:
    """One predicate on one key."""

    op: str
    key: str
    values: tuple[Value, ...] = ()


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: Any


@dataclass(frozen=True)
class Never:
    """Matches nothing."""


Expr = Condition | And | Or | Not | Never


def _group(kind: type, left: Expr, right: Expr) -> Expr:
    """Both sides under one ``kind``, whose own groups are merged into it."""
    parts = [c for side in (left, right) for c in (side.children if isinstance(side, kind) else (side,))]
    return kind(tuple(parts))


def both(left: Expr | None, right: Expr | None) -> Expr | None:
    """AND of trees; None, which matches all, gives way, and nothing stays nothing."""
    if left is None or right is None:
        return right if left is None else left
    return Never() if Never() in (left, right) else _group(And, left, right)


def either(left: Expr | None, right: Expr | None) -> Expr | None:
    """OR of trees; both None and nothing give way to the other side, also the one that matches all."""
    if left is None or right is None:
        return right if left is None else left
    if Never() in (left, right):
        return right if left == Never() else left
    return _group(Or, left, right)


def negated(expr: Expr | None) -> Expr | None:
    if expr is None:
        return Never()
    if expr == Never():
        return None
    return expr.child if isinstance(expr, Not) else Not(expr)


def conditions(expr: Expr | None) -> Iterator[Condition]:
    """Predicates of a tree, from left to right."""
    if isinstance(expr, Condition):
        yield expr
    elif isinstance(expr, And | Or):
        for c in expr.children:
            yield from conditions(c)
    elif isinstance(expr, Not):
        yield from conditions(expr.child)


@dataclass(frozen=True)
class MetadataFilter:
    """A tree (None: matches all) and how to compare."""

    expr: Expr | None = None
    options: FilterMatchOptions = field(default_factory=FilterMatchOptions)

    @staticmethod
    def builder() -> MetadataFilterBuilder:
        return MetadataFilterBuilder()

    @classmethod
    def all(cls) -> MetadataFilter:
        return cls()

    @classmethod
    def none(cls) -> MetadataFilter:
        return cls(Never())

    def with_options(self, options: FilterMatchOptions) -> MetadataFilter:
        return replace(self, options=options)

    def with_missing_key_policy(self, policy: MissingKeyPolicy) -> MetadataFilter:
        return replace(self, options=replace(self.options, missing_key_policy=policy))

    def with_number_comparison_policy(self, policy: NumberComparisonPolicy) -> MetadataFilter:
        return replace(self, options=replace(self.options, number_comparison_policy=policy))

    def not_(self) -> MetadataFilter:
        return replace(self, expr=negated(self.expr))

    __invert__ = not_

    def conditions(self) -> Iterator[Condition]:
        return conditions(self.expr)

    def matches(self, layout, options: FilterMatchOptions | None = None):
        """A boolean column, never null, over a layout of :mod:`metasieve.operators.layouts`."""
        from ..operators.filtering import filter_column

        return filter_column(self, layout, options)

    def to_json(self) -> str:
        from .wire import filter_to_json

        return filter_to_json(self)

    @staticmethod
    def from_json(text: str) -> MetadataFilter:
        from .wire import filter_from_json

        return filter_from_json(text)


class MetadataFilterBuilder:
    """Builds a tree from left to right: there is no precedence of AND over OR.

    A predicate's plain name and ``and_`` append with AND, ``or_`` with OR; the
    first one's connector does not matter. Every method returns the builder.
    """

    def __init__(self):
        self._expr: Expr | None = None
        self._options = FilterMatchOptions()
        self._error: InvalidFilterExpression | None = None
        self._touched = False

    def build(self) -> MetadataFilter:
        if self._error:
            raise self._error
        return MetadataFilter(self._expr, self._options)

    def build_checked(self, schema) -> MetadataFilter:
        """:meth:`build`, then the schema's check."""
        built = self.build()
        schema.validate_filter(built)
        return built

    def with_options(self, options: FilterMatchOptions) -> MetadataFilterBuilder:
        self._options = options
        return self

    def missing_key_policy(self, policy: MissingKeyPolicy) -> MetadataFilterBuilder:
        return self.with_options(replace(self._options, missing_key_policy=policy))

    def number_comparison_policy(self, policy: NumberComparisonPolicy) -> MetadataFilterBuilder:
        return self.with_options(replace(self._options, number_comparison_policy=policy))

    def _append(self, join: Callable, condition: Condition) -> MetadataFilterBuilder:
        self._expr, self._touched = join(self._expr, condition), True
        return self

    def _append_group(self, join: Callable, name: str, make: Callable, negate: bool) -> MetadataFilterBuilder:
        inner = make(MetadataFilterBuilder())
        error = inner._error
        if error is None and not inner._touched:
            error = InvalidFilterExpression(f"empty '{name}' filter group is not allowed")
        if error is not None:
            self._error = self._error or error
            return self
        expr = inner._expr
        if negate and expr is not None:  # a group that has come to match all is not negated: it gives way
            expr = negated(expr)
        self._expr, self._touched = join(self._expr, expr), True
        return self

    def and_(self, make: Callable) -> MetadataFilterBuilder:
        return self._append_group(both, "and", make, False)

    def or_(self, make: Callable) -> MetadataFilterBuilder:
        return self._append_group(either, "or", make, False)

    def and_not(self, make: Callable) -> MetadataFilterBuilder:
        return self._append_group(both, "and_not", make, True)

    def or_not(self, make: Callable) -> MetadataFilterBuilder:
        return self._append_group(either, "or_not", make, True)

    def not_(self) -> MetadataFilterBuilder:
        """Negates all that has been built so far."""
        self._expr = negated(self._expr)
        return self


def _predicate(op: str, join: Callable):
    if op in ONE:
        def method(self, key: str, value: Any) -> MetadataFilterBuilder:
            return self._append(join, Condition(op, key, (value_of(value),)))
    elif op in MANY:
        def method(self, key: str, values: Iterable[Any]) -> MetadataFilterBuilder:
            return self._append(join, Condition(op, key, tuple(value_of(v) for v in values)))
    else:
        def method(self, key: str) -> MetadataFilterBuilder:
            return self._append(join, Condition(op, key))
    method.__doc__ = f"Appends ``{op}`` with {'AND' if join is both else 'OR'}."
    return method


for _op in (*ONE, *MANY, *NONE):
    _name = {"in": "in_set", "not_in": "not_in_set"}.get(_op, _op)
    for _prefix, _join in (("", both), ("and_", both), ("or_", either)):
        setattr(MetadataFilterBuilder, _prefix + _name, _predicate(_op, _join))
