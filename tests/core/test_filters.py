"""Builder, wire form, schemas and errors: no Spark job is needed."""

import json
import math
import random
from decimal import Decimal

import pytest

from metasieve import (
    Condition, DataType, FilterMatchOptions, InvalidFilterExpression, InvalidFilterOperator, MetadataFilter, MetadataSchema,
    MissingKey, MissingKeyPolicy, MissingRequiredField, NumberComparisonPolicy, TypeMismatch, UnknownField, UnknownFieldPolicy,
    UnknownFilterField, Value, json_value, register_literal, typed, value_of,
)
from metasieve.plans.filters import And, Never, Not, Or
from metasieve.plans.wire import WireError, condition_from_wire, condition_to_wire, schema_from_json, schema_to_json

from .model import matches

B = MetadataFilter.builder
D = DataType


def eq(key, x):
    return Condition("eq", key, (value_of(x),))


def test_left_fold():
    assert B().eq("a", 1).or_eq("b", 2).and_eq("c", 3).build().expr == And((Or((eq("a", 1), eq("b", 2))), eq("c", 3)))
    assert B().or_eq("a", 1).build().expr == eq("a", 1)


def test_groups_merge_on_both_sides():
    f = B().and_(lambda g: g.eq("a", 1).eq("b", 2)).and_(lambda g: g.eq("c", 3).eq("d", 4)).build()
    assert len(f.expr.children) == 4


def test_negation():
    assert B().not_().build().expr == Never()
    assert B().not_().not_().build().expr is None
    assert (~~MetadataFilter(eq("a", 1))).expr == eq("a", 1)
    assert B().not_().or_eq("a", 1).build().expr == eq("a", 1)
    assert B().not_().and_eq("a", 1).build().expr == Never()
    assert B().eq("a", 1).or_not(lambda g: g.not_().and_eq("b", 2)).build().expr == eq("a", 1)


@pytest.mark.parametrize("method, name", [("and_", "and"), ("or_", "or"), ("and_not", "and_not"), ("or_not", "or_not")])
def test_empty_groups(method, name):
    for make in (lambda g: g, lambda g: g.not_()):
        b = B().eq("a", 1)
        getattr(b, method)(make)
        with pytest.raises(InvalidFilterExpression, match=f"empty '{name}' filter group is not allowed"):
            b.eq("b", 2).build()


def test_first_error_and_inner_error_win():
    with pytest.raises(InvalidFilterExpression, match="'or_not'"):
        B().and_(lambda g: g.eq("a", 1).or_not(lambda h: h)).or_(lambda g: g).build()


def test_group_options_do_not_leave_the_group():
    f = B().and_(lambda g: g.eq("a", 1).missing_key_policy(MissingKeyPolicy.NO_MATCH)).build()
    assert f.options == FilterMatchOptions()


def test_wire_golden():
    f = B().eq("lang", "cy").and_ge("n_chars", 250).or_not(lambda g: g.exists("source").and_eq("source", "crawl-7")).build()
    wire = json.loads(f.to_json())
    assert wire["version"] == 1
    assert wire["options"] == {"missing_key_policy": "Match", "number_comparison_policy": "Conservative"}
    first, second = wire["expr"]["children"]
    assert first["children"][0] == {"type": "condition", "condition": {"op": "eq", "key": "lang", "value": {"String": "cy"}}}
    assert first["children"][1]["condition"]["value"] == {"Int64": 250}
    assert second["type"] == "not" and second["expr"]["children"][0]["condition"] == {"op": "exists", "key": "source"}
    assert MetadataFilter.from_json(f.to_json()) == f
    assert json.loads(MetadataFilter.none().to_json())["expr"] == {"type": "false"}
    assert "expr" not in json.loads(MetadataFilter.all().to_json())


def test_wire_keeps_trees_as_they_are():
    for expr in (Not(Never()), And((Never(), eq("a", 1))), Or((eq("a", 1),)), Not(Not(eq("a", 1)))):
        assert MetadataFilter.from_json(MetadataFilter(expr).to_json()).expr == expr


@pytest.mark.parametrize("text, message", [
    ('{"version":2}', "unsupported MetadataFilter wire format version 2; expected 1"),
    ('{"version":2,"expr":{"type":"and","children":[]}}', "version 2"),
    ('{"expr":{"type":"and","children":[]}}', "empty 'and' filter group is not allowed"),
    ('{"expr":{"type":"or","children":[]}}', "empty 'or' filter group is not allowed"),
    ('{"surplus":1}', "unknown field"),
    ('{"options":{"missing_key_policy":"Match"}}', "missing field"),
    ('{"expr":{"And":[]}}', "missing field"),
    ('{"expr":{"type":"condition","condition":{"op":"eq","key":"a","value":{"Int64":1},"more":2}}}', "unknown field"),
    ('{"expr":{"type":"condition","condition":{"op":"like","key":"a"}}}', "unknown variant"),
    ('{"expr":{"type":"condition","condition":{"op":"eq","key":"a","value":{"Int8":300}}}}', "out of range"),
    ("nonsense", "Expecting value"),
])
def test_wire_errors(text, message):
    with pytest.raises(WireError, match=message):
        MetadataFilter.from_json(text)


def test_condition_tags_round_trip():
    values = [Value(D.UINT128, 1 << 100), Value(D.BIG_DECIMAL, Decimal("1.50")), typed(D.DURATION, 5), json_value({"b": 1.0, "a": [1]}), Value(D.STRING_MAP, {"a": "b"})]
    for op in ("eq", "ne", "lt", "le", "gt", "ge"):
        for v in values:
            c = Condition(op, "k", (v,))
            assert condition_from_wire(condition_to_wire(c)) == c
    for op in ("in", "not_in"):
        assert condition_from_wire(condition_to_wire(Condition(op, "k", tuple(values)))) == Condition(op, "k", tuple(values))
    for op in ("exists", "not_exists"):
        assert condition_to_wire(Condition(op, "k")) == {"op": op, "key": "k"}


@pytest.mark.parametrize("x", [math.inf, -math.inf, math.nan])
def test_json_has_no_such_number(x):
    for tag in (D.FLOAT32, D.FLOAT64):
        with pytest.raises(ValueError, match="JSON has no number"):
            MetadataFilter(Condition("lt", "a", (Value(tag, x),))).to_json()
        with pytest.raises(WireError):
            MetadataFilter.from_json('{"version":1,"expr":{"type":"condition","condition":{"op":"lt","key":"a","value":{"%s":null}}}}' % tag.value)
    # as large as they get, they come back
    f = B().lt("a", 1.7976931348623157e308).and_gt("b", 5e-324).build()
    assert MetadataFilter.from_json(f.to_json()) == f


NEVER = object()


def chain(rng, depth):
    """A random builder, what it should match (None: all, NEVER: nothing, else a function), and whether it has a condition."""
    b, state, touched = B(), None, False

    def join(other, by_and):
        if state is None or other is None:
            return other if state is None else state
        if NEVER in (state, other):
            return NEVER if by_and else other if state is NEVER else state
        one = state
        return (lambda r: one(r) and other(r)) if by_and else (lambda r: one(r) or other(r))

    def opposite(s):
        return NEVER if s is None else None if s is NEVER else lambda r: not s(r)

    for _ in range(rng.randint(1, 4)):
        by_and = rng.random() < 0.5
        kind = rng.random()
        if kind < 0.25:
            b, state = b.not_(), opposite(state)
        elif kind < 0.6 or not depth:
            key, n = rng.choice("ab"), rng.randint(0, 2)
            b, touched = getattr(b, "and_eq" if by_and else "or_eq")(key, n), True
            state = join(lambda r, key=key, n=n: r.get(key) == n, by_and)
        else:
            inner, inner_state, inner_touched = chain(rng, depth - 1)
            if not inner_touched:
                continue
            negate = rng.random() < 0.6
            name = ("and_" if by_and else "or_") + ("not" if negate else "")
            b, touched = getattr(b, name)(lambda g, inner=inner: inner), True
            state = join(opposite(inner_state) if negate and inner_state is not None else inner_state, by_and)
    return b, state, touched


def test_random_chains():
    rng = random.Random(3)
    records = [{k: v for k, v in (("a", a), ("b", b)) if v is not None} for a in (None, 0, 1) for b in (None, 0, 2)]
    for _ in range(4000):
        b, state, _ = chain(rng, 2)
        f = b.build()
        for r in records:
            want = True if state is None else False if state is NEVER else state(r)
            assert matches(f.expr, {k: value_of(v) for k, v in r.items()}, f.options) == want, f.expr


def test_groups_that_match_all_are_not_negated():
    all_group = lambda g: g.not_().and_eq("b", 2).not_()
    assert B().eq("a", 1).and_not(all_group).build().expr == eq("a", 1)
    assert B().and_not(all_group).build().expr is None and B().or_not(all_group).build().expr is None


def test_values_keep_their_type():
    assert value_of(True).tag == D.BOOL and value_of(1).tag == D.INT64 and value_of(1.0).tag == D.FLOAT64
    assert value_of(1 << 63).tag == D.BIG_INTEGER and value_of(Decimal(1)).tag == D.BIG_DECIMAL
    assert json_value(1) != json_value(1.0) and json_value({"a": 1, "b": 2}) == json_value({"b": 2, "a": 1})
    with pytest.raises(TypeError):
        value_of(object())

    class Mine:
        pass

    register_literal(Mine, lambda _: value_of("mine"))
    assert value_of(Mine()) == value_of("mine")


SCHEMA = MetadataSchema.builder().required("n_chars", D.INT64).required("lang", D.STRING).optional("clean", D.BOOL).build()


def test_filter_checks():
    B().ge("n_chars", 1.5).and_in_set("n_chars", [Decimal(1), Value(D.UINT8, 3)]).and_gt("lang", "a").build_checked(SCHEMA)
    with pytest.raises(UnknownFilterField, match="Metadata filter references key 'nope' not defined in schema"):
        B().exists("nope").build_checked(SCHEMA)
    with pytest.raises(InvalidFilterOperator, match="range operators require a numeric or string field") as e:
        B().gt("clean", "text").build_checked(SCHEMA)
    assert e.value.operator == "gt" and str(e.value.data_type) == "bool"
    with pytest.raises(InvalidFilterOperator, match="filter value type int64 is not compatible with field type string") as e:
        B().not_in_set("lang", ["a", 1]).build_checked(SCHEMA)
    assert e.value.operator == "not_in_set"
    with pytest.raises(InvalidFilterExpression):
        B().eq("nope", 1).and_(lambda g: g).build_checked(SCHEMA)
    # no value, no check
    B().in_set("nope", []).build_checked(SCHEMA)
    allow = MetadataSchema.builder().required("lang", D.STRING).unknown_field_policy(UnknownFieldPolicy.ALLOW).build()
    B().gt("dynamic", True).build_checked(allow)


def test_schema():
    s = MetadataSchema.builder().required("k", D.INT8).optional("k", D.JSON).optional("a", D.BOOL).build()
    assert [k for k, _ in s.fields()] == ["a", "k"] and s.field_type("k") == D.JSON and not s.field("k").required
    assert schema_from_json(schema_to_json(s)) == s
    with pytest.raises(WireError, match="missing field"):
        schema_from_json('{"fields":{}}')


def test_messages():
    assert str(MissingKey("k")) == "Metadata key not found: k"
    assert str(TypeMismatch("k", D.INT64, D.STRING)) == "Metadata key 'k' expected int64 but actual string: expected int64, got string"
    assert str(MissingRequiredField("k", D.STRING)) == "Required metadata key 'k' is missing (expected string)"
    assert str(UnknownField("k")) == "Metadata key 'k' is not defined in schema"
    assert str(InvalidFilterOperator("k", "gt", D.BOOL, "m")) == "Metadata filter operator 'gt' is invalid for key 'k' with type bool: m"
    assert str(InvalidFilterExpression("m")) == "Metadata filter expression is invalid: m"


def test_options():
    f = MetadataFilter.all().with_missing_key_policy(MissingKeyPolicy.NO_MATCH).with_number_comparison_policy(NumberComparisonPolicy.APPROXIMATE)
    assert (~f).options == f.options == FilterMatchOptions(MissingKeyPolicy.NO_MATCH, NumberComparisonPolicy.APPROXIMATE)
