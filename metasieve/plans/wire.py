"""The versioned JSON form of filters, schemas and conditions."""

from __future__ import annotations

import json
from typing import Any

from .dtypes import DataType
from .filters import MANY, NONE, ONE, And, Condition, Expr, FilterMatchOptions, MetadataFilter, MissingKeyPolicy, Never, Not, NumberComparisonPolicy, Or
from .schema import MetadataField, MetadataSchema, UnknownFieldPolicy
from .values import Value

VERSION = 1


class WireError(ValueError):
    """JSON that is not of the form expected."""


def _object(x: Any, needed: set[str], optional: set[str] = frozenset()) -> dict:
    if not isinstance(x, dict):
        raise WireError(f"expected an object, got {type(x).__name__}")
    for k in sorted(needed - x.keys()):
        raise WireError(f"missing field `{k}`")
    for k in x:
        if k not in needed and k not in optional:
            raise WireError(f"unknown field `{k}`")
    return x


def _value(x: Any) -> Value:
    try:
        return Value.from_wire(x)
    except (ValueError, KeyError, TypeError, ArithmeticError) as e:
        raise WireError(str(e)) from None


def condition_to_wire(c: Condition) -> dict:
    out: dict = {"op": c.op, "key": c.key}
    if c.op in ONE:
        out["value"] = c.values[0].to_wire()
    elif c.op in MANY:
        out["values"] = [v.to_wire() for v in c.values]
    return out


def condition_from_wire(x: Any) -> Condition:
    op = x.get("op") if isinstance(x, dict) else None
    if op in ONE:
        x = _object(x, {"op", "key", "value"})
        values = (_value(x["value"]),)
    elif op in MANY:
        x = _object(x, {"op", "key", "values"})
        if not isinstance(x["values"], list):
            raise WireError("`values` must be a list")
        values = tuple(_value(v) for v in x["values"])
    elif op in NONE:
        x, values = _object(x, {"op", "key"}), ()
    else:
        raise WireError("missing field `op`" if op is None else f"unknown variant `{op}`")
    if not isinstance(x["key"], str):
        raise WireError("`key` must be a string")
    return Condition(op, x["key"], values)


def expr_to_wire(e: Expr) -> dict:
    if isinstance(e, Condition):
        return {"type": "condition", "condition": condition_to_wire(e)}
    if isinstance(e, And | Or):
        return {"type": "and" if isinstance(e, And) else "or", "children": [expr_to_wire(c) for c in e.children]}
    if isinstance(e, Not):
        return {"type": "not", "expr": expr_to_wire(e.child)}
    return {"type": "false"}


def expr_from_wire(x: Any) -> Expr:
    """The tree as it stands in the JSON: nothing is merged or simplified."""
    kind = x.get("type") if isinstance(x, dict) else None
    if kind == "condition":
        return condition_from_wire(_object(x, {"type", "condition"})["condition"])
    if kind in ("and", "or"):
        children = _object(x, {"type", "children"})["children"]
        if not isinstance(children, list):
            raise WireError("`children` must be a list")
        if not children:
            raise WireError(f"empty '{kind}' filter group is not allowed")
        return (And if kind == "and" else Or)(tuple(expr_from_wire(c) for c in children))
    if kind == "not":
        return Not(expr_from_wire(_object(x, {"type", "expr"})["expr"]))
    if kind == "false":
        _object(x, {"type"})
        return Never()
    raise WireError("missing field `type`" if kind is None else f"unknown variant `{kind}`")


def filter_to_wire(f: MetadataFilter) -> dict:
    out: dict = {"version": VERSION}
    if f.expr is not None:
        out["expr"] = expr_to_wire(f.expr)
    out["options"] = {
        "missing_key_policy": f.options.missing_key_policy.value,
        "number_comparison_policy": f.options.number_comparison_policy.value,
    }
    return out


def filter_from_wire(x: Any) -> MetadataFilter:
    x = _object(x, set(), {"version", "expr", "options"})
    version = x.get("version", VERSION)
    if isinstance(version, bool) or not isinstance(version, int):
        raise WireError("`version` must be a number")
    if version != VERSION:
        raise WireError(f"unsupported MetadataFilter wire format version {version}; expected {VERSION}")
    options = FilterMatchOptions()
    if "options" in x:
        o = _object(x["options"], {"missing_key_policy", "number_comparison_policy"}, set(x["options"]))
        try:
            options = FilterMatchOptions(MissingKeyPolicy(o["missing_key_policy"]), NumberComparisonPolicy(o["number_comparison_policy"]))
        except ValueError as e:
            raise WireError(str(e)) from None
    return MetadataFilter(None if x.get("expr") is None else expr_from_wire(x["expr"]), options)


def filter_to_json(f: MetadataFilter) -> str:
    return json.dumps(filter_to_wire(f), ensure_ascii=False)


def _loads(text: str) -> Any:
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise WireError(str(e)) from None


def filter_from_json(text: str) -> MetadataFilter:
    return filter_from_wire(_loads(text))


def schema_to_json(s: MetadataSchema) -> str:
    fields = {k: {"data_type": str(f.data_type), "required": f.required} for k, f in s.fields()}
    return json.dumps({"fields": fields, "unknown_field_policy": s.unknown_field_policy.value}, ensure_ascii=False)


def schema_from_json(text: str) -> MetadataSchema:
    x = _object(_loads(text), {"fields", "unknown_field_policy"})
    fields = {}
    for k, f in _object(x["fields"], set(), set(x["fields"])).items():
        f = _object(f, {"data_type", "required"})
        if not isinstance(f["required"], bool):
            raise WireError("`required` must be a boolean")
        try:
            fields[k] = MetadataField(DataType.parse(f["data_type"]), f["required"])
        except ValueError as e:
            raise WireError(str(e)) from None
    try:
        return MetadataSchema(fields, UnknownFieldPolicy(x["unknown_field_policy"]))
    except ValueError as e:
        raise WireError(str(e)) from None
