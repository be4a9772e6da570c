"""Typed literals."""

from __future__ import annotations

import datetime as dt
import json
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from .dtypes import FLOATS, INTEGRAL, DataType, integer_bounds

_UNIT_S = 1_000_000_000


@dataclass(frozen=True)
class Value:
    """A value and its concrete type.

    ``data`` is plain Python: int for integers, float, Decimal, str, bool, date,
    datetime; nanoseconds for times and durations; sorted pairs for string maps;
    canonical text for JSON.
    """

    tag: DataType
    data: Any

    def __post_init__(self):
        object.__setattr__(self, "data", _checked(self.tag, self.data))

    def to_wire(self) -> dict:
        """``{type name: content}``."""
        t, x = self.tag, self.data
        if t == DataType.BIG_DECIMAL or t == DataType.BIG_INTEGER:
            x = str(x)
        elif t in FLOATS and not math.isfinite(x):
            raise ValueError(f"JSON has no number for {x}")
        elif isinstance(x, dt.date | dt.datetime):
            x = x.isoformat()
        elif t in (DataType.TIME, DataType.DURATION):
            x = {"secs": x // _UNIT_S, "nanos": x % _UNIT_S}
        elif t == DataType.STRING_MAP:
            x = dict(x)
        elif t == DataType.JSON:
            x = json.loads(x)
        return {t.value: x}

    @classmethod
    def from_wire(cls, wire: Any) -> Value:
        if not isinstance(wire, dict) or len(wire) != 1:
            raise ValueError("a value must be an object with one type name")
        name, x = next(iter(wire.items()))
        if name not in {t.value for t in DataType}:
            raise ValueError(f"unknown variant `{name}`")
        t = DataType(name)
        if t == DataType.BIG_DECIMAL:
            x = Decimal(str(x))
        elif t == DataType.BIG_INTEGER:
            x = int(str(x))
        elif t in FLOATS:
            x = _number(t, x)
            if not math.isfinite(x):
                raise ValueError(f"JSON has no number for {x}")
        elif t == DataType.DATE:
            x = dt.date.fromisoformat(x)
        elif t in (DataType.DATE_TIME, DataType.INSTANT):
            x = dt.datetime.fromisoformat(x)
        elif t in (DataType.TIME, DataType.DURATION):
            x = x["secs"] * _UNIT_S + x["nanos"]
        elif t == DataType.JSON:
            x = canonical_json(x)
        return cls(t, x)


def _number(tag: DataType, x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float):
        raise ValueError(f"{x!r} is not a {tag}")
    return float(x)


def _checked(tag: DataType, x: Any) -> Any:
    """``x`` in the form that ``tag`` has, or ValueError."""
    if tag in INTEGRAL:
        if isinstance(x, bool) or not isinstance(x, int):
            raise ValueError(f"{x!r} is not a {tag}")
        bounds = integer_bounds(tag)
        if bounds and not bounds[0] <= x <= bounds[1]:
            raise ValueError(f"{x} is out of range for {tag}")
        return x
    if tag in FLOATS:
        x = _number(tag, x)
        if tag == DataType.FLOAT32 and math.isfinite(x):
            x = struct.unpack("f", struct.pack("f", x))[0]
        return x
    if tag == DataType.BIG_DECIMAL:
        x = Decimal(x)
        if not x.is_finite():
            raise ValueError(f"{x} is not a {tag}")
        return x
    if tag == DataType.BOOL and not isinstance(x, bool):
        raise ValueError(f"{x!r} is not a {tag}")
    if tag in (DataType.STRING, DataType.URL, DataType.JSON, DataType.CHAR) and not isinstance(x, str):
        raise ValueError(f"{x!r} is not a {tag}")
    if tag == DataType.CHAR and len(x) != 1:
        raise ValueError(f"{x!r} is not one character")
    if tag == DataType.STRING_MAP:
        return tuple(sorted((str(k), str(v)) for k, v in (x.items() if isinstance(x, dict) else x)))
    return x


def canonical_json(x: Any) -> str:
    """JSON text with sorted keys and no spaces; ``1`` and ``1.0`` stay apart."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def typed(tag: DataType, x: Any) -> Value:
    """``x`` as a value of type ``tag``: dates and the like in any Python form."""
    if tag == DataType.JSON:
        return Value(tag, canonical_json(x))
    if tag == DataType.TIME and isinstance(x, dt.time):
        x = ((x.hour * 60 + x.minute) * 60 + x.second) * _UNIT_S + x.microsecond * 1000
    if tag == DataType.DURATION and isinstance(x, dt.timedelta):
        x = (x.days * 86400 + x.seconds) * _UNIT_S + x.microseconds * 1000
    return Value(tag, x)


def json_value(x: Any) -> Value:
    return typed(DataType.JSON, x)


def string_map(x: dict[str, str]) -> Value:
    return Value(DataType.STRING_MAP, x)


_CUSTOM: dict[type, Callable[[Any], Value]] = {}


def register_literal(cls: type, convert: Callable[[Any], Value]) -> None:
    """Lets instances of ``cls`` be used as values."""
    _CUSTOM[cls] = convert


def value_of(x: Any) -> Value:
    """A value of the type that a Python object stands for; no type is ever changed into another.

    int is Int64 (BigInteger beyond its range), float Float64, Decimal
    BigDecimal, str String, a naive datetime DateTime and an aware one Instant,
    dicts and lists JSON.
    """
    for cls in type(x).__mro__:
        if cls in _CUSTOM:
            return _CUSTOM[cls](x)
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return Value(DataType.BOOL, x)
    if isinstance(x, int):
        return Value(DataType.INT64 if -(1 << 63) <= x < 1 << 63 else DataType.BIG_INTEGER, x)
    if isinstance(x, dt.datetime):
        return Value(DataType.DATE_TIME if x.tzinfo is None else DataType.INSTANT, x)
    plain = {float: DataType.FLOAT64, str: DataType.STRING, Decimal: DataType.BIG_DECIMAL, dt.date: DataType.DATE, dt.time: DataType.TIME, dt.timedelta: DataType.DURATION, dict: DataType.JSON, list: DataType.JSON}
    for cls, tag in plain.items():
        if isinstance(x, cls):
            return typed(tag, x)
    raise TypeError(f"{type(x).__name__} is no metadata value; register_literal() can make it one")

