"""The typed bag: a map from key to a struct with a type tag and one lane a kind.

Each function takes and returns columns and stays in built-in expressions. A key
is present or absent; there is no null value. ``entry`` structs are what a bag's
map holds.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dtypes import BIG, FLOATS, NUMERIC, SIGNED_BITS, SPARK_TYPES, UNSIGNED_BITS, DataType
from ..plans.errors import MissingKey
from ..plans.values import Value, value_of
from .numbers import Operand

#: Lanes of an entry: signed integers, unsigned ones, floats, wide numbers as text, strings and so on.
LANES = {
    "t": "string", "b": "boolean", "i": "bigint", "n": "decimal(20,0)", "f": "double", "w": "string", "s": "string",
    "d": "date", "ns": "bigint", "ts": "timestamp", "tsn": "timestamp_ntz", "kv": "array<struct<k:string,v:string>>", "j": "string",
}
ENTRY = f"struct<{','.join(f'{k}:{t}' for k, t in LANES.items())}>"
BAG = f"map<string,{ENTRY}>"
#: Error of a row, as a column.
ERROR = "struct<code:string,key:string,expected:string,actual:string,message:string>"

D = DataType
_LANE_OF = {
    D.BOOL: "b", D.CHAR: "s", D.STRING: "s", D.URL: "s", D.DATE: "d", D.TIME: "ns", D.DURATION: "ns", D.INSTANT: "ts",
    D.DATE_TIME: "tsn", D.STRING_MAP: "kv", D.JSON: "j", D.INT128: "w", D.UINT128: "w",
    **{t: "w" for t in BIG}, **{t: "f" for t in FLOATS},
    **{t: "i" for t, n in SIGNED_BITS.items() if n <= 64}, **{t: "n" for t, n in UNSIGNED_BITS.items() if n <= 64},
}


def lane_of(tag: DataType) -> str:
    return _LANE_OF[tag]


def string_map_entries(m: Column) -> Column:
    """A map of strings as sorted pairs, which compare."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return F.array_sort(pairs)


def entry(value: Column, tag: DataType) -> Column:
    """An entry of type ``tag``; null where ``value`` is null."""
    lane = _LANE_OF[tag]
    if lane == "kv":
        value = string_map_entries(value)
    elif lane == "w":
        value = value.cast("string")
    fields = [F.lit(tag.value).alias("t")]
    fields += [(value if k == lane else F.lit(None)).cast(kind).alias(k) for k, kind in LANES.items() if k != "t"]
    return F.when(value.isNotNull(), F.struct(*fields))


def literal(v: Value) -> Column:
    """A literal in the form of its lane."""
    lane = _LANE_OF[v.tag]
    if lane == "kv":
        pairs = [F.struct(F.lit(k).alias("k"), F.lit(x).alias("v")) for k, x in v.data]
        return (F.array(*pairs) if pairs else F.array()).cast(LANES["kv"])
    if lane == "w":
        return F.lit(str(v.data))
    return F.lit(v.data).cast(LANES[lane])


def literal_entry(x: Any) -> Column:
    """A typed literal as an entry."""
    v = value_of(x)
    fields = [F.lit(v.tag.value).alias("t")]
    fields += [(literal(v) if k == _LANE_OF[v.tag] else F.lit(None)).cast(kind).alias(k) for k, kind in LANES.items() if k != "t"]
    return F.struct(*fields)


def empty() -> Column:
    return F.create_map().cast(BAG)


def bag_of(entries: dict[str, Column]) -> Column:
    """A bag of entries by key; null entries are left out. Keys come in the order of their bytes."""
    if not entries:
        return empty()
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), e.alias("value")) for k, e in sorted(entries.items(), key=lambda kv: kv[0].encode())])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def canonical(m: Column) -> Column:
    """The bag with its keys in the order of their bytes."""
    keys = F.array_sort(F.map_keys(m))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(m, k)))


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


def length(m: Column) -> Column:
    return F.size(m)


def contains_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, F.lit(key))


def get_raw(m: Column, key: str) -> Column:
    """The entry of a key; null if absent."""
    return F.try_element_at(m, F.lit(key))


def data_type(m: Column, key: str) -> Column:
    """The type's name in lower case; null if absent."""
    return F.lower(get_raw(m, key)["t"])


def operand(e: Column, tag: DataType) -> Operand:
    """An entry's lane as a number to compare."""
    lane = _LANE_OF[tag]
    if lane == "i":
        return Operand(e["i"], tag, "int", -(1 << 63), (1 << 63) - 1)
    if lane == "n":
        return Operand(e["n"], tag, "decimal", -(10**20 - 1), 10**20 - 1, 0)
    return Operand(e[lane], tag, "double" if lane == "f" else "wide")


def convert(e: Column, tag: DataType) -> Column:
    """An entry's value as Spark's type for ``tag``; null where the entry is null or cannot be converted.

    The same type always converts; numbers, booleans and text convert as
    ``try_cast`` does; dates and the like to text; other pairs do not.
    """
    kind = SPARK_TYPES[tag]
    own, t = e[_LANE_OF[tag]], e["t"]
    if _LANE_OF[tag] == "kv":
        return F.when(t == tag.value, F.map_from_entries(own))
    out = F.when(t == tag.value, own.try_cast(kind))
    if tag in NUMERIC:
        for lane in ("i", "n", "f", "w", "s", "b"):
            from_lane = e[lane] if lane != "b" or tag in FLOATS or _LANE_OF[tag] in "in" else None
            if from_lane is not None:
                out = out.when(from_lane.isNotNull(), from_lane.cast("string").try_cast(kind) if lane in "fw" and kind.startswith("decimal") else from_lane.try_cast(kind))
        return out
    if tag == DataType.STRING:
        for lane in ("s", "b", "i", "n", "f", "w", "d", "ts", "tsn", "j"):
            out = out.when(e[lane].isNotNull(), e[lane].cast("string"))
        return out
    if tag == DataType.BOOL:
        return out.when(e["s"].isNotNull(), e["s"].try_cast("boolean")).when(e["i"].isNotNull(), e["i"] != 0)
    return out


def get(m: Column, key: str, tag: DataType) -> Column:
    """The value as ``tag``; null if absent or not convertible."""
    return convert(get_raw(m, key), tag)


def get_or(m: Column, key: str, default: Any, tag: DataType | None = None) -> Column:
    """The value as ``tag`` (the default's own type), or the default."""
    v = value_of(default)
    tag = tag or v.tag
    return F.coalesce(get(m, key, tag), convert(literal_entry(v), tag))


def error(code: str, key: Column | str, expected: Any = None, actual: Column | None = None, message: Column | None = None) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    parts = [F.lit(code), key, F.lit(None if expected is None else str(expected)), actual, message]
    names = ["code", "key", "expected", "actual", "message"]
    return F.struct(*[(F.lit(None) if p is None else p).cast("string").alias(n) for p, n in zip(parts, names, strict=True)])


def try_get(m: Column, key: str, tag: DataType) -> Column:
    """A struct of ``value`` and ``error``: one of them is null."""
    e, value = get_raw(m, key), get(m, key, tag)
    actual = F.lower(e["t"])
    text = F.concat(F.lit("Cannot convert '"), F.coalesce(e["s"], e["j"], convert(e, DataType.STRING), F.lit("")), F.lit(f"' to {tag}"))
    missing = error(MissingKey.code, key, message=F.lit(str(MissingKey(key))))
    mismatch = error("TypeMismatch", key, tag, actual, text)
    return F.struct(value.alias("value"), F.when(e.isNull(), missing).when(value.isNull(), mismatch).alias("error"))


def get_or_fail(m: Column, key: str, tag: DataType) -> Column:
    """The value as ``tag``; the query fails where there is none."""
    e, value = get_raw(m, key), get(m, key, tag)
    said = F.when(e.isNull(), F.lit(str(MissingKey(key)))).otherwise(F.concat(F.lit(f"Metadata key '{key}' expected {tag} but actual "), F.lower(e["t"])))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(said))


def remove(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != F.lit(key))


def set_raw(m: Column, key: str, e: Column) -> Column:
    """The bag with one entry more, or another one; a null entry removes it."""
    rest = remove(m, key)
    return F.when(e.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), e)))


def set_value(m: Column, key: str, x: Any) -> Column:
    """:func:`set_raw` with a typed literal."""
    return F.map_concat(remove(m, key), F.create_map(F.lit(key), literal_entry(x)))


def set_checked(schema, m: Column, key: str, x: Any) -> Column:
    """:func:`set_value` after the schema's check of key and type, which raises at once. Required keys are not looked at."""
    check_entry(schema, key, value_of(x).tag)
    return set_value(m, key, x)


def check_entry(schema, key: str, tag: DataType) -> None:
    from ..plans.errors import TypeMismatch, UnknownField
    from ..plans.schema import UnknownFieldPolicy

    field = schema.field(key)
    if field is None:
        if schema.unknown_field_policy == UnknownFieldPolicy.REJECT:
            raise UnknownField(key)
    elif field.data_type != tag:
        raise TypeMismatch(key, field.data_type, tag)


def clear(m: Column) -> Column:
    """No entry; null stays null."""
    return F.map_filter(m, lambda k, v: F.lit(False))


def keys(m: Column) -> Column:
    """Keys in the order of their bytes."""
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """Entries in the order of their keys."""
    return F.transform(keys(m), lambda k: F.element_at(m, k))


def pairs(m: Column) -> Column:
    """Keys and entries in the order of the keys: for ``posexplode``."""
    return F.transform(keys(m), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value")))


def merge(a: Column, b: Column) -> Column:
    """All entries of both; of a key in both, ``b`` has its way."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def retain(m: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The entries for which ``keep(key, entry)`` is true."""
    return F.map_filter(m, lambda k, v: F.coalesce(keep(k, v), F.lit(False)))


def equal(a: Column, b: Column) -> Column:
    """Whether two bags have the same keys, types and values."""
    return keys(a).eqNullSafe(keys(b)) & values(a).eqNullSafe(values(b))


def from_pairs(array: Column) -> Column:
    """A bag from an array of ``struct<key, value>`` (entries); of equal keys the last has its way."""
    n = F.size(array)
    place = F.transform(array, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i")))
    later = lambda p: F.exists(F.slice(array, p["i"] + 2, n), lambda q: q["key"] == p["key"])
    kept = F.filter(place, lambda p: ~later(p) & p["value"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"], p["value"])))
