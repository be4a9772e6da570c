"""Records at the border: typed JSON, flat tables and rows of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bag
from ..operators.layouts import Flat
from ..plans.dtypes import DataType
from ..plans.schema import MetadataSchema

D = DataType
#: JSON content of a value by its type name; what is not plain JSON is text or an object.
_CONTENT = {
    "b": "boolean", "i": "bigint", "n": "decimal(20,0)", "f": "double", "w": "string", "s": "string", "d": "date",
    "ns": "struct<secs:bigint,nanos:bigint>", "ts": "timestamp", "tsn": "timestamp_ntz", "kv": "map<string,string>", "j": "string",
}
_NANOS = 1_000_000_000


def _wire_type() -> str:
    return "struct<" + ",".join(f"{t.value}:{_CONTENT[bag.lane_of(t)]}" for t in DataType) + ">"


def bag_from_json(text: Column) -> Column:
    """A bag from ``{"key": {"Int64": 10}, ...}``; null for text that is no JSON object. Unknown types are left out."""
    got = F.from_json(text, f"map<string,{_wire_type()}>")

    def one(_: Column, v: Column) -> Column:
        found = []
        for t in DataType:
            x = v[t.value]
            if bag.lane_of(t) == "ns":
                x = x["secs"] * _NANOS + x["nanos"]
            found.append(bag.entry(x, t))
        return F.coalesce(*found)

    return F.map_filter(F.transform_values(got, one), lambda _, v: v.isNotNull())


def bag_to_json(m: Column) -> Column:
    """The typed JSON of a bag, with keys in the order of their bytes."""

    def one(_: Column, e: Column) -> Column:
        fields = []
        for t in DataType:
            lane = bag.lane_of(t)
            x = e[lane]
            if lane == "ns":
                x = F.struct(F.floor(x / _NANOS).cast("bigint").alias("secs"), F.pmod(x, F.lit(_NANOS)).alias("nanos"))
            elif lane == "kv":
                x = F.map_from_entries(x)
            fields.append(F.when(e["t"] == t.value, x).alias(t.value))
        return F.struct(*fields)

    return F.to_json(F.transform_values(bag.canonical(m), one))


def bag_from_columns(df: DataFrame, keys: list[str] | None = None, tags: dict[str, DataType] | None = None) -> Column:
    """Flat columns as one bag; null columns are absent keys."""
    return Flat.of(df, tags=tags).to_bag(keys)


def columns_from_bag(df: DataFrame, bag_col: str, schema: MetadataSchema, drop: bool = True) -> DataFrame:
    """Declared keys as columns with their tags; a value of another type is null."""
    m = F.col(bag_col)
    raw = {k: bag.get_raw(m, k) for k, _ in schema.fields()}
    cols = [F.when(raw[k]["t"] == f.data_type.value, bag.convert(raw[k], f.data_type)).alias(k, metadata={"dtype": f.data_type.value}) for k, f in schema.fields()]
    kept = [F.col(f"`{c}`") for c in df.columns if not (drop and c == bag_col)]
    return df.select(*kept, *cols)


def rows_of_bag(df: DataFrame, id_col: str, bag_col: str) -> DataFrame:
    """A row an entry: ``id_col, pos, key, value``, in key order by ``pos``."""
    out = df.select(F.col(id_col), F.posexplode(bag.pairs(F.col(bag_col))).alias("pos", "pair"))
    return out.select(id_col, "pos", F.col("pair.key").alias("key"), F.col("pair.value").alias("value"))


def bags_of_rows(rows: DataFrame, id_col: str, order_col: str, bag_name: str = "bag") -> DataFrame:
    """Bags from rows of ``key`` and ``value`` (entries); of equal keys of an id, the last by ``order_col`` has its way.

    Rows meet by id and key first, so an id gathers one entry a key.
    """
    last = rows.groupBy(id_col, "key").agg(F.max_by("value", order_col).alias("value"))
    return last.groupBy(id_col).agg(bag.canonical(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias(bag_name))


def overlay(left: DataFrame, right: DataFrame, id_col: str, bag_col: str) -> DataFrame:
    """Two tables of bags as one, by id: entries of ``right`` have their way."""
    a = left.select(id_col, F.col(bag_col).alias("a"))
    b = right.select(id_col, F.col(bag_col).alias("b"))
    merged = bag.merge(F.coalesce("a", bag.empty()), F.coalesce("b", bag.empty()))
    return a.join(b, id_col, "full").select(id_col, merged.alias(bag_col))
