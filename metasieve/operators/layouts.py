"""Where a record's keys are: flat columns, fields of a struct, or a typed bag."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bag
from ..functions.numbers import Operand
from ..plans.dtypes import FLOATS, DataType, tag_of_spark


def _name(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


@dataclass(frozen=True)
class Flat:
    """Keys are columns, or fields of the struct column ``inside``; absent is null.

    Tags come from ``tags``, else from the ``dtype`` in a field's metadata, else
    from its Spark type. A key without a column is absent from every record.
    """

    schema: T.StructType
    inside: str | None = None
    tags: dict[str, DataType] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, inside: str | None = None, tags: dict[str, DataType] | None = None) -> Flat:
        schema = df.schema if inside is None else df.schema[inside].dataType
        return cls(schema, inside, tags or {})

    def tag(self, key: str) -> DataType | None:
        if key not in self.schema.names:
            return None
        if key in self.tags:
            return self.tags[key]
        f = self.schema[key]
        named = (f.metadata or {}).get("dtype")
        return DataType.parse(named) if named else tag_of_spark(f.dataType)

    def column(self, key: str) -> Column:
        return F.col(_name(key) if self.inside is None else f"{_name(self.inside)}.{_name(key)}")

    def present(self, key: str) -> Column:
        if key not in self.schema.names:
            return F.lit(False)
        return self.column(key).isNotNull()

    def operand(self, key: str) -> Operand:
        kind, tag, col = self.schema[key].dataType, self.tag(key), self.column(key)
        whole = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind))
        if whole:
            return Operand(col, tag, "int", -(1 << whole), (1 << whole) - 1)
        if isinstance(kind, T.DecimalType):
            most = 10**kind.precision - 1
            return Operand(col, tag, "decimal", -most, most, kind.scale)
        if tag in FLOATS:
            return Operand(col, tag, "float" if isinstance(kind, T.FloatType) else "double")
        return Operand(col, tag, "wide")

    def entry(self, key: str) -> Column:
        """The key's value as an entry of a bag."""
        return bag.entry(self.column(key), self.tag(key))

    def to_bag(self, keys: list[str] | None = None) -> Column:
        """All keys (of known type) as one bag."""
        found = [k for k in (keys or self.schema.names) if self.tag(k) is not None]
        return bag.bag_of({k: self.entry(k) for k in found})


@dataclass(frozen=True)
class Bag:
    """Keys are in the typed bag column ``name``."""

    name: str

    def column(self) -> Column:
        return F.col(_name(self.name))

    def present(self, key: str) -> Column:
        return F.coalesce(bag.contains_key(self.column(), key), F.lit(False))

    def entry(self, key: str) -> Column:
        return bag.get_raw(self.column(), key)


Layout = Flat | Bag

