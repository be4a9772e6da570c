"""Type tags of metadata values."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    """A value's concrete type. The enum's value is the name used in JSON; ``str()`` gives it in lower case."""

    BOOL = "Bool"
    CHAR = "Char"
    INT8 = "Int8"
    INT16 = "Int16"
    INT32 = "Int32"
    INT64 = "Int64"
    INT128 = "Int128"
    INT_SIZE = "IntSize"
    UINT8 = "UInt8"
    UINT16 = "UInt16"
    UINT32 = "UInt32"
    UINT64 = "UInt64"
    UINT128 = "UInt128"
    UINT_SIZE = "UIntSize"
    FLOAT32 = "Float32"
    FLOAT64 = "Float64"
    BIG_INTEGER = "BigInteger"
    BIG_DECIMAL = "BigDecimal"
    STRING = "String"
    DATE = "Date"
    TIME = "Time"
    DATE_TIME = "DateTime"
    INSTANT = "Instant"
    DURATION = "Duration"
    URL = "Url"
    STRING_MAP = "StringMap"
    JSON = "Json"

    def __str__(self) -> str:
        return self.value.lower()

    @classmethod
    def parse(cls, name: str) -> DataType:
        """Accepts the JSON name or the lower-case one."""
        low = name.lower()
        for t in cls:
            if str(t) == low:
                return t
        raise ValueError(f"unknown data type '{name}'")


D = DataType
SIGNED_BITS = {D.INT8: 8, D.INT16: 16, D.INT32: 32, D.INT64: 64, D.INT_SIZE: 64, D.INT128: 128}
UNSIGNED_BITS = {D.UINT8: 8, D.UINT16: 16, D.UINT32: 32, D.UINT64: 64, D.UINT_SIZE: 64, D.UINT128: 128}
FLOATS = frozenset({D.FLOAT32, D.FLOAT64})
BIG = frozenset({D.BIG_INTEGER, D.BIG_DECIMAL})
INTEGRAL = frozenset({*SIGNED_BITS, *UNSIGNED_BITS, D.BIG_INTEGER})
NUMERIC = frozenset({*INTEGRAL, *FLOATS, D.BIG_DECIMAL})
#: Types that have an order: numbers and strings only.
RANGED = NUMERIC | {D.STRING}


def integer_bounds(tag: DataType) -> tuple[int, int] | None:
    """Least and greatest value of an integer type; None where it has none."""
    if tag in SIGNED_BITS:
        n = SIGNED_BITS[tag]
        return -(1 << (n - 1)), (1 << (n - 1)) - 1
    if tag in UNSIGNED_BITS:
        return 0, (1 << UNSIGNED_BITS[tag]) - 1
    return None


def compatible(a: DataType, b: DataType) -> bool:
    """Whether a filter value of type ``a`` fits a field of type ``b``: the same type, or both numbers."""
    return a == b or (a in NUMERIC and b in NUMERIC)


def tag_of_spark(kind: T.DataType) -> DataType | None:
    """The tag that a plain Spark column stands for; None if it can hold no value of ours."""
    plain = {
        T.BooleanType: D.BOOL, T.ByteType: D.INT8, T.ShortType: D.INT16, T.IntegerType: D.INT32, T.LongType: D.INT64,
        T.FloatType: D.FLOAT32, T.DoubleType: D.FLOAT64, T.DecimalType: D.BIG_DECIMAL, T.DateType: D.DATE,
        T.TimestampType: D.INSTANT, T.TimestampNTZType: D.DATE_TIME, T.MapType: D.STRING_MAP,
    }
    if isinstance(kind, T.StringType):
        return D.STRING
    return plain.get(type(kind))


#: Spark type of a column that holds values of a tag.
SPARK_TYPES = {
    D.BOOL: "boolean", D.CHAR: "string", D.INT8: "tinyint", D.INT16: "smallint", D.INT32: "int", D.INT64: "bigint",
    D.INT128: "string", D.INT_SIZE: "bigint", D.UINT8: "smallint", D.UINT16: "int", D.UINT32: "bigint",
    D.UINT64: "decimal(20,0)", D.UINT128: "string", D.UINT_SIZE: "decimal(20,0)", D.FLOAT32: "float", D.FLOAT64: "double",
    D.BIG_INTEGER: "string", D.BIG_DECIMAL: "string", D.STRING: "string", D.DATE: "date", D.TIME: "bigint",
    D.DATE_TIME: "timestamp_ntz", D.INSTANT: "timestamp", D.DURATION: "bigint", D.URL: "string",
    D.STRING_MAP: "map<string,string>", D.JSON: "string",
}
