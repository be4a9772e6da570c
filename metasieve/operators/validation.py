"""Records against schemas: the first error of each row as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bag
from ..plans.errors import MissingRequiredField, TypeMismatch, UnknownField
from ..plans.schema import MetadataSchema, UnknownFieldPolicy
from .layouts import Bag, Flat, Layout


def error_column(schema: MetadataSchema, layout: Layout) -> Column:
    """The first error of a record, or null.

    Missing required keys come first, in key order; then each entry, in key
    order: a type that is not the declared one, or a key that is not declared.
    """
    missing = [
        F.when(~layout.present(k), bag.error("MissingRequiredField", k, f.data_type, message=F.lit(str(MissingRequiredField(k, f.data_type)))))
        for k, f in schema.fields() if f.required
    ]
    entries = _bag_errors(schema, layout) if isinstance(layout, Bag) else _flat_errors(schema, layout)
    found = [*missing, *entries]
    return F.coalesce(*found) if found else F.lit(None).cast(bag.ERROR)


def _flat_errors(schema: MetadataSchema, layout: Flat) -> list[Column]:
    """Types are known when the query is made; only presence differs by row."""
    reject = schema.unknown_field_policy == UnknownFieldPolicy.REJECT
    out = []
    for k in sorted(layout.schema.names, key=str.encode):
        field, tag = schema.field(k), layout.tag(k)
        if field is None:
            if reject:
                out.append(F.when(layout.present(k), bag.error("UnknownField", k, message=F.lit(str(UnknownField(k))))))
        elif tag != field.data_type:
            e = TypeMismatch(k, field.data_type, tag)
            out.append(F.when(layout.present(k), bag.error(e.code, k, field.data_type, F.lit(str(tag)), F.lit(e.message))))
    return out


def _bag_errors(schema: MetadataSchema, layout: Bag) -> list[Column]:
    """The first bad entry by key: one pass over the entries, whatever their keys."""
    declared = {k: f.data_type for k, f in schema.fields()}
    reject = schema.unknown_field_policy == UnknownFieldPolicy.REJECT
    types = F.create_map(*[F.lit(x) for k, t in declared.items() for x in (k, t.value)]) if declared else None

    def bad(pair: Column) -> Column:
        if types is None:
            return F.lit(reject)
        want = F.try_element_at(types, pair["key"])
        return F.when(want.isNull(), F.lit(reject)).otherwise(want != pair["value"]["t"])

    first = F.try_element_at(F.filter(bag.pairs(layout.column()), bad), F.lit(1))
    key, actual = first["key"], F.lower(first["value"]["t"])
    want = F.lower(F.try_element_at(types, key)) if types is not None else F.lit(None).cast("string")
    unknown = bag.error("UnknownField", key, message=F.format_string("Metadata key '%s' is not defined in schema", key))
    mismatch = F.struct(F.lit("TypeMismatch").alias("code"), key.alias("key"), want.alias("expected"), actual.alias("actual"), F.format_string("expected %s, got %s", want, actual).alias("message"))
    return [F.when(first.isNotNull(), F.when(want.isNull(), unknown).otherwise(mismatch))]


def split_valid(df: DataFrame, schema: MetadataSchema, layout: Layout | None = None, error_name: str = "error") -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their error in ``error_name``, the last column.

    Where ``df`` has a column of that name, underscores come in front of it.
    """
    name = free_name(error_name, df.columns)
    checked = df.withColumn(name, error_column(schema, layout or Flat.of(df)))
    return checked.filter(F.col(name).isNull()).drop(name), checked.filter(F.col(name).isNotNull())


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def require_valid(df: DataFrame, schema: MetadataSchema, layout: Layout | None = None) -> DataFrame:
    """``df``, as a query that fails at the first bad record."""
    e = error_column(schema, layout or Flat.of(df))
    return df.filter(F.when(e.isNull(), F.lit(True)).otherwise(F.raise_error(e["message"]).cast("boolean")))
