"""Schemas of records: strict for data, lenient between numbers for filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .dtypes import RANGED, SPARK_TYPES, DataType, compatible
from .errors import InvalidFilterOperator, UnknownFilterField
from .filters import NONE, RANGES, MetadataFilter


class UnknownFieldPolicy(Enum):
    """What becomes of keys, in records and filters, that are not declared."""

    REJECT = "Reject"
    ALLOW = "Allow"


@dataclass(frozen=True)
class MetadataField:
    data_type: DataType
    required: bool


@dataclass(frozen=True)
class MetadataSchema:
    """Declared fields by key. The default declares none and rejects all."""

    declared: dict[str, MetadataField] = field(default_factory=dict)
    unknown_field_policy: UnknownFieldPolicy = UnknownFieldPolicy.REJECT

    @staticmethod
    def builder() -> MetadataSchemaBuilder:
        return MetadataSchemaBuilder()

    def field(self, key: str) -> MetadataField | None:
        return self.declared.get(key)

    def field_type(self, key: str) -> DataType | None:
        found = self.declared.get(key)
        return found.data_type if found else None

    def fields(self) -> Iterator[tuple[str, MetadataField]]:
        """By key, in the order of its UTF-8 bytes."""
        return iter(sorted(self.declared.items(), key=lambda kv: kv[0].encode()))

    def to_struct(self) -> T.StructType:
        """Columns for records of this schema; the tag goes into the field's metadata."""
        kinds = {k: T._parse_datatype_string(SPARK_TYPES[f.data_type]) for k, f in self.declared.items()}
        return T.StructType([T.StructField(k, kinds[k], not f.required, {"dtype": f.data_type.value}) for k, f in self.fields()])

    def validate_filter(self, f: MetadataFilter) -> None:
        """Raises for the first predicate, from the left, that does not fit."""
        for c in f.conditions():
            if c.op in NONE:
                self._filter_field(c.key)
            # a predicate with an empty list of values has nothing to check, not even its key
            for v in c.values:
                found = self._filter_field(c.key)
                if found is None:
                    continue
                name, kind = {"in": "in_set", "not_in": "not_in_set"}.get(c.op, c.op), found.data_type
                if c.op in RANGES and kind not in RANGED:
                    raise InvalidFilterOperator(c.key, name, kind, "range operators require a numeric or string field")
                if not compatible(v.tag, kind):
                    raise InvalidFilterOperator(c.key, name, kind, f"filter value type {v.tag} is not compatible with field type {kind}")

    def _filter_field(self, key: str) -> MetadataField | None:
        found = self.declared.get(key)
        if found is None and self.unknown_field_policy == UnknownFieldPolicy.REJECT:
            raise UnknownFilterField(key)
        return found


class MetadataSchemaBuilder:
    """Declares fields; the last declaration of a key holds."""

    def __init__(self):
        self._fields: dict[str, MetadataField] = {}
        self._policy = UnknownFieldPolicy.REJECT

    def required(self, key: str, data_type: DataType) -> MetadataSchemaBuilder:
        self._fields[key] = MetadataField(data_type, True)
        return self

    def optional(self, key: str, data_type: DataType) -> MetadataSchemaBuilder:
        self._fields[key] = MetadataField(data_type, False)
        return self

    def unknown_field_policy(self, policy: UnknownFieldPolicy) -> MetadataSchemaBuilder:
        self._policy = policy
        return self

    def build(self) -> MetadataSchema:
        return MetadataSchema(dict(self._fields), self._policy)
