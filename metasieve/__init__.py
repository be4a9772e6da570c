"""Typed metadata at table scale: records, schemas and filters as Spark columns."""

from .operators.filtering import apply_filter, filter_column
from .operators.layouts import Bag, Flat
from .operators.validation import error_column, require_valid, split_valid
from .plans.dtypes import DataType
from .plans.errors import (
    InvalidFilterExpression,
    InvalidFilterOperator,
    MetadataError,
    MissingKey,
    MissingRequiredField,
    TypeMismatch,
    UnknownField,
    UnknownFilterField,
)
from .plans.filters import Condition, FilterMatchOptions, MetadataFilter, MetadataFilterBuilder, MissingKeyPolicy, NumberComparisonPolicy
from .plans.schema import MetadataField, MetadataSchema, MetadataSchemaBuilder, UnknownFieldPolicy
from .plans.values import Value, json_value, register_literal, string_map, typed, value_of

__all__ = [
    "Bag", "Condition", "DataType", "FilterMatchOptions", "Flat", "InvalidFilterExpression", "InvalidFilterOperator",
    "MetadataError", "MetadataField", "MetadataFilter", "MetadataFilterBuilder", "MetadataSchema", "MetadataSchemaBuilder",
    "MissingKey", "MissingKeyPolicy", "MissingRequiredField", "NumberComparisonPolicy", "TypeMismatch", "UnknownField",
    "UnknownFieldPolicy", "UnknownFilterField", "Value", "apply_filter", "error_column", "filter_column", "json_value",
    "register_literal", "require_valid", "split_valid", "string_map", "typed", "value_of",
]
