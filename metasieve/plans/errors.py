"""Errors of records, schemas and filters, with fixed codes and texts."""

from __future__ import annotations


class MetadataError(Exception):
    """Base of all; ``code`` names the kind, also in error columns."""

    code = "MetadataError"


class MissingKey(MetadataError):
    code = "MissingKey"

    def __init__(self, key: str):
        self.key = key
        super().__init__(f"Metadata key not found: {key}")


class TypeMismatch(MetadataError):
    code = "TypeMismatch"

    def __init__(self, key: str, expected, actual, message: str | None = None):
        self.key, self.expected, self.actual = key, expected, actual
        self.message = message if message is not None else f"expected {expected}, got {actual}"
        super().__init__(f"Metadata key '{key}' expected {expected} but actual {actual}: {self.message}")


class MissingRequiredField(MetadataError):
    code = "MissingRequiredField"

    def __init__(self, key: str, expected):
        self.key, self.expected = key, expected
        super().__init__(f"Required metadata key '{key}' is missing (expected {expected})")


class UnknownField(MetadataError):
    code = "UnknownField"

    def __init__(self, key: str):
        self.key = key
        super().__init__(f"Metadata key '{key}' is not defined in schema")


class UnknownFilterField(MetadataError):
    code = "UnknownFilterField"

    def __init__(self, key: str):
        self.key = key
        super().__init__(f"Metadata filter references key '{key}' not defined in schema")


class InvalidFilterOperator(MetadataError):
    code = "InvalidFilterOperator"

    def __init__(self, key: str, operator: str, data_type, message: str):
        self.key, self.operator, self.data_type, self.message = key, operator, data_type, message
        super().__init__(f"Metadata filter operator '{operator}' is invalid for key '{key}' with type {data_type}: {message}")


class InvalidFilterExpression(MetadataError):
    code = "InvalidFilterExpression"

    def __init__(self, message: str):
        self.message = message
        super().__init__(f"Metadata filter expression is invalid: {message}")
