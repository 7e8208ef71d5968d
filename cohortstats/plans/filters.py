"""Rule trees of the query builder as Spark conditions; nulls behave as in SQL."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FilterError

_BINARY = {
    "equal": lambda c, v: c == v,
    "not_equal": lambda c, v: c != v,
    "less": lambda c, v: c < v,
    "greater": lambda c, v: c > v,
    "less_or_equal": lambda c, v: c <= v,
    "greater_or_equal": lambda c, v: c >= v,
}
_OTHER = {
    "between": lambda c, v: c.between(*v),
    "not_between": lambda c, v: ~c.between(*v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}
OPERATORS = {**_BINARY, **_OTHER}
CASTS = {"int": int, "real": float, "text": str}


def to_column(rules: Mapping[str, Any] | None) -> Column | None:
    """The condition of a rule tree; None for no tree (or an empty group), which keeps every row."""
    if not rules:
        return None
    if not isinstance(rules, Mapping):
        raise FilterError(f"A filter must be an object, not {type(rules).__name__}.")
    if "condition" in rules:
        parts = [c for c in map(to_column, rules.get("rules", [])) if c is not None]
        if rules["condition"] not in ("AND", "OR"):
            raise FilterError(f"Condition {rules['condition']} is not AND or OR.")
        return reduce((lambda a, b: a & b) if rules["condition"] == "AND" else (lambda a, b: a | b), parts) if parts else None
    if "id" not in rules or "operator" not in rules:
        raise FilterError(f"A rule needs id and operator: {dict(rules)}.")
    op = rules["operator"]
    if op not in OPERATORS:
        raise FilterError(f"Operator {op} is not supported.")
    value, column = rules.get("value"), F.col(f"`{rules['id']}`")
    if op in ("between", "not_between") and (not isinstance(value, (list, tuple)) or len(value) != 2):
        raise FilterError(f"Operator {op} needs two values.")
    if op in ("in", "not_in") and not isinstance(value, (list, tuple)):
        raise FilterError(f"Operator {op} needs a list of values.")
    return OPERATORS[op](column, F.lit(value) if op in _BINARY else value)


def validate(rules: Mapping[str, Any] | None, types: Mapping[str, str]) -> None:
    """Raises unless every rule names a known operator and column (``types``: name to sql type) and its
    values can be cast to the column's type."""
    if rules is None:
        return
    if not isinstance(rules, Mapping) or not ("condition" in rules or "id" in rules):
        raise FilterError(f"Invalid filters format: {rules!r}.")
    if "condition" in rules:
        if rules["condition"] not in ("AND", "OR"):
            raise FilterError(f"Condition {rules['condition']} is not AND or OR.")
        for rule in rules.get("rules", []):
            validate(rule, types)
        return
    if rules.get("operator") not in OPERATORS:
        raise FilterError(f"Operator {rules.get('operator')} is not supported.")
    if rules["id"] not in types:
        raise FilterError(f"Column {rules['id']} is not among the variables of the data model.")
    value = rules.get("value")
    for v in value if isinstance(value, (list, tuple)) else [value]:
        if v is not None:
            try:
                CASTS[types[rules["id"]]](v)
            except (TypeError, ValueError) as error:
                raise FilterError(f"{rules['id']}'s type {types[rules['id']]} does not hold {v!r}.") from error
