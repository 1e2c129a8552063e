"""Document filters as dictionaries, turned into one column expression that reaches the scan."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def condition(spec: dict[str, Any], columns: list[str] | None = None, within: str | None = None) -> Column:
    """{field: value}, {field: {$gt, $gte, $lt, $lte, $eq, $ne, $in, $all, $exists}}, {$or: [...]}, {$and: [...]}; an unknown operator raises ValueError.

    A field is one of `columns` (all names count as known without it) or, with
    `within`, a key of that map column. $exists asks for the key: one that holds
    null exists. Nothing equals or compares with a field that is not there, and
    dotted names are not followed into nested values.
    """
    def field(key: str) -> Column:
        return F.col(within)[key] if within else F.col(f"`{key}`") if columns is None or key in columns else F.lit(None)

    def exists(key: str) -> Column:
        return F.coalesce(F.map_contains_key(within, key), F.lit(False)) if within else F.lit(columns is None or key in columns)

    parts = []
    for key, want in spec.items():
        if key in ("$or", "$and"):
            parts.append(reduce(Column.__or__ if key == "$or" else Column.__and__, [condition(s, columns, within) for s in want]))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif not isinstance(want, dict):
            parts.append(exists(key) & field(key).isNull() if want is None else field(key) == F.lit(want))
        else:
            for op, value in want.items():
                c = field(key)
                if op in _COMPARE:
                    parts.append(getattr(c, _COMPARE[op])(F.lit(value)))
                elif op == "$in":
                    parts.append(c.isin(*value))
                elif op == "$all":
                    parts.append(F.size(F.array_except(F.array(*[F.lit(v) for v in value]), c)) == 0)
                elif op == "$exists":
                    parts.append(exists(key) if value else ~exists(key))
                else:
                    raise ValueError(f"unknown operator {op}")
    return reduce(Column.__and__, parts, F.lit(True))


def find(rows: DataFrame, spec: dict[str, Any], within: str | None = None) -> DataFrame:
    """The rows that meet a filter over their columns or, with `within`, over the keys of that map column."""
    return rows.where(condition(spec, rows.columns, within))


def bind(spec: Any, given: dict[str, Any]) -> Any:
    """A filter with its parameters ('$name' strings under 'param:') put in; missing, spare and unfit ones raise ValueError."""
    used: set[str] = set()

    def put(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: put(v) for k, v in x.items()}
        if isinstance(x, list):
            return [put(v) for v in x]
        if isinstance(x, str) and x.startswith("param:"):
            name = x[6:]
            if name not in given:
                raise ValueError(f"missing parameter {name}")
            used.add(name)
            return given[name]
        return x

    for name, v in given.items():
        if not (v is None or isinstance(v, (bool, str)) or (isinstance(v, (int, float)) and math.isfinite(v))):
            raise ValueError(f"parameter {name} must be null, a boolean, a string or a finite number")
    out = put(spec)
    if spare := set(given) - used:
        raise ValueError(f"unknown parameters {sorted(spare)}")
    return out
