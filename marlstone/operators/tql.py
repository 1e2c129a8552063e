"""A small query language over nodes and edges, planned as DataFrames.

    FIND {field: value, field: {$gt: 1}} RETURN a, b ORDER BY a DESC LIMIT 5 OFFSET 2
    MATCH (a)-[:LABEL]->(b) WHERE b.field > 2 RETURN a.id, b.id
    MATCH (a)-[:LABEL*1..2]->(b) RETURN DISTINCT a.id, b.id
    FIND {...} RETURN COUNT(*) AS n, SUM(x) AS total

Anything else raises QueryError. $name in a query is a parameter: null, a
boolean, a string or a finite number.
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.find import condition


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(?P<num>-?\d+(?:\.\d+)?(?!\w))|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<op><=|>=|!=|==|->|\.\.|[-{}\[\]():,.<>=*+/])|(?P<par>\$[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*))")
_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COLLECT": F.collect_list}
_OPERATORS = frozenset({"$gt", "$gte", "$lt", "$lte", "$eq", "$ne", "$in", "$all", "$exists", "$or", "$and"})


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        out.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, given: dict[str, Any]):
        self.t, self.i, self.given, self.used = _tokens(text), 0, given, set()
        for k, v in given.items():
            if not (v is None or isinstance(v, (bool, str)) or (isinstance(v, (int, float)) and math.isfinite(v))):
                raise QueryError(f"parameter {k} must be null, a boolean, a string or a finite number")

    def peek(self, *words: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][1].upper() in words and self.t[self.i][0] != "str"

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise QueryError(f"expected {word}, found {self.t[self.i][1] if self.i < len(self.t) else 'the end'}")

    def name(self) -> str:
        if self.i < len(self.t) and self.t[self.i][0] == "word":
            self.i += 1
            return self.t[self.i - 1][1]
        raise QueryError("a name was expected")

    def value(self) -> Any:
        if self.i >= len(self.t):
            raise QueryError("a value was expected")
        kind, s = self.t[self.i]
        self.i += 1
        if kind == "num":
            return float(s) if "." in s else int(s)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", s[1:-1])
        if kind == "par":
            if s in _OPERATORS or s[1:] not in self.given:
                raise QueryError(f"missing parameter {s}")
            self.used.add(s[1:])
            return self.given[s[1:]]
        if kind == "word" and s.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[s.lower()]
        if s == "[":
            items = []
            while not self.take("]"):
                items.append(self.value())
                if not self.peek("]"):
                    self.need(",")
            return items
        if s == "{":
            self.i -= 1
            return self.document()
        raise QueryError(f"a value was expected, found {s}")

    def document(self) -> dict:
        self.need("{")
        out: dict[str, Any] = {}
        while not self.take("}"):
            if self.i >= len(self.t):
                raise QueryError("an open {")
            kind, key = self.t[self.i]
            if kind not in ("word", "par", "str"):
                raise QueryError(f"a field was expected, found {key}")
            self.i += 1
            self.need(":")
            out[key.strip("\"'")] = self.value()
            if not self.peek("}"):
                self.need(",")
        return out

    def path(self) -> str:
        first = self.name()
        return f"{first}.{self.name()}" if self.take(".") else first

    def expression(self, column) -> Column:
        def atom() -> Column:
            if self.take("("):
                c = self.expression(column)
                self.need(")")
                return c
            if self.t[self.i : self.i + 1] and self.t[self.i][0] == "word" and self.t[self.i][1].lower() not in ("true", "false", "null"):
                return column(self.path())
            return F.lit(self.value())

        left = atom()
        while self.peek("+", "-", "*", "/"):
            op = self.t[self.i][1]
            self.i += 1
            right = atom()
            left = left + right if op == "+" else left - right if op == "-" else left * right if op == "*" else left / right
        return left

    def predicate(self, column) -> Column:
        def one() -> Column:
            if self.take("NOT"):
                return ~one()
            left = self.expression(column)
            for op, f in (("<=", Column.__le__), (">=", Column.__ge__), ("==", Column.__eq__), ("=", Column.__eq__), ("!=", Column.__ne__), ("<", Column.__lt__), (">", Column.__gt__)):
                if self.take(op):
                    return f(left, self.expression(column))
            raise QueryError("a comparison was expected")

        def both() -> Column:
            c = one()
            while self.take("AND"):
                c = c & one()
            return c

        c = both()
        while self.take("OR"):
            c = c | both()
        return c

    def finish(self, df: DataFrame, column) -> DataFrame:
        """RETURN, ORDER BY, LIMIT and OFFSET."""
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        picked: list[Column] = []
        names: dict[str, str] = {}  # as written, as returned
        grouped = False
        if not self.take("*"):
            while True:
                word = self.t[self.i][1].upper() if self.i < len(self.t) else ""
                if word in _AGGREGATES and self.i + 1 < len(self.t) and self.t[self.i + 1][1] == "(":
                    self.i += 2
                    arg = F.lit(1) if self.take("*") else self.expression(column)
                    self.need(")")
                    c, default, grouped = _AGGREGATES[word](arg), word.lower(), True
                else:
                    at = self.i
                    c = self.expression(column)
                    default = "_".join(x for k, x in self.t[at : self.i] if k in ("word", "num")) or "value"
                alias = self.name() if self.take("AS") else default
                names |= {default: alias, alias: alias}
                picked.append(c.alias(alias))
                if not self.take(","):
                    break
        orders = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                at = self.i
                text = "_".join(self.t[j][1] for j in range(at, len(self.t)) if self.t[j][0] == "word" and all(self.t[k][1] not in (",",) and self.t[k][1].upper() not in ("DESC", "ASC", "LIMIT", "OFFSET") for k in range(at, j + 1)))
                if (distinct or grouped) and picked:  # what is returned is sorted, so it must be among it
                    if text not in names:
                        raise QueryError(f"{text} is not returned")
                    while not self.peek("DESC", "ASC", ",", "LIMIT", "OFFSET") and self.i < len(self.t):
                        self.i += 1
                    c = F.col(f"`{names[text]}`")
                else:
                    c = self.expression(column)
                orders.append(F.desc_nulls_first(c) if self.take("DESC") else c.asc())
                self.take("ASC")
                if not self.take(","):
                    break
        n = self.value() if self.take("LIMIT") else None
        skip = self.value() if self.take("OFFSET") else 0
        if self.i != len(self.t):
            raise QueryError(f"unexpected {self.t[self.i][1]}")
        if spare := set(self.given) - self.used:
            raise QueryError(f"unknown parameters {sorted(spare)}")
        if n is not None and (not isinstance(n, int) or n < 0) or not isinstance(skip, int) or skip < 0:
            raise QueryError("LIMIT and OFFSET take whole numbers")
        first = picked and (distinct or grouped)
        if first:
            df = df.agg(*picked) if grouped else df.select(*picked)
        if distinct:
            df = df.distinct()
        if orders:
            df = df.orderBy(*orders)
        if skip:
            df = df.offset(skip)
        if n is not None:
            df = df.limit(n)
        return df.select(*picked) if picked and not first else df


def query(text: str, nodes: DataFrame, edges: DataFrame | None = None, given: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a query over nodes (id, fields) and edges (src, dst, label, weight)."""
    p = _Parser(text, given or {})
    if p.take("FIND"):
        spec = p.document() if p.peek("{") else {}
        try:
            found = nodes.where(condition(spec, nodes.columns))
        except ValueError as e:
            raise QueryError(str(e)) from e

        def column(path: str) -> Column:
            if path not in nodes.columns:
                raise QueryError(f"no field {path}")
            return F.col(path)

        return p.finish(found, column)
    if p.take("MATCH"):
        if edges is None:
            raise QueryError("there are no edges")

        def end() -> str:
            p.need("(")
            v = p.name()
            p.need(")")
            return v

        a, label, low, high = end(), None, 1, 1
        p.need("-")
        p.need("[")
        if p.take(":"):
            label = p.name()
        if p.take("*"):
            low = p.value()
            p.need("..")
            high = p.value()
        p.need("]")
        p.need("->")
        b = end()
        if not (isinstance(low, int) and isinstance(high, int) and 1 <= low <= high <= 10) or a == b:
            raise QueryError("paths take two names and 1 to 10 hops")
        e = edges.select(F.col("src"), F.col("dst")) if label is None else edges.where(F.col("label") == label).select("src", "dst")
        e = e.distinct()
        walk, found = e, e if low == 1 else None
        for hop in range(2, high + 1):
            walk = walk.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("_end")), "dst").select("src", F.col("_end").alias("dst")).distinct()
            if hop >= low:
                found = walk if found is None else found.union(walk).distinct()
        left = nodes.select(*[F.col(c).alias(f"{a}.{c}") for c in nodes.columns])
        right = nodes.select(*[F.col(c).alias(f"{b}.{c}") for c in nodes.columns])
        rows = found.join(left, F.col("src") == F.col(f"`{a}.id`")).join(right, F.col("dst") == F.col(f"`{b}.id`"))

        def column(path: str) -> Column:
            if path not in rows.columns:
                raise QueryError(f"no field {path}")
            return F.col(f"`{path}`")

        if p.take("WHERE"):
            rows = rows.where(p.predicate(column))
        return p.finish(rows, column)
    raise QueryError("a query begins with FIND or MATCH")


def explain(text: str, nodes: DataFrame, edges: DataFrame | None = None, given: dict[str, Any] | None = None) -> str:
    """The physical plan of a query, as Spark prints it."""
    df = query(text, nodes, edges, given)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
