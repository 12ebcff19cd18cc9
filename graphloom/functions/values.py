"""Dynamic values as columns: presence, comparison and text of fields whose type may differ from row to row.

A value is null, string, bool, number (double) or raw (JSON of an array or object).  All predicates are
two-valued: a missing field makes every one of them false.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIL = "<nil>"
VALUE = T.StructType([T.StructField(n, t) for n, t in (("k", T.StringType()), ("s", T.StringType()), ("n", T.DoubleType()), ("b", T.BooleanType()), ("j", T.StringType()))])


def number_text(x: Column) -> Column:
    """A double as shortest decimal text; an exponent form below 1e-4 and from 1e6 on."""
    text = F.abs(x).cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    whole = F.abs(x).cast("decimal(20,0)").cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0$", ""), r"\.", "")
    million = F.concat(F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 32)), r"\.?0*$", ""), F.lit("e+06"))
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?\d+)", 1)
    sized = F.lpad(F.regexp_replace(power, "-", ""), 2, "0")
    sized = F.when(F.length(F.regexp_replace(power, "-", "")) > 2, F.regexp_replace(power, "-", "")).otherwise(sized)
    exponent = F.concat(mantissa, F.lit("e"), F.when(power.startswith("-"), "-").otherwise("+"), sized)
    small = F.concat(F.lit("0.000"), F.regexp_replace(mantissa, r"\.", ""))
    a = F.abs(x)
    return F.when(x.isNull(), NIL).otherwise(
        F.concat(
            sign,
            F.when((a < 1e6) & (a == F.floor(a)), whole).when((a >= 1e-3) & (a < 1e6), text).when((a >= 1e-4) & (a < 1e-3), small).when((a >= 1e6) & (a < 1e7), million).otherwise(exponent),
        )
    )


def python_text(v: Any) -> str:
    """The text of a literal, as number_text and the like give it."""
    if v is None:
        return NIL
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        x = float(v)
        if x == int(x) and abs(x) < 1e6:
            return str(int(x))
        if 1e-4 <= abs(x) < 1e6:
            return _plain(repr(x))
        m, e = _scientific(x)
        return f"{m}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if isinstance(v, list):
        return "[" + " ".join(map(python_text, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{python_text(v[k])}" for k in sorted(v)) + "]"
    return str(v)


def _plain(text: str) -> str:
    if "e" not in text:
        return text
    m, e = text.split("e")
    digits = m.replace(".", "").lstrip("-")
    return ("-" if m[0] == "-" else "") + "0." + "0" * (-int(e) - 1) + digits


def _scientific(x: float) -> tuple[str, int]:
    for p in range(17):
        text = f"{x:.{p}e}"
        if float(text) == x:
            break
    m, e = text.split("e")
    return m, int(e)


@dataclass
class Value:
    """A field as columns.  kind is its type where it is the same in all rows, else None and `k` holds it."""

    exists: Column
    kind: str | None
    k: Column
    s: Column | None = None
    n: Column | None = None
    b: Column | None = None
    j: Column | None = None
    items: Column | None = None  # array of strings, if raw is one

    @classmethod
    def missing(cls) -> Value:
        return cls(F.lit(False), "null", F.lit(None).cast("string"))

    @classmethod
    def of(cls, column: Column, type_: T.DataType, always: bool = False) -> Value:
        """A typed column; null is missing (or the empty value, if always)."""
        there = F.lit(True) if always else column.isNotNull()
        if isinstance(type_, T.StringType):
            return cls(there, "string", F.lit("string"), s=F.coalesce(column, F.lit("")) if always else column)
        if isinstance(type_, T.NumericType):
            return cls(there, "number", F.lit("number"), n=F.coalesce(column.cast("double"), F.lit(0.0)) if always else column.cast("double"))
        if isinstance(type_, T.BooleanType):
            return cls(there, "bool", F.lit("bool"), b=column)
        if isinstance(type_, T.TimestampType | T.TimestampNTZType | T.DateType):
            return cls(there, "string", F.lit("string"), s=F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        if isinstance(type_, T.ArrayType) and isinstance(type_.elementType, T.StringType):
            return cls(there, "raw", F.lit("raw"), j=F.to_json(column), items=column)
        if type_ == VALUE:
            return cls(there, None, column["k"], column["s"], column["n"], column["b"], column["j"])
        return cls(there, "raw", F.lit("raw"), j=F.to_json(column))

    def text(self) -> Column:
        """The text that prefix, contains and mixed comparisons see; missing and null are <nil>."""
        raw = self._raw_text()
        by_kind = {"string": self.s, "number": number_text(self.n) if self.n is not None else None, "bool": self.b.cast("string") if self.b is not None else None, "raw": raw, "null": F.lit(NIL)}
        if self.kind:
            return F.coalesce(by_kind[self.kind], F.lit(NIL))
        out = F.when(self.k == "string", self.s).when(self.k == "number", by_kind["number"]).when(self.k == "bool", by_kind["bool"]).when(self.k == "raw", raw)
        return F.coalesce(out, F.lit(NIL))

    def _raw_text(self) -> Column | None:
        if self.items is not None:
            return F.concat(F.lit("["), F.array_join(self.items, " "), F.lit("]"))
        if self.j is None:
            return None
        array = F.concat(F.lit("["), F.array_join(F.from_json(self.j, "array<string>"), " "), F.lit("]"))
        entries = F.array_sort(F.map_entries(F.from_json(self.j, "map<string,string>")))
        object_ = F.concat(F.lit("map["), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " "), F.lit("]"))
        return F.when(self.j.startswith("["), array).otherwise(object_)

    def is_kind(self, kind: str) -> Column:
        return F.lit(self.kind == kind) if self.kind else self.k == kind

    def equals(self, v: Any) -> Column:
        """Equal, with no change between types; numbers by value."""
        if v is None:
            test = self.is_kind("null")
        elif isinstance(v, bool):
            test = (self.b == v) if self.b is not None else F.lit(False)
        elif isinstance(v, int | float):
            test = (self.n == float(v)) if self.n is not None else F.lit(False)
        elif isinstance(v, str):
            test = (self.s == v) if self.s is not None else F.lit(False)
        else:
            test = (self.j == json.dumps(v, separators=(",", ":"), ensure_ascii=False)) if self.j is not None else F.lit(False)
        return _sure(self.exists & test)

    def compared(self, op: str, v: Any) -> Column:
        """gt, gte, lt, lte: numbers by value, all else by text."""
        tests = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
        test = tests[op]
        numeric = isinstance(v, int | float) and not isinstance(v, bool)
        if numeric and self.kind == "number":
            return _sure(test(self.n, F.lit(float(v))))
        by_text = test(self.text(), F.lit(python_text(v)))
        if numeric and self.kind is None and self.n is not None:
            return _sure(self.exists & F.when(self.k == "number", test(self.n, F.lit(float(v)))).otherwise(by_text))
        if isinstance(v, str) and self.kind == "string":
            return _sure(test(self.s, F.lit(v)))
        return _sure(self.exists & by_text)

    def member(self, v: Any) -> Column:
        """contains: an item of an array; else part of the text, whatever its case."""
        part = F.contains(F.lower(self.text()), F.lit(python_text(v).lower()))
        if self.items is not None:
            return _sure(self.exists & (F.array_contains(self.items, v) if isinstance(v, str) else F.lit(False)))
        if self.kind in ("string", "number", "bool", "null"):
            return _sure(self.exists & part)
        items = F.from_json(self.j, "array<string>")
        if isinstance(v, int | float) and not isinstance(v, bool):
            hit = F.exists(items, lambda x: F.coalesce(x.try_cast("double") == float(v), F.lit(False)))
        else:
            hit = F.array_contains(items, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False))
        return _sure(self.exists & F.when((self.k == "raw") & self.j.startswith("["), hit).otherwise(part))

    def fuzzy(self, v: Any) -> Column:
        """The pattern's characters occur in this order, whatever their case."""
        # Before each character stand only others, so a text is read once whether it matches or not.
        pattern = "(?s)^" + "".join(f"[^{_in_class(c)}]*+{re.escape(c)}" for c in python_text(v).lower())
        return _sure(self.exists & F.lower(self.text()).rlike(pattern))

    def packed(self) -> Column:
        """One struct, null if missing."""
        none = {"s": "string", "n": "double", "b": "boolean", "j": "string"}
        parts = [self.k.alias("k"), *((c if c is not None else F.lit(None).cast(t)).cast(t).alias(f) for f, t in none.items() for c in (getattr(self, f),))]
        return F.when(self.exists, F.struct(*parts))

    def sort_keys(self, desc: bool) -> list[Column]:
        """Numbers by value, before null and missing (whose text is <nil>), which stand among texts."""
        if self.kind == "number":
            return [self.n.desc_nulls_first() if desc else self.n.asc_nulls_last()]
        keys = [self.text()] if self.kind else [F.when(self.k == "number", self.n), F.when(F.coalesce(self.k != "number", F.lit(True)), self.text())]
        if len(keys) == 1:
            return [keys[0].desc() if desc else keys[0].asc()]
        return [keys[0].desc_nulls_first() if desc else keys[0].asc_nulls_last(), keys[1].desc() if desc else keys[1].asc()]


def _in_class(c: str) -> str:
    """A character within the brackets of a Java pattern."""
    return f"\\{c}" if c in "\\[]^-&~|" else c


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def literal(v: Any) -> Column:
    """A Python value as packed struct."""
    kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "raw"
    parts = {"k": kind, "s": v if kind == "string" else None, "n": float(v) if kind == "number" else None, "b": v if kind == "bool" else None, "j": json.dumps(v, separators=(",", ":"), ensure_ascii=False) if kind == "raw" else None}
    return F.struct(*(F.lit(parts[f.name]).cast(f.dataType).alias(f.name) for f in VALUE))


def packed_python(v: Any) -> dict[str, Any]:
    kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "raw"
    return {"k": kind, "s": v if kind == "string" else None, "n": float(v) if kind == "number" else None, "b": v if kind == "bool" else None, "j": json.dumps(v, separators=(",", ":"), ensure_ascii=False) if kind == "raw" else None}


def unpacked_python(v: Any) -> Any:
    if v is None or v["k"] in (None, "null"):
        return None
    return json.loads(v["j"]) if v["k"] == "raw" else v[{"string": "s", "number": "n", "bool": "b"}[v["k"]]]
