"""A property graph as DataFrames: a typed table for each kind of entity, and a table of edges.

A kind's own fields are columns, so that filters and projections reach its Parquet scan; fields that have no
column can stand in `fields`, a map of packed values.  A null column is a missing field; an explicit null can only
stand in the map.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import VALUE, Value
from graphloom.plans.request import Filter

META = {"source": "string", "external_id": "string", "confidence": "double", "source_priority": "double", "created_at": "string", "updated_at": "string"}
FIELDS = T.MapType(T.StringType(), VALUE)


@dataclass(frozen=True)
class RelationType:
    name: str
    from_kinds: tuple[str, ...] = ()
    to_kinds: tuple[str, ...] = ()
    cardinality: str = "many_to_many"
    impact_direction: str = "none"
    allow_cross_kind: bool = False
    reverse_name: str = ""


# The relations that every graph has.
BUILT_IN = {
    r.name: r
    for r in (
        RelationType("contains", impact_direction="reverse", allow_cross_kind=True),
        RelationType("runs_on", impact_direction="forward", allow_cross_kind=True),
        RelationType("depends_on", impact_direction="forward", allow_cross_kind=True),
        RelationType("owned_by", allow_cross_kind=True),
        RelationType("connects_to", impact_direction="both", allow_cross_kind=True),
    )
}


def whole(text: str) -> int | None:
    """The number that a text is the decimal form of."""
    return int(text) if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text) else None


def edge_id(type_: Column, src: Column, dst: Column) -> Column:
    """An edge's identity is its relation and its ends."""
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\0", type_, src, dst), 256), 1, 32))


def entity_id(kind: Column, source: Column, external_id: Column) -> Column:
    return F.concat(F.lit("entity:"), F.substring(F.sha2(F.concat_ws("\0", kind, source, external_id), 256), 1, 32))


@dataclass(frozen=True)
class Table:
    """Entities of one kind, or edges: id, any of META, own columns, perhaps labels, identity and fields."""

    df: DataFrame
    edges: bool = False
    #: Ids are this and a whole number, which stands in the column __key, so that a scan can be pruned by it.
    prefix: str = ""

    def with_ids(self, ids: list[str]) -> DataFrame | None:
        """The rows with some ids, or None if no id can be one of this table."""
        if not self.prefix:
            return self.df.where(F.col("id").isin(ids)) if ids else None
        keys = [k for i in ids if i.startswith(self.prefix) and (k := whole(i[len(self.prefix) :])) is not None]
        return self.df.where(F.col("__key").isin(keys)) if keys else None

    def _column(self, name: str, always: bool = False) -> Value:
        return Value.of(F.col(f"`{name}`"), self.df.schema[name].dataType, always)

    def _own(self, name: str) -> Value:
        reserved = {"id", "kind", "type", "src", "dst", "src_kind", "src_key", "dst_kind", "dst_key", "__key", "owner", "aliases", "fields", "identity", "labels", "sources", *META}
        if name in self.df.columns and name not in reserved:
            return self._column(name)
        if f"field_{name}" in self.df.columns:  # a field named like a column of the graph
            return self._column(f"field_{name}")
        if "fields" in self.df.columns:
            return Value.of(F.col("fields")[name], VALUE)
        return Value.missing()

    def value(self, name: str) -> Value:
        """What a field reference means here."""
        if name in ("", "id"):
            return self._column("id", True)
        if self.edges:
            name_of = {"type": "type", "relation_type": "type", "from": "src", "to": "dst"}
            if name in name_of:
                return self._column(name_of[name], True)
        elif name == "kind":
            return self._column("kind", True)
        if name in META:
            return self._column(name, True) if name in self.df.columns else Value.of(F.lit("" if META[name] == "string" else 0.0), T.StringType() if META[name] == "string" else T.DoubleType(), True)
        if name.startswith("fields."):
            return self._own(name[7:]) if name[7:] else Value.missing()
        if name.startswith("identity.") and not self.edges:
            if "identity" in self.df.columns and name[9:]:
                return Value.of(F.col("identity")[name[9:]], VALUE if self.df.schema["identity"].dataType == FIELDS else T.StringType())
            return Value.missing()
        if name == "labels" and not self.edges and "labels" in self.df.columns:
            own = self._column("labels")
            legacy = self._own("labels")
            return own if legacy.kind == "null" else _either(own, legacy)
        return self._own(name)

    def condition(self, tree) -> Column:
        """A boolean tree of filters as column that is never null."""
        if tree is None:
            return F.lit(True)
        if isinstance(tree, Filter):
            return self.leaf(tree)
        op, parts = tree
        if op == "not":
            return ~self.condition(parts[0])
        return reduce(Column.__and__ if op == "and" else Column.__or__, map(self.condition, parts))

    def leaf(self, f: Filter) -> Column:
        return holds(self.value(f.field), f)

    def where(self, tree) -> DataFrame:
        if tree is None:
            return self.df
        df = self.df
        for f in tree[1] if isinstance(tree, tuple) and tree[0] == "and" else [tree]:
            if self.prefix and isinstance(f, Filter) and f.field == "id" and f.op in ("eq", "in"):  # the scan is pruned by the key
                found = self.with_ids([x for x in (f.value if f.op == "in" else [f.value]) if isinstance(x, str)])
                return df.where(F.lit(False)) if found is None else found.where(self.condition(tree))
        return df.where(self.condition(tree))


def holds(v: Value, f: Filter) -> Column:
    if f.op == "exists":
        return v.exists if f.value is None or f.value else ~v.exists
    if f.op == "eq":
        return v.equals(f.value)
    if f.op == "neq":
        return v.exists & ~v.equals(f.value)
    if f.op == "in":
        if v.kind == "string" and f.value and all(isinstance(x, str) for x in f.value):
            return F.coalesce(v.s.isin(f.value), F.lit(False)) & v.exists
        if v.kind == "number" and f.value and all(isinstance(x, int | float) and not isinstance(x, bool) for x in f.value):
            return F.coalesce(v.n.isin([float(x) for x in f.value]), F.lit(False))
        return reduce(Column.__or__, (v.equals(x) for x in f.value), F.lit(False))
    if f.op == "prefix":
        from graphloom.functions.values import python_text

        text = v.s if v.kind == "string" else v.text()
        return F.coalesce(v.exists & text.startswith(python_text(f.value)), F.lit(False))
    if f.op == "contains":
        return v.member(f.value)
    if f.op == "fuzzy":
        return v.fuzzy(f.value)
    return v.compared(f.op, f.value)


def _either(a: Value, b: Value) -> Value:
    return Value.of(F.coalesce(a.packed(), b.packed()), VALUE)


@dataclass(frozen=True)
class Graph:
    """One version of one tenant's graph."""

    spark: SparkSession
    kinds: dict[str, Table]
    edges: Table
    relations: dict[str, RelationType] = field(default_factory=lambda: dict(BUILT_IN))
    version: int = 1
    #: All edges are known to end at entities (checked when they were written).
    checked: bool = True

    @classmethod
    def of(cls, spark: SparkSession, kinds: dict[str, DataFrame], edges: DataFrame, relations: dict[str, RelationType] | None = None, **more) -> Graph:
        """kinds: id and fields of each kind; __key where the id is the kind, a colon and that number.  edges: type, src, dst and
        fields; src_kind, src_key, dst_kind and dst_key where ends are such ids; the edges' own ids are set here."""
        tables = {}
        for kind, df in kinds.items():
            tables[kind] = Table(df.withColumn("kind", F.lit(kind)), prefix=f"{kind}:" if "__key" in df.columns else "")
        return cls(spark, tables, Table(edges.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst"))), True), {**BUILT_IN, **(relations or {})}, **more)

    def tables(self, kinds: tuple[str, ...] | None = None) -> dict[str, Table]:
        return {k: t for k, t in self.kinds.items() if not kinds or k in kinds}

    def nodes(self, kinds: tuple[str, ...] = (), where=None, fields: tuple[str, ...] = ()) -> DataFrame:
        """id, kind and the packed values v0, v1, ... of fields of all entities of the kinds; each kind filters its own table."""
        parts = [t.where(where).select("id", "kind", *(t.value(f).packed().alias(f"v{i}") for i, f in enumerate(fields))) for t in self.tables(kinds or None).values()]
        if not parts:
            empty = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), *(T.StructField(f"v{i}", VALUE) for i in range(len(fields)))])
            return self.spark.createDataFrame([], empty)
        return reduce(DataFrame.unionByName, parts)

    def entity(self, id_: str) -> dict | None:
        """One entity with all its fields."""
        for kind, t in self.kinds.items():
            df = t.with_ids([id_])
            if df is not None and (row := df.head()):
                return {"id": id_, "kind": kind, "fields": entity_fields(row.asDict())}
        return None

    def has(self, id_: str) -> bool:
        parts = [df.select("id") for t in self.kinds.values() if (df := t.with_ids([id_])) is not None]
        return bool(parts) and bool(reduce(DataFrame.unionByName, parts).head(1))

    def at(self, end: str, id_: str) -> Column:
        """The condition that an edge's end (src or dst) is an entity; by the end's kind and key where edges have them."""
        test = F.col(end) == id_
        if f"{end}_kind" in self.edges.df.columns:
            kind, _, key = id_.partition(":")
            number = whole(key)
            test = test & (F.col(f"{end}_kind") == kind) & (F.lit(False) if number is None else F.col(f"{end}_key") == number)
        return test

    def with_version(self, version: int) -> Graph:
        return replace(self, version=version)


def entity_fields(row: dict) -> dict:
    """The fields of a row of a table as Python values."""
    from graphloom.functions.values import unpacked_python

    skip = {"id", "kind", "type", "src", "dst", "src_kind", "src_key", "dst_kind", "dst_key", "__key", "owner", "aliases", "identity", "fields", "sources", *META}
    out = {k.removeprefix("field_"): v for k, v in row.items() if k not in skip and v is not None}
    for k, v in (row.get("fields") or {}).items():
        if v is not None:
            out[k] = unpacked_python(v.asDict() if hasattr(v, "asDict") else v)
    return out
