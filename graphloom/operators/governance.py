"""Changes to a graph as DataFrame operations: upserts by source priority, stale marks, deletes, merges, splits and checks.

A state holds all entities in one table and all edges in another; each operation returns a new state.  A field's value is
a maximum over its writes, combined before the shuffle; only fields whose arrays are united are folded write by write, and
suppressed writes are found by a running maximum, where they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import VALUE, packed_python
from graphloom.operators.paths import written
from graphloom.plans.request import InvalidQuery, LimitExceeded
from graphloom.sources.graph import BUILT_IN, FIELDS, Graph, RelationType, Table, edge_id, entity_id

OWNER = "struct<source:string,priority:double,confidence:double>"
SOURCE = "struct<source:string,external_id:string,confidence:double,priority:double,stale:boolean>"
_COMMON = f"source string, external_id string, confidence double, source_priority double, owners map<string,{OWNER}>, sources array<{SOURCE}>"


def _schema(head: str) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(f"{head}, {_COMMON}").fields, T.StructField("fields", FIELDS)])


@dataclass(frozen=True)
class EntityType:
    name: str
    extends: tuple[str, ...] = ()
    #: name: {type, merge_strategy, required, unique, enum, default}
    fields: dict[str, dict[str, Any]] = field(default_factory=dict)
    #: name: (fields, least confidence, "merge" or "reject")
    identity_keys: dict[str, tuple[tuple[str, ...], float, str]] = field(default_factory=dict)


def effective_fields(types: dict[str, EntityType], kind: str, seen: tuple[str, ...] = ()) -> dict[str, dict[str, Any]]:
    """A kind's fields and its parents', in the order of extends; a child's own go first."""
    if kind in seen:
        raise InvalidQuery(f"entity types extend each other: {' > '.join([*seen, kind])}")
    if kind not in types:
        return {}
    out: dict[str, dict[str, Any]] = {}
    for parent in types[kind].extends:
        out |= effective_fields(types, parent, (*seen, kind))
    return out | types[kind].fields


def entity_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Entities given as Python mappings, in the order of the writes (column seq)."""
    rows = []
    for i, e in enumerate(items):
        own = {k.removesuffix("!"): packed_python(v) for k, v in (e.get("fields") or {}).items()}
        if e.get("labels"):
            own["labels"] = packed_python(sorted(set(e["labels"])))
        rows.append((i, e.get("id"), e["kind"], e.get("source") or "", e.get("external_id") or "", float(e.get("confidence") or 0), float(e.get("source_priority") or 0), own, [k.removesuffix("!") for k in e.get("fields") or {} if k.endswith("!")]))
    head = T._parse_datatype_string("seq long, id string, kind string, source string, external_id string, confidence double, source_priority double")
    return spark.createDataFrame(rows, T.StructType([*head.fields, T.StructField("fields", FIELDS), T.StructField("replaced", T.ArrayType(T.StringType()))]))


def edge_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    rows = [(i, e["type"], e["from"], e["to"], e.get("source") or "", e.get("external_id") or "", float(e.get("confidence") or 0), float(e.get("source_priority") or 0), {k: packed_python(v) for k, v in (e.get("fields") or {}).items()}) for i, e in enumerate(items)]
    head = T._parse_datatype_string("seq long, type string, src string, dst string, source string, external_id string, confidence double, source_priority double")
    return spark.createDataFrame(rows, T.StructType([*head.fields, T.StructField("fields", FIELDS)]))


def empty_value(v: Column) -> Column:
    return v.isNull() | (v["k"] == "null") | F.coalesce((v["k"] == "string") & (v["s"] == ""), F.lit(False))


_ITEM = r'("(?:[^"\\]|\\.)*"|[^\s,\[\]]+)'


def _union_arrays(a: Column, b: Column) -> Column:
    """JSON arrays of scalars: a, and what b has besides."""
    one, two = (F.regexp_extract_all(x, F.lit(_ITEM), F.lit(1)) for x in (a, b))
    return F.concat(F.lit("["), F.array_join(F.concat(one, F.array_except(two, one)), ","), F.lit("]"))


def fold_fields(writes: DataFrame, *keys: str) -> DataFrame:
    """keys, field, value, owner, lost of writes (keys, field, seq, value, source, priority, confidence, append).

    In the order of seq a write wins over a missing or empty value, or if its (priority, confidence) is no less; an
    empty value never wins.  Where append is set, arrays are united.  lost: the seq of writes that changed nothing."""
    step_type = T.StructType([T.StructField("value", VALUE), T.StructField("source", T.StringType()), T.StructField("priority", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("lost", T.ArrayType(T.LongType()))])
    zero = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in step_type.fields[:-1]), F.array().cast("array<bigint>").alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        free = empty_value(acc["value"])
        ranks = (x["priority"] > acc["priority"]) | ((x["priority"] == acc["priority"]) & (x["confidence"] >= acc["confidence"]))
        wins = free | (~empty_value(x["value"]) & F.coalesce(ranks, F.lit(False)))
        arrays = x["append"] & ~free & F.coalesce((acc["value"]["k"] == "raw") & (x["value"]["k"] == "raw") & acc["value"]["j"].startswith("[") & x["value"]["j"].startswith("["), F.lit(False))
        united = F.struct(F.lit("raw").alias("k"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), _union_arrays(acc["value"]["j"], x["value"]["j"]).alias("j"))
        better = F.coalesce((x["priority"] > acc["priority"]) | ((x["priority"] == acc["priority"]) & (x["confidence"] > acc["confidence"])), F.lit(True))
        take = F.when(arrays, better).otherwise(wins)
        same = acc["value"].eqNullSafe(x["value"])
        return F.struct(
            F.when(arrays, united).when(wins, x["value"]).otherwise(acc["value"]).alias("value"),
            *(F.when(take, x[c]).otherwise(acc[c]).alias(c) for c in ("source", "priority", "confidence")),
            F.when(wins | arrays | same, acc["lost"]).otherwise(F.concat(acc["lost"], F.array(x["seq"]))).alias("lost"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("seq", "value", "source", "priority", "confidence", "append")))
    folded = writes.groupBy(*keys, "field").agg(ordered.alias("w")).withColumn("r", F.aggregate("w", zero, step))
    return folded.select(*keys, "field", F.col("r.value").alias("value"), F.struct(F.col("r.source"), F.col("r.priority"), F.col("r.confidence")).cast(OWNER).alias("owner"), F.col("r.lost").alias("lost"), "w")


def _writes(df: DataFrame, keys: tuple[str, ...], append: Column) -> DataFrame:
    """The fields of rows as writes; rows of a state (seq -1) write as the owners of their fields.

    united: the field's values are to be united; append: this write is, and doesn't replace."""
    rows = df.select(*keys, "seq", "source", "source_priority", "confidence", "owners", "replaced", F.explode("fields").alias("field", "value"))
    owner = F.col("owners")[F.col("field")]
    return rows.select(
        *keys, "seq", "field", "value", F.coalesce(owner["source"], "source").alias("source"), F.coalesce(owner["priority"], "source_priority").alias("priority"),
        F.coalesce(owner["confidence"], "confidence").alias("confidence"), append.alias("united"), (append & ~F.coalesce(F.array_contains("replaced", F.col("field")), F.lit(False))).alias("append"),
    )


def _rank() -> Column:
    """Orders writes: the last of the highest in priority, then confidence, among those with a value; without any, the last."""
    full = ~empty_value(F.col("value"))
    return F.struct(full.alias("full"), F.when(full, F.col("priority")).alias("priority"), F.when(full, F.col("confidence")).alias("confidence"), F.col("seq"))


def _owner(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}source"), F.col(f"{prefix}priority"), F.col(f"{prefix}confidence")).cast(OWNER)


def best_writes(writes: DataFrame, *keys: str) -> DataFrame:
    """keys, field, value, owner of writes: the same as folding them in order, but as a maximum, which is combined before the shuffle."""
    won = F.max_by(F.struct("value", "source", "priority", "confidence"), _rank()).alias("x")
    return writes.groupBy(*keys, "field").agg(won).select(*keys, "field", F.col("x.value").alias("value"), _owner("x.").alias("owner"))


def lost_writes(writes: DataFrame, *keys: str) -> DataFrame:
    """keys, field and the sources and priorities of writes that changed nothing, and of the field's owner in the end."""
    group = [*keys, "field"]
    order = Window.partitionBy(*group).orderBy("seq")
    state = F.struct(_rank().alias("rank"), "value", "source", "priority")
    before = F.max(state).over(order.rowsBetween(Window.unboundedPreceding, -1))
    final = F.max(state).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = writes.withColumns({"before": before, "final": final, "rank": _rank()})
    lower = (F.col("rank.priority") < F.col("before.rank.priority")) | ((F.col("rank.priority") == F.col("before.rank.priority")) & (F.col("rank.confidence") < F.col("before.rank.confidence")))
    lost = F.coalesce(F.col("before.rank.full"), F.lit(False)) & (~F.col("rank.full") | lower) & ~F.col("value").eqNullSafe(F.col("before.value"))
    return rows.where(lost).select(*group, F.col("final.source").alias("existing_source"), F.col("final.priority").alias("existing_priority"), F.col("source").alias("incoming_source"), F.col("priority").alias("incoming_priority"))


def _merged(all_rows: DataFrame, keys: tuple[str, ...], append: Column | None) -> tuple[DataFrame, DataFrame]:
    """Rows of a state and writes to it (seq from 0) as one row for each key, and the writes that were suppressed.

    append: which fields are united (None: none); only these are folded write by write."""
    writes = _writes(all_rows, keys, F.lit(False) if append is None else append)
    plain = writes if append is None else writes.where("not united")
    folded, conflicts = best_writes(plain, *keys), lost_writes(plain, *keys)
    if append is not None:
        united = fold_fields(writes.where("united"), *keys)
        folded = folded.unionByName(united.select(*keys, "field", "value", "owner"))
        lost = united.where(F.size("lost") > 0).select(*keys, "field", F.explode("lost").alias("seq"), F.col("owner.source").alias("existing_source"), F.col("owner.priority").alias("existing_priority"), "w")
        lost = lost.select(*keys, "field", "existing_source", "existing_priority", F.filter("w", lambda x: x["seq"] == F.col("seq"))[0].alias("x"))
        conflicts = conflicts.unionByName(lost.select(*keys, "field", "existing_source", "existing_priority", F.col("x.source").alias("incoming_source"), F.col("x.priority").alias("incoming_priority")))
    values = folded.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"), F.map_from_entries(F.collect_list(F.struct("field", "owner"))).alias("owners"))
    first_text = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    own = F.array(F.struct(F.col("source"), F.col("external_id"), F.col("confidence"), F.col("source_priority").alias("priority"), F.lit(False).alias("stale")).cast(SOURCE))
    listed = F.when(F.col("sources").isNotNull(), F.coalesce("sources", F.array().cast(f"array<{SOURCE}>"))).when(F.col("source") != "", own).otherwise(F.array().cast(f"array<{SOURCE}>"))
    meta = all_rows.groupBy(*keys).agg(
        first_text("source"), first_text("external_id"), F.max("confidence").alias("confidence"), F.max("source_priority").alias("source_priority"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", listed.alias("x")))), lambda s: s["x"])).alias("all_sources"),
    )
    sources = F.aggregate("all_sources", F.array().cast(f"array<{SOURCE}>"), _add_source).alias("sources")
    out = meta.join(values, list(keys), "left").select(*keys, "source", "external_id", "confidence", "source_priority", F.coalesce("owners", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{OWNER}>"))).alias("owners"), sources, F.coalesce("fields", F.lit(None).cast(FIELDS)).alias("fields"))
    return out, conflicts


def _add_source(acc: Column, x: Column) -> Column:
    """A list of sources with one more: of two with the same name and external id the better one stays, and what isn't stale clears a stale mark."""
    same = lambda s: (s["source"] == x["source"]) & (s["external_id"] == x["external_id"])
    better = lambda s: F.when((x["priority"] > s["priority"]) | ((x["priority"] == s["priority"]) & (x["confidence"] >= s["confidence"])), x).otherwise(s)
    cleared = lambda s: F.struct(better(s)["source"].alias("source"), better(s)["external_id"].alias("external_id"), better(s)["confidence"].alias("confidence"), better(s)["priority"].alias("priority"), (s["stale"] & x["stale"]).alias("stale"))
    return F.when(F.exists(acc, same), F.transform(acc, lambda s: F.when(same(s), cleared(s).cast(SOURCE)).otherwise(s))).otherwise(F.concat(acc, F.array(x)))


@dataclass(frozen=True)
class State:
    """All that a graph's version holds."""

    spark: SparkSession
    entities: DataFrame
    edges: DataFrame
    relations: dict[str, RelationType] = field(default_factory=lambda: dict(BUILT_IN))
    types: dict[str, EntityType] = field(default_factory=dict)
    version: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        entities = spark.createDataFrame([], _schema("id string, kind string").add("merged_from", T.ArrayType(T.StringType())).add("split_from", T.StringType()))
        return cls(spark, entities, spark.createDataFrame([], _schema("id string, type string, src string, dst string")))

    def graph(self) -> Graph:
        kinds = sorted(r["kind"] for r in self.entities.select("kind").distinct().collect())
        tables = {}
        for k in kinds:
            df = self.entities.where(F.col("kind") == k)
            labels = F.from_json(F.col("fields")["labels"]["j"], "array<string>")
            tables[k] = Table(df.withColumn("labels", F.when(F.col("fields")["labels"]["k"] == "raw", labels)))
        return Graph(self.spark, tables, Table(self.edges, True), self.relations, self.version, checked=False)

    def _appends(self) -> Column | None:
        """Whether a row's field is to be united, by the types of its kind; None if no type says so."""
        tests = [
            (F.col("kind") == kind) & F.col("field").isin(names)
            for kind in self.types
            if (names := [n for n, s in effective_fields(self.types, kind).items() if s.get("merge_strategy") == "append_unique"])
        ]
        return reduce(Column.__or__, tests) if tests else None

    def upsert(self, incoming: DataFrame) -> tuple[State, DataFrame]:
        """Entities (entity_rows) written over those that are there; also the field conflicts that priority decided."""
        rows = with_targets(self, incoming)
        rows = rows.withColumn("owners", F.lit(None).cast(f"map<string,{OWNER}>")).withColumn("sources", F.lit(None).cast(f"array<{SOURCE}>"))
        before = self.entities.withColumn("seq", F.lit(-1).cast("long")).withColumn("replaced", F.array().cast("array<string>")).withColumn("given", F.lit(None).cast("string"))
        columns = ["id", "kind", "seq", "source", "external_id", "confidence", "source_priority", "owners", "sources", "fields", "replaced"]
        touched = rows.select("id").distinct()
        both = before.join(touched, "id", "left_semi").select(*columns).unionByName(rows.select(*columns))
        changed = both.groupBy("id").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a != b").head()
        if changed:
            raise InvalidQuery(f"an entity's kind can't change: {changed['id']}")
        merged, conflicts = _merged(both, ("id", "kind"), self._appends())
        aliases = rows.where("given is not null and given != id").groupBy("id").agg(F.array_sort(F.collect_set("given")).alias("more"))
        old = before.select("id", F.col("merged_from").alias("old_from"), "split_from")
        none = F.array().cast("array<string>")
        merged = merged.join(aliases, "id", "left").join(old, "id", "left").withColumn("merged_from", F.array_distinct(F.concat(F.coalesce("old_from", none), F.coalesce("more", none)))).drop("more", "old_from")
        kept = self.entities.join(touched, "id", "left_anti").unionByName(merged)
        return replace(self, entities=kept, version=self.version + 1), conflicts.drop("kind")

    def upsert_edges(self, incoming: DataFrame) -> tuple[State, DataFrame]:
        """Edges (edge_rows) written over those that are there: one for each relation and pair of ends."""
        rows = incoming.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
        rows = rows.withColumn("owners", F.lit(None).cast(f"map<string,{OWNER}>")).withColumn("sources", F.lit(None).cast(f"array<{SOURCE}>")).withColumn("replaced", F.array().cast("array<string>"))
        before = self.edges.withColumn("seq", F.lit(-1).cast("long")).withColumn("replaced", F.array().cast("array<string>"))
        columns = ["id", "type", "src", "dst", "seq", "source", "external_id", "confidence", "source_priority", "owners", "sources", "fields", "replaced"]
        touched = rows.select("id").distinct()
        both = before.join(touched, "id", "left_semi").select(*columns).unionByName(rows.select(*columns))
        merged, conflicts = _merged(both, ("id", "type", "src", "dst"), None)
        out = replace(self, edges=self.edges.join(touched, "id", "left_anti").unionByName(merged), version=self.version + 1)
        return out, conflicts.drop("type", "src", "dst")

    def delete(self, ids: list[str]) -> State:
        """Entities and the edges that end at them."""
        return self.delete_frame(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_frame(self, gone: DataFrame) -> State:
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        return replace(self, entities=self.entities.join(gone, "id", "left_anti"), edges=edges.select(*self.edges.columns), version=self.version + 1)

    def delete_from_source(self, ids: list[str], source: str, priority: float) -> tuple[State, list[str]]:
        """Deletes entities whose owner's priority isn't higher; also the ids that stay."""
        found = self.entities.where(F.col("id").isin(ids)).select("id", "source_priority")
        stay = [r["id"] for r in found.where(F.col("source_priority") > priority).collect()]
        return self.delete([i for i in ids if i not in stay]), sorted(stay)

    def edges_named(self, refs: DataFrame) -> DataFrame:
        """ref, id of the edges that refs (column ref) name: by id, or else by the external id of one of their sources."""
        known = refs.select("ref").where("ref != ''").distinct()
        own = known.join(self.edges.select("id"), known["ref"] == F.col("id")).select("ref", "id")
        names = self.edges.select("id", F.explode("sources.external_id").alias("ref")).distinct()
        return own.unionByName(known.join(own, "ref", "left_anti").join(names, "ref").select("ref", "id"))

    def delete_edges(self, ids: list[str]) -> State:
        """Edges by id or by a source's name for them; a name that several edges have is an error."""
        found = self.edges_named(self.spark.createDataFrame([(i,) for i in ids], "ref string"))
        if bad := found.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").head():
            raise InvalidQuery(f"{bad['n']} edges are named {bad['ref']!r}")
        return replace(self, edges=self.edges.join(found.select("id"), "id", "left_anti").select(*self.edges.columns), version=self.version + 1)

    def delete_edges_from_source(self, requests: DataFrame) -> tuple[State, DataFrame]:
        """requests: seq, ref (id or name; or else type, src, dst), source, priority.  An edge goes if its owner's priority isn't
        higher; also seq, id, problem of the requests that change nothing for another reason than that the edge isn't there."""
        own = F.when(F.coalesce("ref", F.lit("")) != "", F.col("ref")).otherwise(edge_id(F.col("type"), F.col("src"), F.col("dst")))
        asked = requests.select("seq", own.alias("ref"), "source", "priority")
        named = asked.join(self.edges_named(asked), "ref")
        counts = named.groupBy("seq").agg(F.count("*").alias("n"))
        judged = named.join(counts, "seq").join(self.edges.select("id", "source_priority"), "id")
        problem = F.when(F.col("n") > 1, "several edges have this name").when(F.col("source_priority") > F.col("priority"), "owned by a higher priority")
        judged = judged.withColumn("problem", problem)
        gone = judged.where("problem is null").select("id").distinct()
        return replace(self, edges=self.edges.join(gone, "id", "left_anti").select(*self.edges.columns), version=self.version + 1), judged.where("problem is not null").select("seq", "id", "problem").dropDuplicates(["seq"])

    def within_quota(self, entities: int = 0, edges: int = 0) -> State:
        """This state, if it holds no more entities and edges than that (0: any number)."""
        for name, most, df in (("entities", entities, self.entities), ("edges", edges, self.edges)):
            if most and (n := df.count()) > most:
                raise LimitExceeded(f"{n} {name}, of at most {most}")
        return self

    def delete_relation(self, name: str) -> State:
        return replace(self, edges=self.edges.where(F.col("type") != name), relations={k: v for k, v in self.relations.items() if k != name}, version=self.version + 1)

    def with_relation(self, r: RelationType) -> State:
        if not (r.from_kinds and r.to_kinds) and not r.allow_cross_kind:
            raise InvalidQuery(f"relation {r.name} needs kinds, or must allow all")
        out = replace(self, relations={**self.relations, r.name: r}, version=self.version + 1)
        if bad := violations(out).where(F.col("type") == r.name).head():
            raise InvalidQuery(f"edge {bad['id']}: {bad['problem']}")
        return out

    def with_type(self, t: EntityType) -> State:
        for name, spec in t.fields.items():
            if spec.get("merge_strategy") == "append_unique" and spec.get("type") != "array":
                raise InvalidQuery(f"append_unique needs an array: {name}")
        out = replace(self, types={**self.types, t.name: t}, version=self.version + 1)
        effective_fields(out.types, t.name)
        return out

    def mark_stale(self, source: str, observed: DataFrame, kind: str = "", action: str = "mark_stale", priority: float = 0.0) -> State:
        """observed: external_id.  Entities of the source (and kind) of which no external id was observed are marked or deleted."""
        missing = missing_from_source(self.entities, source, observed, kind)
        if action == "delete":
            return self.delete_frame(missing.join(self.entities.where(F.col("source_priority") <= priority).select("id"), "id", "left_semi"))
        if action != "mark_stale":
            raise InvalidQuery(f"unsupported source stale action {action!r}")
        marked = F.transform("sources", lambda s: F.when(s["source"] == source, s.withField("stale", F.lit(True))).otherwise(s))
        rows = self.entities.join(missing.withColumn("gone", F.lit(True)), "id", "left")
        return replace(self, entities=rows.withColumn("sources", F.when(F.col("gone"), marked).otherwise(F.col("sources"))).drop("gone").select(*self.entities.columns), version=self.version + 1)

    def merge(self, target: str, sources: list[str]) -> State:
        """Entities of one kind as one: fields by priority, edges to and from the target."""
        found = {r["id"]: r["kind"] for r in self.entities.where(F.col("id").isin([target, *sources])).select("id", "kind").collect()}
        if missing := sorted({target, *sources} - set(found)):
            raise InvalidQuery(f"entities not found: {missing}")
        if len(set(found.values())) > 1:
            raise InvalidQuery("only entities of one kind can be merged")
        moves = self.spark.createDataFrame([(s, target) for s in sources if s != target], "old string, new string")
        order = F.when(F.col("id") == target, -1).otherwise(F.array_position(F.array(*map(F.lit, sources)), F.col("id"))).cast("long")
        part = self.entities.where(F.col("id").isin([target, *sources])).withColumn("seq", order).withColumn("replaced", F.array().cast("array<string>")).withColumn("id", F.lit(target))
        out, _ = _merged(part, ("id", "kind"), self._appends())
        old = part.agg(F.flatten(F.collect_list(F.coalesce("merged_from", F.array().cast("array<string>")))).alias("x")).head()["x"]
        out = out.withColumn("split_from", F.lit(None).cast("string")).withColumn("merged_from", F.array(*map(F.lit, dict.fromkeys([*old, *(s for s in sources if s != target)]))).cast("array<string>"))
        entities = self.entities.where(~F.col("id").isin([target, *sources])).unionByName(out)
        return replace(self, entities=entities, edges=redirected(self.edges, moves), version=self.version + 1)

    def split(self, source: str, replacements: DataFrame) -> State:
        """An entity and its edges go; the replacements (entity_rows) come, and say what they were split from."""
        if not self.entities.where(F.col("id") == source).head(1):
            raise InvalidQuery(f"entity not found: {source}")
        new = with_targets(self, replacements).select("id").distinct()
        if taken := self.entities.join(new, "id", "left_semi").select("id").head():
            raise InvalidQuery(f"a replacement needs an id of its own: {taken['id']}")
        out = self.delete([source]).upsert(replacements)[0]
        marked = out.entities.join(new.withColumn("new", F.lit(source)), "id", "left").withColumn("split_from", F.coalesce("new", "split_from")).select(*out.entities.columns)
        return replace(out, entities=marked, version=self.version + 1)

    def entity_by_alias(self, id_: str) -> str | None:
        """The id of an entity, or of the only one that was merged from it."""
        if self.entities.where(F.col("id") == id_).head(1):
            return id_
        found = self.entities.where(F.array_contains("merged_from", id_)).select("id").limit(2).collect()
        return found[0]["id"] if len(found) == 1 else None


def with_targets(state: State, incoming: DataFrame) -> DataFrame:
    """incoming with its ids resolved: by identity keys, else as given, else from kind, source and external id.  given: the id it came with."""
    own = F.coalesce(F.when(F.col("id") != "", F.col("id")), entity_id(F.col("kind"), F.col("source"), F.col("external_id")))
    rows = incoming.withColumn("given", F.when(F.col("id") != "", F.col("id"))).withColumn("id", own)
    for kind in state.types:
        for name, (names, least, strategy) in state.types[kind].identity_keys.items():
            rows = _by_identity(state, rows, kind, name, names, least, strategy)
    return rows


def _by_identity(state: State, rows: DataFrame, kind: str, name: str, names: tuple[str, ...], least: float, strategy: str) -> DataFrame:
    def signature(df: DataFrame) -> Column:
        parts = [F.to_json(F.col("fields")[n]) for n in names]
        whole = F.concat_ws("\x1f", *parts)
        there = F.lit(True)
        for n in names:
            there = there & ~empty_value(F.col("fields")[n])
        return F.when((F.col("kind") == kind) & (F.col("confidence") >= least) & there, whole)

    mine = rows.withColumn("sig", signature(rows))
    known = state.entities.withColumn("sig", signature(state.entities)).where("sig is not null").groupBy("sig").agg(F.min("id").alias("owner"))
    fresh = mine.where("sig is not null").groupBy("sig").agg(F.min_by("id", "seq").alias("first"))
    joined = mine.join(known, "sig", "left").join(fresh, "sig", "left")
    target = F.coalesce("owner", "first", "id")
    if strategy == "reject" and joined.where(target != F.col("id")).head(1):
        raise InvalidQuery(f"identity key {name} of {kind} belongs to another entity")
    return joined.withColumn("id", target).drop("sig", "owner", "first")


def missing_from_source(entities: DataFrame, source: str, observed: DataFrame, kind: str = "") -> DataFrame:
    """id of the entities that have external ids of the source, none of which was observed."""
    rows = entities if not kind else entities.where(F.col("kind") == kind)
    seen = rows.select("id", F.explode("sources").alias("s")).where((F.col("s.source") == source) & (F.col("s.external_id") != "")).select("id", F.col("s.external_id").alias("external_id"))
    found = seen.join(observed.select("external_id").distinct(), "external_id", "left_semi").select("id")
    return seen.select("id").distinct().join(found.distinct(), "id", "left_anti")


def redirected(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with their ends moved (old, new); their ids follow, and those that fall together become one."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(moves.select(F.col("old").alias(end), F.col("new")), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    out = out.withColumn("old_id", F.col("id")).withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
    moved = out.withColumn("seq", F.row_number().over(_by_id())).withColumn("replaced", F.array().cast("array<string>"))
    one = moved.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    merged, _ = _merged(moved.join(one, "id", "left_semi").drop("old_id"), ("id", "type", "src", "dst"), None)
    return out.drop("old_id").join(one, "id", "left_anti").select(*edges.columns).unionByName(merged.select(*edges.columns))


def _by_id():
    return Window.partitionBy("id").orderBy("old_id")


#: What can be wrong with an edge but for its cardinality, the first first.
_PROBLEMS = ("missing relation type", "missing from entity", "missing to entity", "from kind is not allowed", "to kind is not allowed")
_SINGLE = {"src": ("many_to_one", "one_to_one"), "dst": ("one_to_many", "one_to_one")}


def _bad_ends(state: State, end: str, rules: DataFrame) -> DataFrame:
    """type, end, and what is wrong with all edges of that type there: code (of _PROBLEMS, or null) and crowded."""
    used = state.edges.groupBy("type", end).agg(F.count("*").alias("n"))
    kinds = state.entities.select(F.col("id").alias(end), "kind")
    e = used.join(F.broadcast(rules), "type", "left").join(kinds, end, "left")  # relation types are a few rows
    missing, wrong, allowed = (1, 3, F.col("from_kinds")) if end == "src" else (2, 4, F.col("to_kinds"))
    fits = F.when(F.size(allowed) == 0, F.col("any")).otherwise(F.array_contains(allowed, F.col("kind")))
    code = F.when(F.col("cardinality").isNull(), 0).when(F.col("kind").isNull(), missing).when(~fits, wrong)
    crowded = (F.col("n") > 1) & F.coalesce(F.col("cardinality").isin(*_SINGLE[end]), F.lit(False))
    return e.select(F.col("type").alias(f"{end}_type"), F.col(end).alias(f"{end}_id"), code.alias(f"{end}_code"), crowded.alias(f"{end}_crowded")).where(f"{end}_code is not null or {end}_crowded")


def violations(state: State, hold: bool = False) -> DataFrame:
    """id, type, problem of the edges that break their relation: unknown relation or end, kind, cardinality.

    Ends are judged once for all their edges, so that only edges of bad ends are joined.  hold: bad ends are written first, so
    that Spark knows their size, and edges aren't shuffled for an end of which few are bad."""
    rules = state.spark.createDataFrame([(r.name, list(r.from_kinds), list(r.to_kinds), r.cardinality, r.allow_cross_kind) for r in state.relations.values()], "type string, from_kinds array<string>, to_kinds array<string>, cardinality string, any boolean")
    e = state.edges.select("id", "type", "src", "dst")
    for end in ("dst", "src"):
        bad = _bad_ends(state, end, rules)
        bad = written(bad) if hold else bad
        e = e.join(bad, F.col("type").eqNullSafe(F.col(f"{end}_type")) & F.col(end).eqNullSafe(F.col(f"{end}_id")), "left").drop(end, f"{end}_type", f"{end}_id")
    named = F.array(*map(F.lit, _PROBLEMS))[F.least("src_code", "dst_code")]
    crowded = F.when(F.coalesce("src_crowded", F.lit(False)) | F.coalesce("dst_crowded", F.lit(False)), F.lit("violates cardinality"))
    return e.select("id", "type", F.explode(F.array_compact(F.array(named, crowded))).alias("problem"))


_TYPES = {"string": "string", "number": "number", "bool": "bool", "array": "raw", "object": "raw"}


def field_violations(state: State) -> DataFrame:
    """id, field, problem of entities that break their type: required, type, enum, unique."""
    out = state.spark.createDataFrame([], "id string, field string, problem string")
    for kind in state.types:
        rows = state.entities.where(F.col("kind") == kind)
        for name, spec in effective_fields(state.types, kind).items():
            v = F.col("fields")[name]
            tests = []
            if spec.get("required"):
                tests.append((v.isNull() | (v["k"] == "null"), "required"))
            if spec.get("type", "any") != "any":
                kind_of = _TYPES[spec["type"]]
                wrong = v.isNotNull() & (v["k"] != "null") & (v["k"] != kind_of)
                if kind_of == "raw":
                    wrong = wrong | F.coalesce((v["k"] == "raw") & ~v["j"].startswith("[" if spec["type"] == "array" else "{"), F.lit(False))
                tests.append((F.coalesce(wrong, F.lit(False)), "type"))
            if spec.get("enum"):
                value = Table(rows).value(f"fields.{name}")
                fits = F.lit(False)
                for x in spec["enum"]:
                    fits = fits | value.equals(x)
                tests.append((value.exists & ~fits, "enum"))
            for test, problem in tests:
                out = out.unionByName(rows.where(test).select("id", F.lit(name).alias("field"), F.lit(problem).alias("problem")))
            if spec.get("unique"):
                many = rows.where(v.isNotNull()).groupBy(F.to_json(v).alias("v")).agg(F.count("*").alias("n")).where("n > 1").select("v")
                out = out.unionByName(rows.withColumn("v", F.to_json(v)).join(many, "v", "left_semi").select("id", F.lit(name).alias("field"), F.lit("unique").alias("problem")))
    return out


def rejected_entities(state: State, incoming: DataFrame) -> DataFrame:
    """seq, problem of entity writes that would change a kind or break their type."""
    rows = with_targets(state, incoming).select("seq", "id", "kind")
    kinds = state.entities.select("id", F.col("kind").alias("old")).join(rows.select("id").distinct(), "id", "left_semi")
    first = rows.groupBy("id").agg(F.min_by("kind", "seq").alias("first"))
    judged = rows.join(kinds, "id", "left").join(first, "id")
    out = judged.where(F.coalesce("old", "first") != F.col("kind")).select("seq", F.lit("an entity's kind can't change").alias("problem"))
    if state.types:
        tentative, _ = state.upsert(incoming.join(out.select("seq"), "seq", "left_anti"))
        bad = field_violations(tentative).groupBy("id").agg(F.min(F.concat("problem", F.lit(": "), "field")).alias("problem"))
        out = out.unionByName(rows.join(out.select("seq"), "seq", "left_anti").join(bad, "id").select("seq", "problem"))
    return out


def rejected_edges(state: State, incoming: DataFrame) -> DataFrame:
    """seq, problem of edge writes whose relation, ends or cardinality are wrong; of writes that exclude each other the first stays."""
    new = State(state.spark, state.entities, incoming.withColumn("id", F.col("seq").cast("string")), state.relations, state.types)
    single = violations(new).where("problem != 'violates cardinality'").select(F.col("id").cast("long").alias("seq"), "problem")
    left = incoming.join(single.select("seq"), "seq", "left_anti")
    out = single
    for end, other, limits in (("src", "dst", ("many_to_one", "one_to_one")), ("dst", "src", ("one_to_many", "one_to_one"))):
        names = [r.name for r in state.relations.values() if r.cardinality in limits]
        if names:
            some = left.where(F.col("type").isin(names))
            held = state.edges.where(F.col("type").isin(names)).groupBy("type", end).agg(F.min(other).alias("held"))
            first = some.groupBy("type", end).agg(F.min_by(other, "seq").alias("first"))
            judged = some.join(first, ["type", end]).join(held, ["type", end], "left")
            out = out.unionByName(judged.where(F.coalesce("held", "first") != F.col(other)).select("seq", F.lit("violates cardinality").alias("problem")))
    return out.dropDuplicates(["seq"])


def with_defaults(state: State, incoming: DataFrame) -> DataFrame:
    """Incoming entities with the defaults of their types for fields they lack."""
    from graphloom.functions.values import literal

    for kind in state.types:
        for name, spec in effective_fields(state.types, kind).items():
            if "default" in spec:
                lacks = (F.col("kind") == kind) & ~F.map_contains_key("fields", name)
                incoming = incoming.withColumn("fields", F.when(lacks, F.map_concat("fields", F.create_map(F.lit(name), literal(spec["default"])))).otherwise(F.col("fields")))
    return incoming


def _without(name: str) -> Column:
    return F.map_filter("fields", lambda k, _v: k != name)


@dataclass(frozen=True)
class SourcePolicy:
    """default and sources: priorities.  aliases: (kind or "", alias, field)."""

    default: float = 0.0
    sources: dict[str, float] = field(default_factory=dict)
    aliases: tuple[tuple[str, str, str], ...] = ()

    def ranked(self, rows: DataFrame, column: str = "source_priority") -> DataFrame:
        """rows with the priority of their source."""
        own = F.create_map(*(F.lit(x) for k, v in self.sources.items() for x in (k, float(v))))[F.col("source")] if self.sources else F.lit(None).cast("double")
        return rows.withColumn(column, F.coalesce(own, F.lit(float(self.default))))

    def apply(self, incoming: DataFrame) -> DataFrame:
        """Sets the priority of rows by their source and renames aliased fields; a field's own name wins over its aliases."""
        out = self.ranked(incoming)
        for kind, alias, name in sorted(self.aliases, reverse=True):  # those of a kind before those of all
            here = F.map_contains_key("fields", alias) & (F.lit(True) if not kind else F.col("kind") == kind)
            without = _without(alias)
            renamed = F.when(F.map_contains_key("fields", name), without).otherwise(F.map_concat(without, F.create_map(F.lit(name), F.col("fields")[alias])))
            out = out.withColumn("fields", F.when(here, renamed).otherwise(F.col("fields")))
        return out
