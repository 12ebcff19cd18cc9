"""Items from JSON Lines and CSV files, one entity or edge each; lines that aren't items go to an error table."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import VALUE
from graphloom.operators.governance import EntityType, SourcePolicy, State, rejected_edges, rejected_entities, with_defaults
from graphloom.operators.paths import written
from graphloom.plans.request import InvalidQuery
from graphloom.sources.graph import FIELDS, RelationType, entity_id

MAX_LINE = 8 << 20
PAYLOADS = ("entity", "edge", "delete_entity", "delete_edge", "relation_type", "entity_type")
# CSV columns that aren't fields, and the names of record types.
RESERVED = {"record_type", "payload", "definition", "id", "kind", "entity_type", "labels", "type", "relation_type", "from", "to", "source", "external_id", "reason", "fields", "fields_json"}
RECORD_TYPES = {"entity": "entity", "node": "entity", "edge": "edge", "relationship": "edge", "delete_entity": "delete_entity", "delete_node": "delete_entity", "delete_edge": "delete_edge", "delete_relationship": "delete_edge", "entity_type": "entity_type", "relation_type": "relation_type"}


def packed_json(j: F.Column) -> F.Column:
    """A JSON text as packed value."""
    t = F.trim(j)
    number = t.try_cast("double")
    quoted = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]
    kind = (
        F.when(t == "null", "null").when(t.isin("true", "false"), "bool").when(t.startswith('"'), "string").when(t.startswith("{") | t.startswith("["), "raw").when(number.isNotNull(), "number")
    )
    parts = {"k": kind, "s": F.when(kind == "string", quoted), "n": F.when(kind == "number", number), "b": F.when(kind == "bool", t == "true"), "j": F.when(kind == "raw", t)}
    return F.struct(*(parts[f.name].cast(f.dataType).alias(f.name) for f in VALUE))


def packed_fields(column: F.Column) -> F.Column:
    """A JSON object's members as packed values.  Members keep their JSON text, quotes included."""
    members = F.from_json(column, "map<string,variant>")
    return F.transform_values(members, lambda _k, v: packed_json(F.to_json(v)))


def _items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: seq, line.  Items (seq, external_id, source, one JSON column for each payload) and errors (seq, line, error)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("external_id", "source", *PAYLOADS, "_bad")])
    parsed = lines.where(F.trim("line") != "").withColumn("x", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    count = sum((F.when(F.col("x")[p].isNotNull(), 1).otherwise(0) for p in PAYLOADS), F.lit(0))
    error = (
        F.when(F.length("line") > MAX_LINE, "the line is too long").when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "not a JSON object")
        .when(count != 1, F.format_string("an item has one payload, this has %d", count))
        .when(F.col("x.entity").isNotNull() & F.coalesce(F.get_json_object("x.entity", "$.kind"), F.lit("")).isin(""), "an entity needs a kind")
        .when(F.col("x.edge").isNotNull() & (F.get_json_object("x.edge", "$.type").isNull() | F.get_json_object("x.edge", "$.from").isNull() | F.get_json_object("x.edge", "$.to").isNull()), "an edge needs type, from and to")
    )
    judged = parsed.withColumn("error", error)
    return judged.where("error is null").select("seq", "x.*").drop("_bad"), judged.where("error is not null").select("seq", "line", "error")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and errors of a JSON Lines file or folder."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return _items(lines)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and errors of CSV files with a header; record_type says what a row is, cells are JSON scalars or else texts."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("multiLine", True).option("escape", '"').csv(path)
    by_name = {c.strip().lower(): c for c in rows.columns}
    if len(by_name) != len(rows.columns) or "record_type" not in by_name:
        raise InvalidQuery("CSV requires distinct headers, record_type among them")
    cell = lambda name: F.col(f"`{by_name[name]}`") if name in by_name else F.lit(None).cast("string")
    filled = lambda name: F.when(cell(name) != "", cell(name))

    def scalar(c: F.Column) -> F.Column:
        """The JSON text of a cell."""
        is_json = c.rlike(r'^\s*(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"(?:[^"\\]|\\.)*"|\[.*\]|\{.*\})\s*$')
        text = F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")
        return F.when(is_json, F.trim(c)).otherwise(text)

    def members(pairs: list[tuple[str, F.Column]], more: F.Column | None = None) -> F.Column:
        """A JSON object of the pairs that have a value."""
        parts = [F.when(v.isNotNull(), F.concat(F.lit(json.dumps(k) + ":"), v)) for k, v in pairs]
        parts += [] if more is None else [F.when(more.isNotNull(), F.regexp_replace(F.trim(more), r"^\{|\}$", ""))]
        kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != ""))
        return F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))

    text = lambda name: F.when(filled(name).isNotNull(), F.regexp_replace(F.to_json(F.struct(filled(name).alias("v"))), r'^\{"v":|\}$', ""))
    own = [(h.strip(), F.when(cell(h.strip().lower()) != "", scalar(cell(h.strip().lower())))) for h in rows.columns if h.strip().lower() not in RESERVED]
    fields = members(own, F.coalesce(filled("fields_json"), filled("fields")))
    labels = F.when(filled("labels").isNotNull(), F.when(F.trim(cell("labels")).startswith("["), F.trim(cell("labels"))).otherwise(F.to_json(F.transform(F.split(cell("labels"), r"\|"), F.trim))))
    kind = F.coalesce(text("kind"), text("entity_type"))
    type_ = F.coalesce(text("type"), text("relation_type"))
    entity = members([("id", text("id")), ("kind", kind), ("labels", labels), ("source", text("source")), ("external_id", text("external_id")), ("fields", fields)])
    edge = members([("id", text("id")), ("type", type_), ("from", text("from")), ("to", text("to")), ("source", text("source")), ("external_id", text("external_id")), ("fields", fields)])
    gone = members([("id", text("id")), ("kind", kind), ("source", text("source")), ("external_id", text("external_id")), ("reason", text("reason"))])
    definition = F.coalesce(filled("definition"), filled("payload"))
    record = F.create_map(*(F.lit(x) for kv in RECORD_TYPES.items() for x in kv))[F.lower(F.trim(cell("record_type")))]
    payload = F.when(record == "entity", entity).when(record == "edge", edge).when(record.isin("delete_entity", "delete_edge"), gone).otherwise(definition)
    line = F.when(record.isNull(), F.concat(F.lit("record_type: "), F.coalesce(cell("record_type"), F.lit("")))).otherwise(F.concat(F.lit('{"'), record, F.lit('":'), payload, F.lit("}")))
    return _items(rows.select(F.monotonically_increasing_id().alias("seq"), line.alias("line")))


def entities_of(items: DataFrame, source: str = "") -> DataFrame:
    """Entity writes (as entity_rows) of items."""
    x = items.where(F.col("entity").isNotNull())
    get = lambda path: F.get_json_object("entity", path)
    fields = packed_fields(F.coalesce(get("$.fields"), F.lit("{}")))
    labels = F.array_sort(F.array_distinct(F.from_json(get("$.labels"), "array<string>")))
    packed_labels = F.struct(F.lit("raw").alias("k"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.to_json(labels).alias("j"))
    forced = F.transform(F.filter(F.map_keys(fields), lambda k: k.endswith("!")), lambda k: F.regexp_replace(k, "!$", ""))
    plain = F.transform_keys(fields, lambda k, _v: F.regexp_replace(k, "!$", ""))
    whole = F.when(labels.isNotNull() & ~F.map_contains_key(plain, "labels"), F.map_concat(plain, F.create_map(F.lit("labels"), packed_labels))).otherwise(plain)
    return x.select(
        "seq", get("$.id").alias("id"), get("$.kind").alias("kind"), F.coalesce(get("$.source"), F.col("source"), F.lit(source)).alias("source"),
        F.coalesce(get("$.external_id"), F.col("external_id"), get("$.id"), F.lit("")).alias("external_id"), F.coalesce(get("$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(get("$.source_priority").try_cast("double"), F.lit(0.0)).alias("source_priority"), whole.cast(FIELDS).alias("fields"), forced.alias("replaced"),
    )


def edges_of(items: DataFrame, source: str = "") -> DataFrame:
    """Edge writes (as edge_rows) of items."""
    x = items.where(F.col("edge").isNotNull())
    get = lambda path: F.get_json_object("edge", path)
    return x.select(
        "seq", get("$.type").alias("type"), get("$.from").alias("src"), get("$.to").alias("dst"), F.coalesce(get("$.source"), F.col("source"), F.lit(source)).alias("source"),
        F.coalesce(get("$.external_id"), F.col("external_id"), get("$.id"), F.lit("")).alias("external_id"), F.coalesce(get("$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(get("$.source_priority").try_cast("double"), F.lit(0.0)).alias("source_priority"), packed_fields(F.coalesce(get("$.fields"), F.lit("{}"))).cast(FIELDS).alias("fields"),
    )


MAX_TYPES = 10_000


def _types_of(items: DataFrame, payload: str) -> list[tuple[int, dict]]:
    """(seq, definition) of the type payloads, of which a batch may have MAX_TYPES."""
    rows = items.where(F.col(payload).isNotNull()).select("seq", payload).orderBy("seq").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise InvalidQuery(f"more than {MAX_TYPES} types in a batch")
    return [(r["seq"], json.loads(r[payload])) for r in rows]


def relation_of(x: dict) -> RelationType:
    return RelationType(x["name"], tuple(x.get("from_kinds") or ()), tuple(x.get("to_kinds") or ()), x.get("cardinality") or "many_to_many", x.get("impact_direction") or "none", bool(x.get("allow_cross_kind")), x.get("reverse_name") or "")


def entity_type_of(x: dict) -> EntityType:
    own = x.get("fields") or {}
    specs = {f["name"]: {k: v for k, v in f.items() if k != "name"} for f in own} if isinstance(own, list) else own
    keys = {k.get("name") or "_".join(k["fields"]): (tuple(k["fields"]), float(k.get("min_confidence") or 0), k.get("strategy") or "merge") for k in x.get("identity_keys") or ()}
    return EntityType(x["name"], tuple(x.get("extends") or ()), specs, keys)


def apply_items(state: State, items: DataFrame, source: str = "", policy: SourcePolicy | None = None) -> tuple[State, DataFrame, DataFrame]:
    """Types and relations, then deletes of edges and entities that priority allows, then entities and edges that their types
    and relations allow; also the field conflicts, and seq, error of the items that were rejected."""
    failed: list[tuple[int, str]] = []
    out, items = state, written(items)  # read by every step: lines are parsed once
    for payload, make, add in (("entity_type", entity_type_of, "with_type"), ("relation_type", relation_of, "with_relation")):
        for seq, x in _types_of(items, payload):
            try:
                out = getattr(out, add)(make(x))
            except (InvalidQuery, KeyError, TypeError, ValueError) as e:
                failed.append((seq, f"{payload}: {e}"))
    errors = out.spark.createDataFrame(failed, "seq long, error string")
    priority = lambda payload: F.coalesce(F.get_json_object(payload, "$.source_priority").try_cast("double"), F.lit(0.0))
    of_source = lambda payload: F.coalesce(F.get_json_object(payload, "$.source"), F.col("source"), F.lit(source))

    edges = items.where(F.col("delete_edge").isNotNull())
    get = lambda path: F.get_json_object("delete_edge", path)
    edges = edges.select("seq", F.coalesce(get("$.id"), get("$.external_id")).alias("ref"), get("$.type").alias("type"), get("$.from").alias("src"), get("$.to").alias("dst"), of_source("delete_edge").alias("source"), priority("delete_edge").alias("priority"))
    out, stay = out.delete_edges_from_source(_ranked(edges, policy))
    errors = errors.unionByName(stay.select("seq", F.col("problem").alias("error")))

    gone = items.where(F.col("delete_entity").isNotNull())
    get = lambda path: F.get_json_object("delete_entity", path)
    gone = gone.select("seq", F.coalesce(get("$.id"), entity_id(get("$.kind"), of_source("delete_entity"), get("$.external_id"))).alias("id"), of_source("delete_entity").alias("source"), priority("delete_entity").alias("priority"))
    judged = _ranked(gone, policy).join(out.entities.select("id", "source_priority"), "id")
    judged = written(judged)
    errors = errors.unionByName(judged.where("source_priority > priority").select("seq", F.lit("owned by a higher priority").alias("error")))
    out = out.delete_frame(judged.where("source_priority <= priority").select("id").distinct())

    rows = entities_of(items, source)
    rows = written(with_defaults(out, rows if policy is None else policy.apply(rows)))
    bad = rejected_entities(out, rows)
    errors = errors.unionByName(bad.select("seq", F.col("problem").alias("error")))
    out, one = out.upsert(rows.join(bad.select("seq"), "seq", "left_anti"))
    out = replace(out, entities=written(out.entities))  # edges are checked against them

    links = edges_of(items, source)
    links = written(links if policy is None else policy.ranked(links))
    bad = rejected_edges(out, links)
    errors = errors.unionByName(bad.select("seq", F.col("problem").alias("error")))
    out, two = out.upsert_edges(links.join(bad.select("seq"), "seq", "left_anti"))
    return State(out.spark, out.entities, written(out.edges), out.relations, out.types, state.version + 1), one.unionByName(two), errors


def _ranked(requests: DataFrame, policy: SourcePolicy | None) -> DataFrame:
    """Requests with the priority that a policy gives their source."""
    return requests if policy is None else policy.ranked(requests, "priority")
