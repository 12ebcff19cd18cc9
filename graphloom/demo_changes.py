"""Queries of what requests return and of what changes leave behind, each with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.demo import _entities, _id, _text, opened
from graphloom.operators.governance import EntityType, State, field_violations
from graphloom.operators.paths import written
from graphloom.operators.query import execute, groups, plan
from graphloom.plans.graphql import run_graphql
from graphloom.plans.request import LimitExceeded, parse
from graphloom.sources.graph import RelationType
from graphloom.sources.imports import _items, apply_items

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _where(field: str, op: str, value) -> dict:
    return {"op": "match", "kind": "customer", "where": [{"field": field, "op": op, "value": value}]}


@_query("""SELECT * FROM (VALUES ('all', 'kind-scan', ''), ('eq', 'field-index', 'mktsegment'), ('hops', 'bounded-bfs', ''), ('id', 'entity-id-lookup', 'id'),
           ('prefix', 'field-index-scan', 'name'), ('shortest', 'shortest-bfs', '')) AS t(request, strategy, index_field)""")
def explain_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How requests are planned."""
    g = opened(spark, sf_dir)
    asked = {
        "all": {"op": "match", "kind": "customer"}, "eq": _where("mktsegment", "eq", "BUILDING"), "id": _where("id", "eq", "customer:7"), "prefix": _where("name", "prefix", "C"),
        "hops": {"op": "traverse", "id": "nation:3"}, "shortest": {"op": "shortest_path", "id": "nation:3", "target_id": "nation:4"},
    }
    plans = {k: plan(g, parse(v)) for k, v in asked.items()}
    return spark.createDataFrame([(k, p["strategy"], p["index_field"]) for k, p in plans.items()], "request string, strategy string, index_field string")


@_query("""SELECT 'nation:' || n_nationkey AS id, (row_number() OVER (ORDER BY n_name DESC, 'nation:' || n_nationkey) - 1) // 7 + 1 AS page FROM nation""")
def pages_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a request, each from the cursor of the one before."""
    g, rows, cursor, page = opened(spark, sf_dir), [], "", 0
    while not page or cursor:
        got = execute(g, {"op": "match", "kind": "nation", "sort": [{"field": "name", "desc": True}], "limit": 7, "cursor": cursor})
        page, cursor = page + 1, got["next_cursor"]
        rows += [(r["entity"]["id"], page) for r in got["results"]]
    return spark.createDataFrame(rows, "id string, page long")


@_query("SELECT 'customer:' || c_custkey AS id FROM customer ORDER BY 1 LIMIT 1000")
def page_limit_is_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has 1,000 rows at most, whatever is asked for."""
    got = execute(opened(spark, sf_dir), {"op": "match", "kind": "customer", "limit": 5000})
    return spark.createDataFrame([(r["entity"]["id"],) for r in got["results"]], "id string")


@_query("SELECT 'match' AS request, count(*) > 100 AS refused FROM customer UNION ALL SELECT 'nations', false UNION ALL SELECT 'level', count(*) > 10 FROM nation")
def cost_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that match more rows, or reach more paths, than their limit are refused."""
    g = opened(spark, sf_dir)
    asked = {"match": {"op": "match", "kind": "customer", "cost_limit": 100}, "nations": {"op": "match", "kind": "nation", "cost_limit": 100}, "level": {"op": "traverse", "id": "region:1", "depth": 3, "cost_limit": 10, "relation_types": ["in_region", "located_in"]}}

    def refused(r: dict) -> bool:
        try:
            execute(g, r)
        except LimitExceeded:
            return True
        return False

    return spark.createDataFrame([(k, refused(r)) for k, r in asked.items()], "request string, refused boolean")


@_query("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def counts_within_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_by within groups, as rows."""
    found = groups(opened(spark, sf_dir), {"op": "match", "kind": "order", "group_by": ["priority"], "aggregate": [{"op": "count_by", "field": "status", "name": "by"}]})
    return found.select("priority", F.explode("by").alias("status", "n"))


@_query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_name >= 'K'")
def graphql_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run_graphql(opened(spark, sf_dir), 'query($k: String!) { graph(request: {op: "match", kind: "nation", where: [{field: "name", op: "gte", value: $k}]}) { results } }', {"k": "K"})
    return spark.createDataFrame([(r["entity"]["id"],) for r in got["data"]["graph"]["results"]], "id string")


def _lines(*parts: DataFrame) -> DataFrame:
    """Item lines (seq, line) of frames with a JSON column each, one frame after the other."""
    out = None
    for k, df in enumerate(parts):
        rows = df.select((F.lit(k << 40) + F.xxhash64(df.columns[0]).bitwiseAND(F.lit((1 << 39) - 1))).alias("seq"), F.col(df.columns[0]).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _entity(key: str, kind: str, **fields: F.Column) -> F.Column:
    own = F.struct(*(c.alias(n) for n, c in fields.items()))
    return F.to_json(F.struct(F.struct(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), own.alias("fields")).alias("entity"))).alias("line")


_LEFT: dict[tuple[str, str], tuple[State, DataFrame]] = {}


def _nations(spark: SparkSession, sf_dir: str) -> tuple[State, DataFrame]:
    """The batch of _batch(), applied once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEFT:
        _LEFT.clear()
        _LEFT[key] = _batch(spark, sf_dir)
    return _LEFT[key]


def _batch(spark: SparkSession, sf_dir: str) -> tuple[State, DataFrame]:
    """What a batch leaves: types, relation types, regions, nations (some without a name, which their type requires) and edges (some to
    regions that aren't there, some against the relation's direction); and the errors."""
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    types = [
        {"entity_type": {"name": "nation", "fields": {"name": {"type": "string", "required": True}, "level": {"type": "string", "default": "low"}}}},
        {"relation_type": {"name": "lies_in", "from_kinds": ["nation"], "to_kinds": ["region"], "cardinality": "many_to_one", "impact_direction": "reverse"}},
    ]
    heads = spark.createDataFrame([(json.dumps(t),) for t in types], "line string")
    name = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name"))
    level = F.when(F.col("n_nationkey") % 2 == 0, F.lit("high"))
    edge = lambda src, dst: F.to_json(F.struct(F.struct(F.lit("lies_in").alias("type"), src.alias("from"), dst.alias("to")).alias("edge"))).alias("line")
    to = F.concat(F.lit("region:"), F.when(F.col("n_nationkey") % 7 == 0, F.lit(99)).otherwise(F.col("n_regionkey")).cast("string"))
    links = nation.select(edge(_id("nation", "n_nationkey"), to))
    turned = nation.where("n_nationkey = 1").select(edge(_id("region", "n_regionkey"), _id("nation", "n_nationkey")))
    lines = _lines(heads, region.select(_entity("r_regionkey", "region", name=F.col("r_name"))), nation.select(_entity("n_nationkey", "nation", name=name, level=level)), links, turned)
    items, _ = _items(lines)
    state, _, errors = apply_items(State.empty(spark), items, "atlas")
    return state, written(errors)


@_query("""SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS level FROM nation WHERE n_nationkey % 5 <> 0""")
def ingest_types_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a type in the same batch lets pass, with its defaults."""
    rows = _nations(spark, sf_dir)[0].entities.where("kind = 'nation'")
    return rows.select("id", F.col("fields")["level"]["s"].alias("level"))


@_query("""SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0""")
def ingest_valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a batch whose relation and ends are right."""
    return _nations(spark, sf_dir)[0].edges.select("src", "dst")


@_query("""SELECT error, count(*) AS n FROM (
             SELECT 'required: name' AS error FROM nation WHERE n_nationkey % 5 = 0
             UNION ALL SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'missing from entity' ELSE 'missing to entity' END FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0
             UNION ALL SELECT 'from kind is not allowed' FROM nation WHERE n_nationkey = 1) GROUP BY 1""")
def ingest_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch's rejected items are told."""
    return _nations(spark, sf_dir)[1].groupBy("error").agg(F.count("*").alias("n"))


def _suppliers(spark: SparkSession, sf_dir: str) -> State:
    """Suppliers with their nations as edges; those of odd key belong to a source of priority 100."""
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", _id("supplier", "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("external_id"))
    nation = _read(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("external_id"), "n_name")
    state = State.empty(spark).with_relation(RelationType("sits_in", ("supplier",), ("nation",), "many_to_one"))
    own = _entities(rows.where("s_suppkey % 2 = 1"), "supplier", "erp", 100, 0.9, 0, name=_text(F.col("external_id"))).unionByName(_entities(rows.where("s_suppkey % 2 = 0"), "supplier", "web", 10, 0.9, 0, name=_text(F.col("external_id"))))
    state = state.upsert(own.unionByName(_entities(nation, "nation", "erp", 100, 0.9, 0, name=_text(F.col("n_name")))))[0]
    rank = F.when(F.col("s_suppkey") % 2 == 1, F.lit(100.0)).otherwise(F.lit(10.0))
    fields = F.create_map(F.lit("key"), _text(F.col("external_id")))
    edges = rows.select(
        F.col("s_suppkey").cast("long").alias("seq"), F.lit("sits_in").alias("type"), F.col("id").alias("src"), _id("nation", "s_nationkey").alias("dst"), F.when(F.col("s_suppkey") % 2 == 1, "erp").otherwise("web").alias("source"),
        F.concat(F.lit("link-"), F.col("external_id")).alias("external_id"), F.lit(0.9).alias("confidence"), rank.alias("source_priority"), fields.alias("fields"),
    )
    return state.upsert_edges(edges)[0]


@_query("SELECT 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 3 <> 0")
def source_aware_edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of priority 50 asks, by names, for every third edge to go: those of a higher priority stay."""
    state = _suppliers(spark, sf_dir)
    asked = _read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").cast("long").alias("seq"), F.concat(F.lit("link-"), F.col("s_suppkey").cast("string")).alias("ref"), F.lit("sits_in").alias("type"), F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("agent").alias("source"), F.lit(50.0).alias("priority"))
    return state.delete_edges_from_source(asked)[0].edges.select("src", "dst")


@_query("""SELECT 'supplier:' || s_suppkey AS src FROM supplier WHERE s_nationkey <> 3""")
def entity_delete_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an entity its edges go."""
    return _suppliers(spark, sf_dir).delete(["nation:3"]).edges.select("src")


@_query("""SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey >= 900 THEN 'nation:3' END AS split_from
           FROM (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 900 UNION ALL SELECT 901)""")
def entity_split_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaces an entity says what it was split from."""
    two = _entities(spark.createDataFrame([("nation:900", "900"), ("nation:901", "901")], "id string, external_id string"), "nation", "erp", 100, 0.9, 0, name=_text(F.col("external_id")))
    return _suppliers(spark, sf_dir).split("nation:3", two).entities.where("kind = 'nation'").select("id", "split_from")


@_query("""SELECT 'firm:' || s_suppkey AS id, 'unique' AS problem FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that share a value which their type wants to be unique."""
    rows = _read(spark, sf_dir, "supplier").select(_id("firm", "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("external_id"), "s_nationkey")
    state = State.empty(spark).with_type(EntityType("firm", fields={"seat": {"type": "string", "unique": True}}))
    state, _ = state.upsert(_entities(rows, "firm", "erp", 1, 1, 0, seat=_text(F.col("s_nationkey").cast("string"))))
    return field_violations(state).select("id", "problem")


@_query("""SELECT 'firm:' || min(s_suppkey) AS id, count(*) AS writes FROM supplier WHERE s_nationkey < 5 GROUP BY s_nationkey""")
def identity_joins_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that agree in an identity key become one entity: the first, with the others' ids as former ones."""
    rows = _read(spark, sf_dir, "supplier").where("s_nationkey < 5").select(_id("firm", "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("external_id"), "s_nationkey", "s_suppkey")
    state = State.empty(spark).with_type(EntityType("firm", identity_keys={"seat": (("seat",), 0.0, "merge")}))
    writes = _entities(rows, "firm", "erp", 1, 1, 0, seat=_text(F.col("s_nationkey").cast("string")))
    order = rows.select("id", F.col("s_suppkey").cast("long").alias("seq"))
    state, _ = state.upsert(writes.drop("seq").join(order, "id"))
    return state.entities.select("id", (F.size("merged_from") + 1).cast("long").alias("writes"))


@_query("""SELECT 'entity:' || substr(sha256('firm' || chr(0) || 'erp' || chr(0) || s_suppkey), 1, 32) AS id FROM supplier""")
def canonical_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without an id get one from kind, source and external id."""
    rows = _read(spark, sf_dir, "supplier").select(F.lit(None).cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("external_id"))
    state, _ = State.empty(spark).upsert(_entities(rows, "firm", "erp", 1, 1, 0, name=_text(F.col("external_id"))).withColumn("seq", F.col("external_id").cast("long")))
    return state.entities.select("id")


__all__ = ["ORACLE", "QUERIES"]
