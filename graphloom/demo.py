"""The property graph over the TPC-H-like tables, and a query for each operator with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import VALUE, Value
from graphloom.operators.governance import EntityType, State, missing_from_source, redirected, violations
from graphloom.operators.query import aggregates, count_by, frame, groups, ranked, scan_edges, scan_entities
from graphloom.plans.textdsl import parse_text
from graphloom.sources.graph import Graph, RelationType, edge_id

RELATIONS = {
    r.name: r
    for r in (
        RelationType("in_region", ("nation",), ("region",), "many_to_one", "reverse"),
        RelationType("lives_in", ("customer",), ("nation",), "many_to_one", "reverse"),
        RelationType("located_in", ("supplier",), ("nation",), "many_to_one", "reverse"),
        RelationType("placed", ("customer",), ("order",), "one_to_many", "forward"),
        RelationType("contains", ("order",), ("part",), "many_to_many", "forward"),
        RelationType("supplies", ("supplier",), ("part",), "many_to_many", "forward"),
    )
}


def _id(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


_OPEN: dict[tuple[str, str], Graph] = {}


def opened(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder's tables: plans only, made once for each application and folder, as a handle of one version is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = build(spark, sf_dir)
    return _OPEN[key]


def build(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier, part, orders, lineitem = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    docs, labels = read("documents"), read("labels")
    flags = F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    kinds = {
        "region": region.select(_id("region", "r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("__key"), F.col("r_name").alias("name")),
        "nation": nation.select(_id("nation", "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("__key"), F.col("n_name").alias("name")),
        "customer": customer.select(_id("customer", "c_custkey").alias("id"), F.col("c_custkey").cast("long").alias("__key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment")),
        "supplier": supplier.select(_id("supplier", "s_suppkey").alias("id"), F.col("s_suppkey").cast("long").alias("__key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")),
        "part": part.select(_id("part", "p_partkey").alias("id"), F.col("p_partkey").cast("long").alias("__key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice")),
        "order": orders.select(_id("order", "o_orderkey").alias("id"), F.col("o_orderkey").cast("long").alias("__key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderdate").alias("orderdate"), F.col("o_orderpriority").alias("priority")),
        "user": read("events").select(_id("user", "user_id").alias("id"), F.col("user_id").cast("long").alias("__key")).distinct(),
        "document": docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
            _id("document", "doc_id").alias("id"), F.col("doc_id").cast("long").alias("__key"), "source", "text", "lang", "quality", "toxic", F.when(F.col("quality").isNotNull(), flags).alias("labels")
        ),
    }

    def edge(df: DataFrame, type_: str, src: tuple[str, str], dst: tuple[str, str], *fields: str) -> DataFrame:
        own = {f: F.col(f).cast("double") if f in fields else F.lit(None).cast("double") for f in ("qty", "lines", "revenue")}
        keys = [c for end, (kind, key) in (("src", src), ("dst", dst)) for c in (F.lit(kind).alias(f"{end}_kind"), F.col(key).cast("long").alias(f"{end}_key"))]
        return df.select(F.lit(type_).alias("type"), _id(*src).alias("src"), _id(*dst).alias("dst"), *keys, *(c.alias(n) for n, c in own.items()))

    lines = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("lines"), F.sum("l_extendedprice").alias("revenue"))
    supplied = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    edges = reduce(
        DataFrame.unionByName,
        (
            edge(nation, "in_region", ("nation", "n_nationkey"), ("region", "n_regionkey")),
            edge(customer, "lives_in", ("customer", "c_custkey"), ("nation", "c_nationkey")),
            edge(supplier, "located_in", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
            edge(orders, "placed", ("customer", "o_custkey"), ("order", "o_orderkey")),
            edge(lines, "contains", ("order", "l_orderkey"), ("part", "l_partkey"), "qty", "lines", "revenue"),
            edge(supplied, "supplies", ("supplier", "l_suppkey"), ("part", "l_partkey"), "lines"),
        ),
    )
    return Graph.of(spark, kinds, edges, RELATIONS)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_EDGES = """
    e0 AS (
        SELECT 'in_region' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, NULL::DOUBLE AS qty, NULL::DOUBLE AS lines FROM nation
        UNION ALL SELECT 'lives_in', 'customer:' || c_custkey, 'nation:' || c_nationkey, NULL, NULL FROM customer
        UNION ALL SELECT 'located_in', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, NULL, NULL FROM supplier
        UNION ALL SELECT 'placed', 'customer:' || o_custkey, 'order:' || o_orderkey, NULL, NULL FROM orders
        UNION ALL SELECT 'contains', 'order:' || l_orderkey, 'part:' || l_partkey, sum(l_quantity), count(*)::DOUBLE FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey, NULL, count(*)::DOUBLE FROM lineitem GROUP BY ALL),
    e AS (SELECT *, 'edge:' || substr(sha256(type || chr(0) || src || chr(0) || dst), 1, 32) AS id FROM e0)"""


def _query(name: str, oracle: str | None, edges: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(opened(spark, sf_dir))
        if oracle:
            ORACLE[name] = (f"WITH {_EDGES}\n" if edges else "") + oracle
        return f

    return add


def _frame(name: str, request: dict | str, oracle: str, limit: int | None = None, offset: int = 0, edges: bool = False) -> None:
    _query(name, oracle, edges)(lambda g: frame(g, parse_text(request) if isinstance(request, str) else request, limit, offset))


def _flt(field: str, op: str, value=None) -> dict:
    return {"field": field, "op": op, "value": value}


_CUSTOMER = "SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, c_name AS name, c_acctbal AS acctbal FROM customer"
_DOCUMENT = "SELECT 'document:' || doc_id AS id, 'document' AS kind, quality::DOUBLE AS quality FROM documents LEFT JOIN labels USING (doc_id)"

_frame("match_kind", {"op": "match", "kind": "nation", "project": ["name"]}, "SELECT 'nation:' || n_nationkey AS id, 'nation' AS kind, n_name AS name FROM nation")
_frame("match_id", {"op": "match", "kind": "customer", "where": [_flt("id", "eq", "customer:7")], "project": ["name", "acctbal"]}, f"{_CUSTOMER} WHERE c_custkey = 7")
_frame("match_eq", {"op": "match", "kind": "customer", "filters": {"mktsegment": "BUILDING"}, "project": ["name", "acctbal"]}, f"{_CUSTOMER} WHERE c_mktsegment = 'BUILDING'")
_frame("match_neq_missing", {"op": "match", "kind": "document", "where": [_flt("quality", "neq", 1)], "project": ["quality"]}, f"{_DOCUMENT} WHERE quality <> 1")
_frame("match_in", {"op": "match", "kind": "customer", "where": [_flt("mktsegment", "in", ["BUILDING", "MACHINERY"])], "project": ["name", "acctbal"]}, f"{_CUSTOMER} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_frame("match_range", {"op": "match", "kind": "order", "where": [_flt("totalprice", "gte", 100000), _flt("totalprice", "lt", 150000)], "project": ["totalprice"]},
       "SELECT 'order:' || o_orderkey AS id, 'order' AS kind, o_totalprice AS totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
_frame("match_text_range", {"op": "match", "kind": "order", "where": [_flt("orderdate", "gte", "1997-01-01"), _flt("status", "gt", "F")], "project": ["orderdate"]},
       "SELECT 'order:' || o_orderkey AS id, 'order' AS kind, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus > 'F'")
_frame("match_prefix", {"op": "match", "kind": "customer", "where": [_flt("name", "prefix", "Customer#00000001")], "project": ["name", "acctbal"]}, f"{_CUSTOMER} WHERE starts_with(c_name, 'Customer#00000001')")
_frame("match_contains_text", {"op": "match", "kind": "document", "where": [_flt("text", "contains", "LICENSE")], "project": ["quality"]}, f"{_DOCUMENT} WHERE contains(lower(text), 'license')")
_frame("match_contains_array", {"op": "match", "kind": "document", "where": [_flt("labels", "contains", "toxic")], "project": ["quality"]}, f"{_DOCUMENT} WHERE toxic = 1")
_frame("match_fuzzy", {"op": "match", "kind": "part", "where": [_flt("ptype", "fuzzy", "sTd")], "project": ["ptype"]},
       "SELECT 'part:' || p_partkey AS id, 'part' AS kind, p_type AS ptype FROM part WHERE lower(p_type) LIKE '%s%t%d%'")
_frame("match_exists", {"op": "match", "kind": "document", "where": [_flt("quality", "exists", False)], "project": ["quality"]}, f"{_DOCUMENT} WHERE quality IS NULL")
_frame("match_bool_expr", {"op": "match", "kind": "customer", "where_expr": {"op": "and", "children": [
            {"op": "or", "children": [_flt("acctbal", "gte", 5000), _flt("mktsegment", "eq", "BUILDING")]},
            {"op": "not", "children": [_flt("name", "contains", "9")]}]}, "project": ["name", "acctbal"]},
       f"{_CUSTOMER} WHERE (c_acctbal >= 5000 OR c_mktsegment = 'BUILDING') AND NOT contains(c_name, '9')")
_frame("match_project", {"op": "match", "kind": "part", "where": [_flt("size", "eq", 15)], "project": ["brand", "fields.size", "nothing"]},
       "SELECT 'part:' || p_partkey AS id, 'part' AS kind, p_brand AS brand, p_size::DOUBLE AS \"fields.size\", NULL::VARCHAR AS nothing FROM part WHERE p_size = 15")
_frame("match_any_kind", {"op": "match", "where": [_flt("acctbal", "gt", 9000)], "project": ["name"]},
       """SELECT 'customer:' || c_custkey AS id, 'customer' AS kind, c_name AS name FROM customer WHERE c_acctbal > 9000
          UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier WHERE s_acctbal > 9000""")  # fmt: skip
_frame("match_sort_topk", {"op": "match", "kind": "customer", "where": [_flt("acctbal", "gte", 0)], "sort": [{"field": "acctbal", "desc": True}], "project": ["name", "acctbal"]},
       f"{_CUSTOMER} WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC, id LIMIT 50", limit=50)
_query("match_sort_missing_ranked", f"SELECT *, row_number() OVER (ORDER BY quality NULLS LAST, id) AS rank FROM ({_DOCUMENT})")(
    lambda g: ranked(g, {"op": "match", "kind": "document", "sort": [{"field": "quality"}], "project": ["quality"]}))
_frame("match_page2", {"op": "match", "kind": "customer", "sort": [{"field": "mktsegment"}], "project": ["name", "acctbal"]}, f"{_CUSTOMER} ORDER BY c_mktsegment, id LIMIT 40 OFFSET 40", limit=40, offset=40)
_frame("text_find", 'FIND customer WHERE acctbal >= 9000 AND NOT mktsegment IN ["BUILDING"] PROJECT name, acctbal', f"{_CUSTOMER} WHERE c_acctbal >= 9000 AND c_mktsegment <> 'BUILDING'")

_query("agg_global", """SELECT count(*) AS count, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most
                        FROM customer WHERE c_mktsegment = 'BUILDING'""")(
    lambda g: aggregates(g, {"op": "match", "kind": "customer", "filters": {"mktsegment": "BUILDING"}, "aggregate": [
        {"op": "count"}, {"op": "sum", "field": "acctbal", "name": "total"}, {"op": "avg", "field": "acctbal", "name": "mean"}, {"op": "min", "field": "acctbal", "name": "least"}, {"op": "max", "field": "acctbal", "name": "most"}]}))
_query("agg_count_by", "SELECT coalesce(quality::VARCHAR, '<nil>') AS value, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")(
    lambda g: count_by(g, {"op": "match", "kind": "document"}, "quality"))
_query("agg_group_having", """SELECT o_orderpriority AS priority, count(*) AS count, avg(o_totalprice) AS mean FROM orders
                              GROUP BY 1 HAVING count(*) >= 10 AND avg(o_totalprice) > 1000""")(
    lambda g: groups(g, {"op": "match", "kind": "order", "group_by": ["priority"], "aggregate": [{"op": "count"}, {"op": "avg", "field": "totalprice", "name": "mean"}],
                         "having": [_flt("count", "gte", 10), _flt("mean", "gt", 1000)]}))
_query("agg_group_missing", "SELECT lang, quality::DOUBLE AS quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")(
    lambda g: groups(g, {"op": "match", "kind": "document", "group_by": ["lang", "quality"]}))

_NEAR = "SELECT dst AS id, id AS edge_id, 'out' AS direction FROM e WHERE src = '{0}' {1}"
_INTO = "SELECT src AS id, id AS edge_id, 'in' AS direction FROM e WHERE dst = '{0}' {1}"
_frame("neighbors_out", {"op": "neighbors", "id": "customer:7", "direction": "out"}, _NEAR.format("customer:7", ""), edges=True)
_frame("neighbors_in", {"op": "neighbors", "id": "nation:3", "direction": "in", "relation_types": ["lives_in"]}, _INTO.format("nation:3", "AND type = 'lives_in'"), edges=True)
_frame("neighbors_both", {"op": "neighbors", "id": "nation:3"}, _NEAR.format("nation:3", "") + " UNION ALL " + _INTO.format("nation:3", ""), edges=True)
_frame("neighbors_edge_where", {"op": "neighbors", "id": "supplier:5", "direction": "out", "edge_where": [_flt("lines", "gte", 2)], "where": [_flt("size", "lt", 30)]},
       _NEAR.format("supplier:5", "AND lines >= 2 AND dst IN (SELECT 'part:' || p_partkey FROM part WHERE p_size < 30)"), edges=True)
_frame("neighbors_project", {"op": "neighbors", "id": "nation:3", "direction": "in", "path": {"node_kinds": ["customer"]}, "where": [_flt("acctbal", "gt", 5000)], "project": ["name"]},
       "SELECT e.src AS id, e.id AS edge_id, 'in' AS direction, c_name AS name FROM e JOIN customer ON e.src = 'customer:' || c_custkey WHERE e.dst = 'nation:3' AND c_acctbal > 5000", edges=True)
_frame("neighbors_impact", {"op": "neighbors", "id": "nation:3", "direction_strategy": "impact"}, _INTO.format("nation:3", ""), edges=True)
_query("neighbors_group", "SELECT c_mktsegment AS mktsegment, count(*) AS count, sum(c_acctbal) AS total FROM customer WHERE c_nationkey = 3 GROUP BY 1")(
    lambda g: groups(g, {"op": "neighbors", "id": "nation:3", "direction": "in", "relation_type": "lives_in", "group_by": ["mktsegment"], "aggregate": [{"op": "count"}, {"op": "sum", "field": "acctbal", "name": "total"}]}))


def _hops(start: str, n: int, view: str, where: str = "") -> str:
    """SQL of simple paths of 1 to n hops over a view (cur, nxt, id)."""
    levels = [f"p1 AS (SELECT [v.cur, v.nxt] AS vs, [v.id] AS es, v.nxt AS cur FROM {view} v WHERE v.cur = '{start}' AND v.cur <> v.nxt)"]
    levels += [f"p{k} AS (SELECT list_append(vs, v.nxt) AS vs, list_append(es, v.id) AS es, v.nxt AS cur FROM p{k - 1} p JOIN {view} v ON p.cur = v.cur WHERE NOT list_contains(vs, v.nxt))" for k in range(2, n + 1)]
    return ", ".join(levels) + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, n + 1)) + ")"


_OUT = "o AS (SELECT src AS cur, dst AS nxt, id, type FROM e)"
_BACK = "i AS (SELECT dst AS cur, src AS nxt, id, type FROM e)"
_SHOW = "SELECT array_to_string(vs, '>') AS path, array_to_string(es, '>') AS edges, len(es)::BIGINT AS length, cur AS end_id FROM p"


def _path(name: str, request: dict, ctes: str, tail: str = "", limit: int | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: frame(opened(spark, sf_dir), request, limit)
    ORACLE[name] = f"WITH {_EDGES}, {ctes} {_SHOW} {tail}".replace("e AS (SELECT *", "e AS MATERIALIZED (SELECT *", 1)


_path("traverse_d2", {"op": "traverse", "id": "customer:7", "direction": "out", "depth": 2}, _OUT + ", " + _hops("customer:7", 2, "o"))
_path("traverse_both", {"op": "traverse", "id": "region:1", "depth": 2, "relation_types": ["in_region", "located_in"]},
      "b AS (SELECT src AS cur, dst AS nxt, id FROM e WHERE type IN ('in_region', 'located_in') UNION ALL SELECT dst, src, id FROM e WHERE type IN ('in_region', 'located_in')), " + _hops("region:1", 2, "b"))
_path("traverse_end_filter", {"op": "traverse", "id": "region:1", "direction": "in", "depth": 3, "relation_types": ["in_region", "lives_in", "located_in"], "path": {"end_kind": "customer", "end_where": [_flt("acctbal", "gt", 8000)]}},
      _BACK.replace("FROM e", "FROM e WHERE type IN ('in_region', 'lives_in', 'located_in')") + ", " + _hops("region:1", 3, "i"), "WHERE cur IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 8000)")
_path("traverse_steps", {"op": "traverse", "id": "nation:3", "direction": "in", "depth": 3, "path": {"steps": [
          {"relation_types": ["lives_in"], "node_kinds": ["customer"], "where": [_flt("mktsegment", "eq", "BUILDING")]},
          {"direction": "out", "relation_types": ["placed"]},
          {"direction": "out", "relation_types": ["contains"], "edge_where": [_flt("qty", "gte", 40)]}]}},
      """p AS (SELECT [a.dst, a.src, b.dst, c.dst] AS vs, [a.id, b.id, c.id] AS es, c.dst AS cur
               FROM e a JOIN customer ON a.src = 'customer:' || c_custkey AND c_mktsegment = 'BUILDING'
               JOIN e b ON b.src = a.src AND b.type = 'placed' JOIN e c ON c.src = b.dst AND c.type = 'contains' AND c.qty >= 40
               WHERE a.type = 'lives_in' AND a.dst = 'nation:3')""")  # fmt: skip
_path("traverse_max_paths", {"op": "traverse", "id": "region:1", "direction": "in", "depth": 2, "path": {"max_paths": 20}}, _BACK + ", " + _hops("region:1", 2, "i"), "ORDER BY es, vs LIMIT 20")
_path("impact_forward", {"op": "impact", "id": "customer:7", "depth": 2}, "o AS (SELECT src AS cur, dst AS nxt, id FROM e WHERE type IN ('placed', 'contains', 'supplies') UNION ALL SELECT dst, src, id FROM e WHERE type IN ('in_region', 'lives_in', 'located_in')), " + _hops("customer:7", 2, "o"))
_path("impact_reverse", {"op": "impact", "id": "region:2", "depth": 2}, "o AS (SELECT src AS cur, dst AS nxt, id FROM e WHERE type IN ('placed', 'contains', 'supplies') UNION ALL SELECT dst, src, id FROM e WHERE type IN ('in_region', 'lives_in', 'located_in')), " + _hops("region:2", 2, "o"))
_path("pattern_2step", {"op": "pattern", "kind": "supplier", "where": [_flt("acctbal", "lt", 0)], "path": {"steps": [{"relation_types": ["located_in"]}, {"relation_types": ["in_region"]}]}},
      """p AS (SELECT [a.src, a.dst, b.dst] AS vs, [a.id, b.id] AS es, b.dst AS cur FROM e a JOIN e b ON a.dst = b.src AND a.type = 'located_in' AND b.type = 'in_region'
               JOIN supplier ON a.src = 'supplier:' || s_suppkey AND s_acctbal < 0)""")  # fmt: skip
_path("pattern_3step_filtered", {"op": "pattern", "kind": "region", "where": [_flt("name", "eq", "ASIA")], "path": {"steps": [
          {"direction": "in", "relation_types": ["in_region"], "node_kinds": ["nation"]},
          {"direction": "in", "relation_types": ["lives_in"], "where": [_flt("acctbal", "gt", 5000)]},
          {"relation_types": ["placed"], "where": [_flt("priority", "prefix", "1")]}]}},
      """p AS (SELECT [a.dst, a.src, b.src, c.dst] AS vs, [a.id, b.id, c.id] AS es, c.dst AS cur
               FROM e a JOIN region ON a.dst = 'region:' || r_regionkey AND r_name = 'ASIA' AND a.type = 'in_region'
               JOIN e b ON b.dst = a.src AND b.type = 'lives_in' JOIN customer ON b.src = 'customer:' || c_custkey AND c_acctbal > 5000
               JOIN e c ON c.src = b.src AND c.type = 'placed' JOIN orders ON c.dst = 'order:' || o_orderkey AND starts_with(o_orderpriority, '1'))""")  # fmt: skip
_query("pattern_agg_end", "SELECT dst AS end_id, count(*) AS count FROM (SELECT b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'lives_in' AND b.type = 'in_region') GROUP BY 1", True)(
    lambda g: groups(g, {"op": "pattern", "kind": "customer", "path": {"steps": [{"relation_types": ["lives_in"]}, {"relation_types": ["in_region"]}]}, "group_by": ["end_id"]}))
_path("path_project_end", {"op": "traverse", "id": "region:1", "direction": "in", "depth": 1, "project": ["name"]}, _BACK + ", " + _hops("region:1", 1, "i"))
ORACLE["path_project_end"] = ORACLE["path_project_end"].replace("cur AS end_id FROM p", "cur AS end_id, n_name AS name FROM p JOIN nation ON cur = 'nation:' || n_nationkey")
_TWO_NATIONS = """p AS (SELECT [a.dst, a.src, b.dst, c.src, d.dst] AS vs, [a.id, b.id, c.id, d.id] AS es, d.dst AS cur
               FROM e a JOIN e b ON a.src = b.src AND b.type = 'supplies' JOIN e c ON c.dst = b.dst AND c.type = 'supplies' AND c.src <> a.src
               JOIN e d ON d.src = c.src AND d.type = 'located_in' AND d.dst = 'nation:4' WHERE a.type = 'located_in' AND a.dst = 'nation:3')"""
# Over these two relations no path between two nations is shorter than four hops.
_path("shortest_path", {"op": "shortest_path", "id": "nation:3", "target_id": "nation:4", "depth": 5, "relation_types": ["located_in", "supplies"]}, _TWO_NATIONS, "ORDER BY es LIMIT 1")
_path("shortest_path_stepped", {"op": "shortest_path", "id": "nation:3", "target_id": "nation:4", "depth": 4, "path": {"steps": [
          {"direction": "in", "relation_types": ["located_in"]}, {"direction": "out", "relation_types": ["supplies"]},
          {"direction": "in", "relation_types": ["supplies"]}, {"direction": "out", "relation_types": ["located_in"]}]}},
      _TWO_NATIONS, "ORDER BY es LIMIT 1")
_query("scan_entities_source", "SELECT 'document:' || doc_id AS id, 'document' AS kind, source FROM documents WHERE source = 'src3' ORDER BY id LIMIT 100")(
    lambda g: scan_entities(g, "document", "src3"))
_query("scan_edges_type", "SELECT id, type, src AS \"from\", dst AS \"to\" FROM e WHERE type = 'placed' AND id > 'edge:8' ORDER BY id LIMIT 200", True)(
    lambda g: scan_edges(g, "placed", after="edge:8", limit=200))


def edge_counts(edges: DataFrame) -> DataFrame:
    """type, edges, ids: dealt by id before they are counted, as a table of the ids of an unfinished task would hold all its edges and combine none."""
    return edges.select("type", "id").repartition("id").groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("id").alias("ids"))


_query("dedupe_canonical_edges", "SELECT type, count(*) AS edges, count(DISTINCT id) AS ids FROM e GROUP BY 1", True)(
    lambda g: edge_counts(g.edges.df))


def _entities(df: DataFrame, kind: str, source: str, rank: float, sure: float, seq: int, **fields: F.Column) -> DataFrame:
    """Entity writes of a table with columns id and external_id."""
    packed = F.create_map(*(x for name, c in fields.items() for x in (F.lit(name), c)))
    kept = F.map_filter(packed, lambda _k, v: v.isNotNull())
    return df.select(
        F.lit(seq).cast("long").alias("seq"), "id", F.lit(kind).alias("kind"), F.lit(source).alias("source"), "external_id", F.lit(float(sure)).alias("confidence"),
        F.lit(float(rank)).alias("source_priority"), kept.alias("fields"), F.array().cast("array<string>").alias("replaced"),
    )


def _text(c: F.Column) -> F.Column:
    return Value.of(c, T.StringType()).packed().cast(VALUE)


def _number(c: F.Column) -> F.Column:
    return Value.of(c, T.DoubleType()).packed().cast(VALUE)


def _parties(spark: SparkSession, sf_dir: str):
    """Customers as two sources see them: crm knows all, billing with higher priority those with orders."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    crm = read("customer").select(_id("party", "c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("external_id"), "c_name", "c_acctbal", "c_mktsegment")
    billed = read("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.max("o_orderpriority").alias("priority"))
    billed = billed.select(_id("party", "o_custkey").alias("id"), F.col("o_custkey").cast("string").alias("external_id"), "total", "priority")
    tags = lambda *c: F.struct(F.lit("raw").alias("k"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.to_json(F.array(*c)).alias("j"))
    one = _entities(crm, "party", "crm", 50, 0.9, 0, name=_text(F.col("c_name")), balance=_number(F.col("c_acctbal")), segment=_text(F.col("c_mktsegment")), tags=tags(F.lit("crm"), F.col("c_mktsegment")))
    two = _entities(billed, "party", "billing", 100, 0.5, 1, balance=_number(F.col("total")), segment=_text(F.lit("")), priority=_text(F.col("priority")), tags=tags(F.col("priority"), F.lit("crm")))
    three = _entities(crm, "party", "late", 10, 1.0, 2, name=_text(F.lit("late")), note=_text(F.lit("n")))
    state = State.empty(spark).with_type(EntityType("party", fields={"tags": {"type": "array", "merge_strategy": "append_unique"}}))
    return state.upsert(one.unionByName(two).unionByName(three))


_BILLED = "WITH b AS (SELECT o_custkey, sum(o_totalprice) AS total, max(o_orderpriority) AS priority FROM orders GROUP BY 1)"


def _governance(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


@_governance("governance_field_merge", _BILLED + """
    SELECT 'party:' || c_custkey AS id, c_name AS name, coalesce(total, c_acctbal) AS balance, c_mktsegment AS segment, priority, 'n' AS note, 'crm' AS source,
           CASE WHEN total IS NULL THEN 50.0 ELSE 100.0 END AS source_priority
    FROM customer LEFT JOIN b ON c_custkey = o_custkey""")  # fmt: skip
def governance_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fields")
    return _parties(spark, sf_dir)[0].entities.select("id", f["name"]["s"].alias("name"), f["balance"]["n"].alias("balance"), f["segment"]["s"].alias("segment"), f["priority"]["s"].alias("priority"), f["note"]["s"].alias("note"), "source", "source_priority")


@_governance("governance_append_unique", _BILLED + """
    SELECT 'party:' || c_custkey AS id, '["crm","' || c_mktsegment || '"' || CASE WHEN priority IS NULL THEN '' ELSE ',"' || priority || '"' END || ']' AS tags
    FROM customer LEFT JOIN b ON c_custkey = o_custkey""")  # fmt: skip
def governance_append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir)[0].entities.select("id", F.col("fields")["tags"]["j"].alias("tags"))


@_governance("governance_conflicts", """
    SELECT 'name' AS field, 'late' AS incoming_source, count(*) AS n FROM customer
    UNION ALL SELECT 'segment', 'billing', count(DISTINCT o_custkey) FROM orders""")  # fmt: skip
def governance_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir)[1].groupBy("field", "incoming_source").agg(F.count("*").alias("n"))


@_governance("entity_merge_redirect", """
    SELECT 'edge:' || substr(sha256('supplies' || chr(0) || src || chr(0) || dst), 1, 32) AS id, src, dst
    FROM (SELECT DISTINCT 'supplier:' || (l_suppkey // 2 * 2) AS src, 'part:' || l_partkey AS dst FROM lineitem)""")  # fmt: skip
def entity_merge_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of odd key merge into their neighbour: their edges move, and those that fall together are one."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    edges = lines.select(F.lit("supplies").alias("type"), _id("supplier", "l_suppkey").alias("src"), _id("part", "l_partkey").alias("dst"))
    rows = edges.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
    like = State.empty(spark).edges
    missing = {c.name: F.lit(None).cast(c.dataType).alias(c.name) for c in like.schema if c.name not in rows.columns}
    meta = {"source": F.lit("").alias("source"), "external_id": F.lit("").alias("external_id"), "confidence": F.lit(0.0).alias("confidence"), "source_priority": F.lit(0.0).alias("source_priority")}
    rows = rows.select(*(meta.get(c, missing.get(c, F.col(c))) for c in like.columns))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 1")
    moves = keys.select(_id("supplier", "s_suppkey").alias("old"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") - 1).cast("string")).alias("new"))
    return redirected(rows, moves).select("id", "src", "dst")


@_governance("full_sync_stale", "SELECT 'document:' || doc_id AS id FROM documents WHERE source = 'src3' AND doc_id % 2 = 1")
def full_sync_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source that a full sync didn't name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.struct(F.col("source").alias("source"), F.col("doc_id").cast("string").alias("external_id"))
    entities = docs.select(_id("document", "doc_id").alias("id"), F.lit("document").alias("kind"), F.array(source).alias("sources"))
    observed = docs.where("source = 'src3' and doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("external_id"))
    return missing_from_source(entities, "src3", observed, "document")


@_governance("cardinality_violations", "SELECT 'edge:' || substr(sha256('made_by' || chr(0) || src || chr(0) || dst), 1, 32) AS id, 'made_by' AS type, 'violates cardinality' AS problem FROM (SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem) QUALIFY count(*) OVER (PARTITION BY src) > 1")
def cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts have several suppliers, so a many-to-one relation from part to supplier is broken."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = table.select("l_suppkey", "l_partkey").distinct()
    edges = lines.select(F.lit("made_by").alias("type"), _id("part", "l_partkey").alias("src"), _id("supplier", "l_suppkey").alias("dst"))
    edges = edges.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))
    ends = lambda kind, key: table.select(key).distinct().select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"))
    return violations(State(spark, ends("part", "l_partkey").unionByName(ends("supplier", "l_suppkey")), edges, {"made_by": RelationType("made_by", ("part",), ("supplier",), "many_to_one")}), hold=True)
