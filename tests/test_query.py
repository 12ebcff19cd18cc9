"""The engine on small graphs whose answers are known."""

import json
import random
from collections import Counter

import pytest

from graphloom.demo import edge_counts
from graphloom.functions.values import number_text, python_text
from graphloom.operators import paths
from graphloom.operators.governance import State, edge_rows, entity_rows
from graphloom.operators.query import execute, frame, groups, kill, running, stream
from graphloom.plans.graphql import run_graphql
from graphloom.plans.request import InvalidQuery, LimitExceeded, parse
from graphloom.plans.textdsl import parse_text
from graphloom.sources.graph import Graph, RelationType


def ent(id_, kind, **fields):
    return {"id": id_, "kind": kind, "fields": fields}


def link(type_, src, dst, **fields):
    return {"type": type_, "from": src, "to": dst, "fields": fields}


def made(spark, entities, edges, relations=()):
    s = State.empty(spark)
    for r in relations:
        s = s.with_relation(r)
    s, _ = s.upsert(entity_rows(spark, entities))
    s, _ = s.upsert_edges(edge_rows(spark, edges))
    g = s.graph()
    return Graph(g.spark, {k: type(t)(t.df.cache(), t.edges) for k, t in g.kinds.items()}, type(g.edges)(g.edges.df.cache(), True), g.relations, g.version, False)


# A library: shelves hold books, books cite books, readers borrow them.  Every answer is computed by the plain evaluator below.
TOPICS = ["moss", "tides", "looms", "kites"]


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(11)
    things = {f"shelf:{i}": ("shelf", {"floor": i % 3, "title": f"Shelf {i}"}) for i in range(4)}
    for i in range(14):
        own = {"title": f"On {rng.choice(TOPICS)} {i}", "pages": rng.randrange(40, 400), "topic": rng.choice(TOPICS), "lent": rng.random() < 0.4}
        things[f"book:{i}"] = ("book", {k: v for k, v in own.items() if rng.random() < 0.85})
    things |= {f"reader:{i}": ("reader", {"title": f"R{i}", "age": rng.randrange(8, 80)}) for i in range(5)}
    links = {("on", f"book:{i}", f"shelf:{rng.randrange(4)}") for i in range(14)}
    links |= {("cites", f"book:{rng.randrange(14)}", f"book:{rng.randrange(14)}") for _ in range(18)}
    links |= {("borrows", f"reader:{rng.randrange(5)}", f"book:{rng.randrange(14)}") for _ in range(9)}
    links = {x: {"weight": rng.randrange(10)} for x in sorted(links) if x[1] != x[2]}
    relations = [RelationType(n, impact_direction=d, allow_cross_kind=True) for n, d in (("on", "forward"), ("cites", "reverse"), ("borrows", "none"))]
    g = made(spark, [ent(i, k, **f) for i, (k, f) in things.items()], [link(t, a, b, **f) for (t, a, b), f in links.items()], relations)
    return g, things, links


def ids(response):
    return [r["entity"]["id"] for r in response["results"]]


def plain(fields, field, op, value):
    """Whether a filter holds, by Python's own comparison."""
    there, x = field in fields, fields.get(field)
    if op == "exists":
        return there == value
    if not there:
        return False
    low, part = str(x).lower(), str(value).lower()
    if op == "fuzzy":
        rest = iter(low)
        return all(c in rest for c in part)
    tests = {"eq": lambda: x == value, "neq": lambda: x != value, "in": lambda: x in value, "gt": lambda: x > value, "gte": lambda: x >= value, "lt": lambda: x < value, "lte": lambda: x <= value, "prefix": lambda: str(x).startswith(value), "contains": lambda: part in low}
    return tests[op]()


@pytest.mark.parametrize(
    "words, field, op, value",
    [
        ("=", "topic", "eq", "moss"), ("!=", "topic", "neq", "moss"), ("IN", "topic", "in", ["looms", "kites"]), (">", "pages", "gt", 150), (">=", "pages", "gte", 212),
        ("<", "pages", "lt", 150), ("<=", "pages", "lte", 212), ("PREFIX", "title", "prefix", "On k"), ("CONTAINS", "title", "contains", "OOM"), ("FUZZY", "title", "fuzzy", "oti1"), ("EXISTS", "lent", "exists", True),
    ],
)
def test_each_filter_as_evaluated_plainly(library, words, field, op, value):
    g, things, _ = library
    want = sorted(i for i, (k, f) in things.items() if k == "book" and plain(f, field, op, value))
    shown = "" if op == "exists" else " " + json.dumps(value)
    assert ids(execute(g, parse_text(f"FIND book WHERE {field} {words}{shown}"))) == want
    assert ids(execute(g, {"op": "match", "kind": "book", "where": [{"field": field, "op": op, "value": value}]})) == want
    inverse = {"op": "not", "children": [{"field": field, "op": op, "value": value}]}
    assert ids(execute(g, {"op": "match", "kind": "book", "where_expr": inverse})) == sorted(i for i, (k, f) in things.items() if k == "book" and i not in want)


def test_pages_follow_sort_and_count_all(library):
    g, things, _ = library
    r = {"op": "match", "kind": "book", "where": [{"field": "pages", "op": "exists"}], "sort": [{"field": "pages", "desc": True}], "limit": 4, "aggregate": [{"op": "count"}]}
    want = sorted((i for i, (k, f) in things.items() if k == "book" and "pages" in f), key=lambda i: (-things[i][1]["pages"], i))
    got, cursor, first = [], "", ""
    while True:
        page = execute(g, {**r, "cursor": cursor})
        got += ids(page)
        first = first or page["next_cursor"]
        assert page["aggregates"] == {"count": len(want)}
        if not (cursor := page["next_cursor"]):
            break
    assert got == want
    with pytest.raises(InvalidQuery):
        execute(g, {"op": "match", "kind": "shelf", "cursor": first})


def test_groups_having_and_counts_within(library):
    g, things, _ = library
    books = [f for k, f in things.values() if k == "book"]
    want = {}
    for f in books:
        want.setdefault(f.get("topic"), []).append(f)
    r = {"op": "match", "kind": "book", "group_by": ["topic"], "aggregate": [{"op": "count"}, {"op": "avg", "field": "pages"}, {"op": "count_by", "field": "lent", "name": "by_lent"}]}
    got = {x["key"]["topic"]: x["aggregates"] for x in execute(g, r)["groups"]}
    assert set(got) == set(want)
    for topic, some in want.items():
        pages = [f["pages"] for f in some if "pages" in f]
        lent = Counter(str(f["lent"]).lower() if "lent" in f else "<nil>" for f in some)
        assert got[topic]["count"] == len(some) and got[topic]["avg_pages"] == (pytest.approx(sum(pages) / len(pages)) if pages else None) and got[topic]["by_lent"] == dict(lent)
    many = execute(g, {**r, "having": [{"field": "count", "op": "gte", "value": 4}]})["groups"]
    assert {x["key"]["topic"] for x in many} == {t for t, some in want.items() if len(some) >= 4}


def path_ids(response):
    return [[e["id"] for e in r["path"]["entities"]] for r in response["results"]]


def walks(links, start, hops):
    """Simple paths whose hops go along (relation, way) pairs."""
    held = [[start]]
    for relations, way in hops:
        steps = [(a, b) if way == "out" else (b, a) for t, a, b in links if t in relations]
        held = [[*p, y] for p in held for x, y in steps if x == p[-1] and y not in p]
    return sorted(held)


def test_paths_as_walked_plainly(library):
    g, things, links = library
    for start in ("book:0", "book:3", "reader:1"):
        steps = [{"direction": "out", "relation_types": ["cites", "borrows"]}, {"direction": "out", "relation_types": ["on"], "node_kinds": ["shelf"]}]
        got = frame(g, {"op": "traverse", "id": start, "depth": 2, "path": {"steps": steps}}).collect()
        assert sorted(r["path"].split(">") for r in got) == walks(links, start, [(("cites", "borrows"), "out"), (("on",), "out")])
        near = execute(g, {"op": "neighbors", "id": start, "edge_where": [{"field": "weight", "op": "gte", "value": 5}]})
        assert sorted((r["entity"]["id"], r["direction"]) for r in near["results"]) == sorted([(b, "out") for (t, a, b), f in links.items() if a == start and f["weight"] >= 5] + [(a, "in") for (t, a, b), f in links.items() if b == start and f["weight"] >= 5])
    found = frame(g, parse_text('MATCH reader STEP OUT REL borrows KIND book STEP OUT REL on')).collect()
    assert sorted(r["path"].split(">") for r in found) == sorted(p for i, (k, _) in things.items() if k == "reader" for p in walks(links, i, [(("borrows",), "out"), (("on",), "out")]))
    with pytest.raises(InvalidQuery):
        execute(g, {"op": "neighbors", "id": "book:none"})


def test_shortest_paths_as_by_breadth_first_search(library):
    g, _, links = library
    both = [(a, b) for _, a, b in links] + [(b, a) for _, a, b in links]
    for start, target in (("book:0", "book:5"), ("reader:1", "shelf:2"), ("shelf:0", "reader:4")):
        seen, level, length = {start}, {start}, 0
        while level and target not in seen and length < 6:
            level = {y for x, y in both if x in level} - seen
            seen |= level
            length += 1
        got = execute(g, {"op": "shortest_path", "id": start, "target_id": target, "depth": 6})["results"]
        assert [len(r["path"]["edges"]) for r in got] == ([length] if target in seen else [])
        for r in got:
            ends = [e["id"] for e in r["path"]["entities"]]
            assert ends[0] == start and ends[-1] == target and all(x in both for x in zip(ends, ends[1:]))
    stepped = {"op": "shortest_path", "id": "reader:1", "target_id": "shelf:2", "depth": 2, "path": {"steps": [{"direction": "out", "relation_types": ["borrows"]}, {"direction": "out", "relation_types": ["on"]}]}}
    want = [p for p in walks(links, "reader:1", [(("borrows",), "out"), (("on",), "out")]) if p[-1] == "shelf:2"]
    assert len(execute(g, stepped)["results"]) == min(len(want), 1)
    assert path_ids(execute(g, {"op": "shortest_path", "id": "book:1", "target_id": "book:1"})) == [["book:1"]]


def test_shortest_path_goes_from_both_ends(spark, monkeypatch):
    """Nodes that lie on no shortest path aren't reached, and of equally short paths the one with the least edge ids is found."""
    rows = [("s", "a"), ("a", "hub"), ("other", "a"), ("b", "hub"), ("b", "t"), ("other", "b"), *((f"leaf{i}", h) for i in range(300) for h in ("hub", "other"))]
    ids = sorted({x for row in rows for x in row})
    g = Graph.of(spark, {"n": spark.createDataFrame([(i,) for i in ids], "id string")}, spark.createDataFrame([("e", *row) for row in rows], "type string, src string, dst string"))
    written, seen = paths.written, []
    monkeypatch.setattr(paths, "written", lambda df: [out := written(df), seen.append(out.count())][0])
    got = frame(g, {"op": "shortest_path", "id": "s", "target_id": "t", "depth": 6}).head()
    assert max(seen) < 10
    names = {frozenset((r["src"], r["dst"])): r["id"] for r in g.edges.df.collect()}
    best = min([names[frozenset(p)] for p in zip(w, w[1:])] for w in (["s", "a", x, "b", "t"] for x in ("hub", "other")))
    assert got["edges"] == ">".join(best) and got["length"] == 4
    assert frame(g, {"op": "shortest_path", "id": "s", "target_id": "t", "depth": 3}).count() == 0


def test_edges_are_dealt_by_id_before_they_are_counted(spark):
    rows = [(t, f"edge:{i % 40}") for t in "ab" for i in range(100)]
    got = edge_counts(spark.createDataFrame(rows, "type string, id string"))
    assert sorted(map(tuple, got.collect())) == [("a", 100, 40), ("b", 100, 40)]
    deals = [x.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() + got._jdf.queryExecution().sparkPlan().toString().splitlines() if "hashpartitioning(" in x]
    assert deals and set(deals) == {"id"}


def test_a_plain_page_costs_no_more_than_it_reads(spark):
    g = Graph.of(spark, {"n": spark.range(300).selectExpr("format_string('n:%03d', id) as id")}, spark.createDataFrame([], "type string, src string, dst string"))
    ask = {"op": "match", "kind": "n", "limit": 50, "cost_limit": 60}
    first = execute(g, ask)
    assert [r["entity"]["id"] for r in first["results"]] == [f"n:{i:03d}" for i in range(50)]
    assert execute(g, {**ask, "cursor": first["next_cursor"]})["results"][0]["entity"]["id"] == "n:050"
    for dear in ({"limit": 60}, {"sort": [{"field": "id"}]}, {"aggregate": [{"op": "count"}]}):
        with pytest.raises(LimitExceeded):
            execute(g, {**ask, **dear})


def test_limits(library):
    g, *_ = library
    before = paths.held()
    with pytest.raises(LimitExceeded):
        execute(g, {"op": "match", "kind": "book", "cost_limit": 5})
    with pytest.raises(LimitExceeded):
        execute(g, {"op": "traverse", "id": "shelf:0", "depth": 8, "cost_limit": 10})
    with pytest.raises(LimitExceeded):
        execute(g, {"op": "traverse", "id": "shelf:0", "depth": 8, "timeout_ms": 1})
    assert running() == [] and not kill(g, "none") and paths.held() == before


def test_fuzzy_reads_a_long_text_once(spark):
    import time

    g = made(spark, [ent("d", "doc", text="ab]^-" * 40_000), ent("e", "doc", text="q]^-z")], [])
    began = time.perf_counter()
    assert ids(execute(g, {"op": "match", "where": [{"field": "text", "op": "fuzzy", "value": "ababababababz"}]})) == []
    assert ids(execute(g, {"op": "match", "where": [{"field": "text", "op": "fuzzy", "value": "]^-Z"}]})) == ["e"] and time.perf_counter() - began < 60


def test_literals(spark):
    g = made(spark, [ent("host:blue", "host", hostname='app "blue"', enabled=True, load=0.75, offset=-3, nullable=None), ent("host:red", "host", hostname="red-01", enabled=False, load=1.25, offset=5)], [])
    for text in ("enabled EQ true", "load LT 1.0", "offset LTE -3", "nullable = null", "EXISTS nullable", "hostname = 'app \"blue\"'"):
        assert ids(execute(g, parse_text(f"FIND host WHERE {text}"))) == ["host:blue"], text
    assert ids(execute(g, parse_text("FIND host SORT BY hostname DESC LIMIT 1"))) == ["host:red"]
    assert ids(execute(g, {"op": "match", "kind": "host", "where": [{"field": "load", "op": "prefix", "value": "1."}]})) == ["host:red"]


@pytest.fixture(scope="module")
def nodes(spark):
    rel = [RelationType("links", impact_direction="forward", allow_cross_kind=True), RelationType("feeds", impact_direction="reverse", allow_cross_kind=True), RelationType("peer", impact_direction="both", allow_cross_kind=True)]
    edges = [("links", 0, 1), ("links", 2, 0), ("links", 0, 0), ("feeds", 1, 3), ("links", 1, 4), ("feeds", 4, 0), ("peer", 3, 5), ("links", 5, 6), ("links", 2, 4)]
    return made(spark, [ent(f"node:{i}", "node", group=i % 2, score=i) for i in range(7)], [link(t, f"node:{a}", f"node:{b}") for t, a, b in edges], rel), edges


def simple_paths(edges, start, depth, ways):
    out, held = [], [[start]]
    for _ in range(depth):
        held = [[*p, y] for p in held for t, a, b in edges for x, y in ([(a, b)] if "out" in ways(t) else []) + ([(b, a)] if "in" in ways(t) else []) if x == p[-1] and y not in p]
        out += held
    return sorted(out)


@pytest.mark.parametrize("op, ways", [("out", lambda t: ["out"]), ("in", lambda t: ["in"]), ("both", lambda t: ["out", "in"]), ("impact", lambda t: {"links": ["out"], "feeds": ["in"], "peer": ["out", "in"]}[t])])
def test_simple_paths_as_by_hand(nodes, op, ways):
    g, edges = nodes
    request = {"op": "impact", "id": "node:0", "depth": 3} if op == "impact" else {"op": "traverse", "id": "node:0", "depth": 3, "direction": op}
    got = sorted([int(v.split(":")[1]) for v in r["path"].split(">")] for r in frame(g, request).collect())
    assert got == simple_paths(edges, 0, 3, ways)


def test_loop_is_two_neighbours_and_pages_cover_all(nodes):
    g, _ = nodes
    r = execute(g, {"op": "neighbors", "id": "node:0"})
    assert sorted((x["entity"]["id"], x["direction"]) for x in r["results"]) == [("node:0", "in"), ("node:0", "out"), ("node:1", "out"), ("node:2", "in"), ("node:4", "in")]
    whole, paged, cursor = path_ids(execute(g, {"op": "traverse", "id": "node:0", "depth": 3})), [], ""
    while True:
        page = execute(g, {"op": "traverse", "id": "node:0", "depth": 3, "limit": 4, "cursor": cursor})
        paged += path_ids(page)
        if not (cursor := page["next_cursor"]):
            break
    assert paged == whole and path_ids(execute(g, {"op": "traverse", "id": "node:0", "depth": 3, "path": {"max_paths": 3}})) == whole[:3]


def test_edge_conditions_groups_on_paths_and_plan(spark, nodes):
    g, _ = nodes
    by_end = groups(g, {"op": "traverse", "id": "node:0", "depth": 2, "direction": "out", "group_by": ["length"]}).collect()
    assert [(r["length"], r["count"]) for r in by_end] == [(1.0, 1), (2.0, 2)]
    plan = execute(g, {"op": "explain", "target_op": "match", "kind": "node", "where": [{"field": "score", "op": "gt", "value": 2}]})["plan"]
    assert plan["strategy"] == "field-index-scan" and "Scan" in plan["spark"]
    assert execute(g, {"op": "explain", "target_op": "traverse", "id": "node:0", "where": [{"field": "a", "value": 1}]})["plan"]["warnings"]
    assert "profile" in execute(g, {"op": "match", "kind": "node", "profile": True})
    rows = list(stream(g, {"op": "match", "kind": "node"}))
    assert rows[0]["meta"]["version"] == g.version and rows[-1]["done"]["returned"] == 7
    cut = made(spark, [ent("s", "service"), ent("h1", "host"), ent("h2", "host")], [link("runs_on", "s", "h1", status="active"), link("runs_on", "s", "h2", status="stale")])
    assert ids(execute(cut, {"op": "neighbors", "id": "s", "edge_where": [{"field": "status", "value": "active"}]})) == ["h1"]


def test_labels_and_contains(spark):
    g = made(spark, [{"id": "d1", "kind": "document", "labels": ["knowledge", "article"], "fields": {"n": [1, 2]}}, ent("d2", "document", labels="article x", n=[3])], [])
    assert ids(execute(g, {"op": "match", "where": [{"field": "labels", "op": "contains", "value": "article"}]})) == ["d1", "d2"]
    assert ids(execute(g, {"op": "match", "where": [{"field": "labels", "op": "contains", "value": "know"}]})) == []
    assert ids(execute(g, {"op": "match", "where": [{"field": "n", "op": "contains", "value": 3}]})) == ["d2"]


def test_graphql(library):
    g, things, _ = library
    doc = 'query Q($k: String = "book", $n: Int!) { g: graph(request: {op: "match", kind: $k, where: [{field: "pages", op: "gte", value: $n}], limit: 50}) { version ...F nextCursor @skip(if: true) } } fragment F on GraphQueryResult { rows: results }'
    out = run_graphql(g, doc, {"n": 200})
    assert [r["entity"]["id"] for r in out["data"]["g"]["rows"]] == sorted(i for i, (_, f) in things.items() if f.get("pages", 0) >= 200) and set(out["data"]["g"]) == {"version", "rows"}
    assert run_graphql(g, "{ graph(request: {op: \"none\"}) { version } }")["errors"]


@pytest.mark.parametrize("bad", [{"op": "x"}, {"op": "match", "limit": -1}, {"op": "match", "having": [{"field": "a", "value": 1}]}, {"op": "pattern", "kind": "a"}, {"op": "match", "where": [{"field": "a", "op": "in", "value": 1}]}, {"op": "match", "aggregate": [{"op": "sum"}]}, {"op": "match", "where_expr": {"op": "not", "children": []}}, {"op": "match", "odd": 1}])
def test_invalid_requests(bad):
    with pytest.raises(InvalidQuery):
        parse(bad)


def test_number_text(spark):
    from pyspark.sql import functions as F

    values = {0.0: "0", 8.0: "8", -3.5: "-3.5", 1e6: "1e+06", 1234567.0: "1.234567e+06", 123456789.0: "1.23456789e+08", 1e21: "1e+21", 0.0001: "0.0001", 0.00012: "0.00012", 0.00001: "1e-05", 999999.0: "999999", 2500000.5: "2.5000005e+06", 1e100: "1e+100"}
    rows = spark.createDataFrame([(k,) for k in values], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == values and all(python_text(k) == v for k, v in values.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_rows_without_the_sort_field_come_last_over_the_whole_table(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from graphloom import demo

    folder = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = db.execute(demo.ORACLE["match_sort_missing_ranked"]).fetchall()
    got = [tuple(r) for r in demo.QUERIES["match_sort_missing_ranked"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r[3]) == sorted(want, key=lambda r: r[3])
    assert {r[2] for r in got} == {0.0, 1.0, None} and len(got) == db.execute("SELECT count(*) FROM documents").fetchone()[0]
