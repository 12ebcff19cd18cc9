"""Upserts, merges, stale marks, checks, imports, versions and ingest."""

import json

import pytest

from graphloom.functions.values import unpacked_python
from graphloom.operators.governance import EntityType, SourcePolicy, State, edge_rows, entity_rows, field_violations, violations, with_defaults
from graphloom.operators.query import execute
from graphloom.plans.request import InvalidQuery, LimitExceeded
from graphloom.sources.graph import RelationType
from graphloom.sources.imports import apply_items, read_csv, read_jsonl
from graphloom.sources.store import Conflict, Store
from graphloom.streaming.ingest import Ingest


def fields(state, id_):
    row = state.entities.where(f"id = '{id_}'").head()
    return {k: unpacked_python(v) for k, v in row["fields"].items()}


def write(id_, source, priority, confidence=0.5, **fields):
    return {"id": id_, "kind": "host", "source": source, "external_id": f"{source}-{id_}", "source_priority": priority, "confidence": confidence, "fields": fields}


def test_fields_go_to_the_higher_priority(spark):
    s, _ = State.empty(spark).upsert(entity_rows(spark, [write("h", "manual", 100, name="a", region="x", note="")]))
    s, lost = s.upsert(entity_rows(spark, [write("h", "agent", 10, name="b", note="n", cpu=4), write("h", "cloud", 100, 0.9, region="y", cpu=None), write("h", "late", 100, 0.1, region="z")]))
    assert fields(s, "h") == {"name": "a", "region": "y", "note": "n", "cpu": 4.0}
    assert sorted((r["field"], r["incoming_source"]) for r in lost.collect()) == [("cpu", "cloud"), ("name", "agent"), ("region", "late")]
    row = s.entities.head()
    assert (row["source"], row["source_priority"], row["confidence"]) == ("manual", 100.0, 0.9)
    assert sorted(x["source"] for x in row["sources"]) == ["agent", "cloud", "late", "manual"]


def test_arrays_are_united_unless_replaced(spark):
    s = State.empty(spark).with_type(EntityType("host", fields={"tags": {"type": "array", "merge_strategy": "append_unique"}}))
    s, _ = s.upsert(entity_rows(spark, [write("h", "a", 10, tags=["z", "a", "a"]), write("h", "b", 1, tags=["c", "b", "a", "c"])]))
    assert fields(s, "h")["tags"] == ["z", "a", "a", "c", "b"]
    s, _ = s.upsert(entity_rows(spark, [{**write("h", "a", 10), "fields": {"tags!": ["new"]}}]))
    assert fields(s, "h")["tags"] == ["new"]
    with pytest.raises(InvalidQuery):
        s.with_type(EntityType("x", fields={"t": {"type": "string", "merge_strategy": "append_unique"}}))


def test_identity_joins_writes_and_ids_are_canonical(spark):
    s = State.empty(spark).with_type(EntityType("host", identity_keys={"by_name": (("hostname",), 0.3, "merge")}))
    s, _ = s.upsert(entity_rows(spark, [write("h1", "aws", 10, hostname="x")]))
    s, _ = s.upsert(entity_rows(spark, [write("other", "agent", 5, hostname="x", cpu=2), {"kind": "host", "source": "s", "external_id": "e", "fields": {}}]))
    got = {r["id"]: r["merged_from"] for r in s.entities.collect()}
    assert got["h1"] == ["other"] and len(got) == 2 and any(k.startswith("entity:") for k in got)
    assert s.entity_by_alias("other") == "h1" and s.entity_by_alias("none") is None


def graph(spark):
    s = State.empty(spark).with_relation(RelationType("works_at", ("person",), ("company",), "many_to_one"))
    s, _ = s.upsert(entity_rows(spark, [{"id": i, "kind": k, "source": "hr", "external_id": i, "fields": {"name": i}} for i, k in (("p1", "person"), ("p2", "person"), ("c1", "company"), ("c2", "company"))]))
    s, _ = s.upsert_edges(edge_rows(spark, [{"type": "works_at", "from": "p1", "to": "c1", "fields": {"since": 1}}, {"type": "works_at", "from": "p2", "to": "c2", "source_priority": 5, "fields": {"since": 2}}]))
    return s


def test_merge_split_delete_and_checks(spark):
    s = graph(spark)
    assert violations(s).count() == 0
    m = s.merge("c1", ["c2"])
    assert sorted((r["src"], r["dst"]) for r in m.edges.collect()) == [("p1", "c1"), ("p2", "c1")] and m.entities.where("id = 'c1'").head()["merged_from"] == ["c2"]
    one = s.merge("p1", ["p2"]).merge("c1", ["c2"])
    assert [unpacked_python(r["fields"]["since"]) for r in one.edges.collect()] == [2.0]
    assert {(r["type"], r["problem"]) for r in violations(s.merge("p1", ["p2"])).collect()} == {("works_at", "violates cardinality")}
    with pytest.raises(InvalidQuery):
        s.merge("c1", ["p1"])
    assert s.delete(["c1"]).edges.count() == 1
    out = s.split("c1", entity_rows(spark, [{"id": "c3", "kind": "company", "fields": {}}]))
    assert out.edges.count() == 1 and out.entities.where("id = 'c3'").count() == 1
    assert s.delete_relation("works_at").edges.count() == 0
    bad, _ = s.upsert_edges(edge_rows(spark, [{"type": "works_at", "from": "c1", "to": "c2"}, {"type": "no", "from": "p1", "to": "gone"}]))
    assert {r["problem"] for r in violations(bad).collect()} == {"from kind is not allowed", "missing relation type"}
    state, stay = s.delete_from_source(["p1"], "x", -1)
    assert stay == ["p1"] and state.entities.count() == 4


def test_checks_shuffle_no_edges_for_a_few_bad_ends(spark):
    """Each problem is told once, the first of those of an edge's ends, and besides it the cardinality."""
    ids = spark.createDataFrame([("p1", "person"), ("p2", "person"), ("c1", "company"), ("c2", "company")], "id string, kind string")
    rows = [("1", "at", "p1", "c1"), ("2", "at", "p2", "c1"), ("3", "at", "p2", "c2"), ("4", "at", None, "c2"), ("5", "at", "c1", None), ("6", "at", "c2", "p1"), ("7", "no", None, "x"), ("8", "led", "c1", "p1"), ("9", "led", "c2", "p1"), ("10", "led", "c2", "p2"), ("11", None, "p1", "c1")]
    rules = {"at": RelationType("at", ("person",), ("company",), "many_to_one"), "led": RelationType("led", ("company",), ("person",), "one_to_one")}
    state = State(spark, ids, spark.createDataFrame(rows, "id string, type string, src string, dst string"), rules)
    crowd = "violates cardinality"
    want = [("10", crowd), ("11", "missing relation type"), ("2", crowd), ("3", crowd), ("4", "missing from entity"), ("5", "missing to entity"), ("6", "from kind is not allowed"), ("7", "missing relation type"), ("8", crowd), ("9", crowd)]
    assert sorted((r["id"], r["problem"]) for r in violations(state).collect()) == want
    held = violations(state, hold=True)
    assert sorted((r["id"], r["problem"]) for r in held.collect()) == want
    assert "hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()


def test_stale_marks(spark):
    s = graph(spark)
    seen = spark.createDataFrame([("p1",), ("c1",)], "external_id string")
    marked = s.mark_stale("hr", seen, "person")
    assert {r["id"]: r["sources"][0]["stale"] for r in marked.entities.collect()} == {"p1": False, "p2": True, "c1": False, "c2": False}
    assert sorted(r["id"] for r in s.mark_stale("hr", seen, action="delete").entities.collect()) == ["c1", "p1"]


def test_types_defaults_and_policy(spark):
    s = State.empty(spark).with_type(EntityType("base", fields={"name": {"type": "string", "required": True}})).with_type(EntityType("host", ("base",), {"env": {"type": "string", "enum": ["dev", "prod"], "default": "dev"}, "ip": {"type": "string", "unique": True}, "cpu": {"type": "number"}}))
    rows = with_defaults(s, entity_rows(spark, [write("a", "x", 1, name="a", ip="1", alias_cpu=2), write("b", "y", 1, ip="1", env="odd", cpu="many")]))
    rows = SourcePolicy(3, {"x": 9}, (("", "alias_cpu", "cpu"),)).apply(rows)
    s, _ = s.upsert(rows)
    assert fields(s, "a") == {"name": "a", "ip": "1", "env": "dev", "cpu": 2.0}
    assert {r["id"]: r["source_priority"] for r in s.entities.collect()} == {"a": 9.0, "b": 3.0}
    assert {(r["id"], r["field"], r["problem"]) for r in field_violations(s).collect()} == {("b", "name", "required"), ("b", "env", "enum"), ("b", "cpu", "type"), ("a", "ip", "unique"), ("b", "ip", "unique")}


LINES = [
    {"external_id": "i-1", "entity": {"id": "host:1", "kind": "host", "source_priority": 10, "labels": ["b", "a"], "fields": {"hostname": "app", "cpu": 4, "on": True, "none": None, "tags": ["x"]}}},
    {"entity": {"id": "service:1", "kind": "service", "fields": {"name": 'a "q"'}}},
    {"external_id": "e", "edge": {"type": "runs_on", "from": "service:1", "to": "host:1", "fields": {"w": 0.5}}},
    {"entity": {"id": "x"}},
    {"entity": {"id": "x", "kind": "k"}, "edge": {"type": "t", "from": "a", "to": "b"}},
]


def test_jsonl_round_trip_versions_and_saved_queries(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join([*map(json.dumps, LINES), "not json"]))
    items, errors = read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert errors.count() == 3
    s, *_ = apply_items(State.empty(spark), items, "aws")
    assert fields(s, "host:1") == {"hostname": "app", "cpu": 4.0, "on": True, "none": None, "tags": ["x"], "labels": ["a", "b"]}
    store = Store(spark, str(tmp_path / "db"), "t1")
    assert store.save(s, 0) == 1
    with pytest.raises(Conflict):
        store.save(s, 0)
    store.export(str(tmp_path / "out"))
    again, bad = read_jsonl(spark, str(tmp_path / "out"))
    back, *_ = apply_items(State.empty(spark), again)
    assert bad.count() == 0 and fields(back, "host:1") == fields(s, "host:1") and fields(back, "service:1") == fields(s, "service:1") and back.edges.count() == 1
    store.save_query("apps", {"op": "match", "kind": "host", "where": [{"field": "labels", "op": "contains", "value": "a"}]})
    assert [r["entity"]["id"] for r in store.run_saved("apps")["results"]] == ["host:1"]
    assert store.clone("t2").current() == 1 and store.save(s) == 2 and store.vacuum() == [1] and store.versions() == [2]
    with pytest.raises(InvalidQuery):
        Store(spark, str(tmp_path), "../x")


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('record_type,id,kind,labels,type,from,to,hostname,cpu\nentity,h1,host,b|a,,,,app 1,8\nnode,s1,service,,,,,,\nedge,,,,runs_on,s1,h1,,\nodd,x,,,,,,,\n')
    items, errors = read_csv(spark, str(tmp_path / "in.csv"))
    s, *_ = apply_items(State.empty(spark), items, "csv")
    assert errors.count() == 1 and fields(s, "h1") == {"hostname": "app 1", "cpu": 8.0, "labels": ["a", "b"]} and s.edges.head()["src"] == "s1"


def test_ingest_once_noop_and_full_sync(spark, tmp_path):
    ingest = Ingest(Store(spark, str(tmp_path / "db")))
    lines = lambda items: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "seq long, line string")
    first = ingest.apply(lines(LINES[:3]), "k1", "aws")
    assert (first["version"], first["applied"], first["skipped"]) == (1, 3, False)
    assert ingest.apply(lines(LINES[:3]), "k1", "aws")["skip_reason"] == "idempotent_replay"
    assert ingest.apply(lines(LINES[:3]), "k2", "aws")["skip_reason"] == "logical_noop"
    bad = ingest.apply(lines(LINES[1:2] + LINES[3:]), "k3", "aws", full_sync=True)
    assert bad["failed"] == 2 and ingest.dead_letters().count() == 2 and ingest.store.current() == 1
    done = ingest.apply(lines(LINES[1:2]), "k4", "aws", full_sync=True, stale_action="mark_stale")
    assert done["version"] == 2
    assert {r["id"]: r["sources"][0]["stale"] for r in ingest.store.load().entities.collect()} == {"host:1": True, "service:1": False}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(map(json.dumps, LINES[:3])))
    ingest = Ingest(Store(spark, str(tmp_path / "db")))
    ingest.stream(spark, str(tmp_path / "in"), "aws", str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/b.jsonl").write_text(json.dumps({"entity": {"id": "host:2", "kind": "host", "fields": {}}}))
    ingest.stream(spark, str(tmp_path / "in"), "aws", str(tmp_path / "cp")).awaitTermination()
    state = ingest.store.load()
    assert state.version == 2 and sorted(r["id"] for r in state.entities.collect()) == ["host:1", "host:2", "service:1"]
    assert execute(state.graph(), {"op": "neighbors", "id": "host:1"})["results"][0]["entity"]["id"] == "service:1"


def test_ingest_keeps_types_rejects_and_replays(spark, tmp_path):
    """Type payloads take effect, what breaks them is a dead letter, and a replay applies letters that pass by then."""
    ingest = Ingest(Store(spark, str(tmp_path / "db")))
    lines = lambda items: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "seq long, line string")
    pen = {"entity": {"id": "pen:1", "kind": "pen", "fields": {"ink": "red"}}}
    edge = {"edge": {"type": "lies_on", "from": "pen:1", "to": "desk:1"}}
    first = ingest.apply(lines([{"relation_type": {"name": "lies_on", "from_kinds": ["pen"], "to_kinds": ["desk"]}}, pen, edge, {"edge": {"type": "none", "from": "pen:1", "to": "pen:1"}}]), "k1", "hand")
    state = ingest.store.load()
    assert (first["applied"], first["failed"]) == (2, 2) and state.relations["lies_on"].to_kinds == ("desk",) and state.edges.count() == 0
    ingest.apply(lines([{"entity": {"id": "desk:1", "kind": "desk", "fields": {}}}]), "k2", "hand")
    again = ingest.replay("hand")
    assert (again["scanned"], again["applied"], again["failed"]) == (2, 1, 1) and ingest.store.load().edges.head()["dst"] == "desk:1" and ingest.open_letters().count() == 1


def test_batches_of_an_import_in_order(spark):
    from graphloom.streaming.ingest import batches

    rows = spark.range(0, 230, 10).selectExpr("id as seq").repartition(3)
    assert batches(rows, 10) == [(0, 90), (100, 190), (200, 220)] and batches(rows.where("false"), 10) == []


def test_edge_names_and_quota(spark):
    s = graph(spark)
    s, _ = s.upsert_edges(edge_rows(spark, [{"type": "works_at", "from": "p1", "to": "c1", "source": "hr", "external_id": "raw"}, {"type": "works_at", "from": "p2", "to": "c2", "source": "hr", "external_id": "raw"}]))
    with pytest.raises(InvalidQuery):
        s.delete_edges(["raw"])
    s, _ = s.upsert_edges(edge_rows(spark, [{"type": "works_at", "from": "p1", "to": "c1", "source": "hr", "external_id": "own"}]))
    assert [r["src"] for r in s.delete_edges(["own"]).edges.collect()] == ["p2"]
    with pytest.raises(LimitExceeded):
        s.within_quota(entities=3)
    assert s.within_quota(entities=4, edges=2) is s
