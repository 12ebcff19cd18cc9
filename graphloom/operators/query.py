"""From a request to DataFrames: rows in order, a page, aggregates and groups; and to a response for the caller."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.values import VALUE, Value, number_text, unpacked_python
from graphloom.operators import paths as P
from graphloom.plans.request import COST_LIMIT, Filter, InvalidQuery, LimitExceeded, Request, decode_cursor, encode_cursor, parse
from graphloom.sources.graph import Graph, Table, entity_fields, holds


@dataclass(frozen=True)
class Rows:
    """The rows that a request matches, with its fields as values, before order and page."""

    df: DataFrame
    values: dict[str, Value]
    identity: tuple[Column, ...]  # the order of rows that sort alike
    keys: tuple[str, ...]  # columns of the identity

    def value(self, name: str) -> Value:
        return self.values[name]


def referenced(r: Request) -> list[str]:
    names = [f for f, _ in r.sort] + [f for _, op, f in r.aggregate if f] + list(r.group_by) + list(r.project)
    return list(dict.fromkeys(names))


def _uniform(g: Graph, kinds: tuple[str, ...], name: str) -> str | None:
    """The type of a field where all kinds that have it agree."""
    found = {t.value(name).kind for t in g.tables(kinds or None).values()} - {"null"}
    return found.pop() if len(found) == 1 else None


def _packed(g: Graph, kinds: tuple[str, ...], names: list[str]) -> dict[str, Value]:
    """Values of the columns v0, v1, ... of Graph.nodes()."""
    out = {}
    for i, n in enumerate(names):
        c, kind = F.col(f"v{i}"), _uniform(g, kinds, n)
        v = Value.of(c, VALUE)
        out[n] = Value(c.isNotNull(), kind, v.k, v.s, v.n, v.b, v.j, F.from_json(v.j, "array<string>") if kind == "raw" and all(t.value(n).items is not None or t.value(n).kind == "null" for t in g.tables(kinds or None).values()) else None)
    return out


def rows(g: Graph, r: Request) -> Rows:
    names = referenced(r)
    if r.op == "match":
        if r.kind and r.kind in g.kinds:  # a typed table answers by its own columns
            t = g.kinds[r.kind]
            return Rows(t.where(r.where), {n: t.value(n) for n in names}, (F.col("id"),), ("id",))
        kinds = (r.kind,) if r.kind else ()
        return Rows(g.nodes(kinds, r.where, tuple(names)), _packed(g, kinds, names), (F.col("id"),), ("id",))
    if r.op == "neighbors":
        df = P.neighbors(g, r)
        if names:
            df = df.join(g.nodes(r.node_kinds, None, tuple(names)), "id")
        keys = ("id", "edge_id", "direction") if (r.aggregate or r.group_by) and not r.sort else ("edge_id", "id", "direction")
        return Rows(df, _packed(g, r.node_kinds, names), tuple(map(F.col, keys)), keys)
    df = P.paths(g, r)
    values = {n: Value.of(F.col("end_id"), T.StringType(), True) if n == "end_id" else Value.of(F.col("length"), T.LongType(), True) if n in ("length", "depth") else Value.missing() for n in names}
    keys = ("es", "vs")
    if r.op == "pattern" and not r.sort:
        df, keys = df.withColumn("first", F.col("vs")[0]), ("first", "es", "vs")
    return Rows(df, values, tuple(map(F.col, keys)), keys)


def ordered(rs: Rows, r: Request) -> list[Column]:
    """Sort keys, then the identity, ascending even if the keys descend."""
    return [k for name, desc in r.sort for k in rs.value(name).sort_keys(desc)] + list(rs.identity)


def projected(g: Graph, r: Request, rs: Rows) -> list[tuple[str, Column]]:
    return [(name, native(rs.value(name))) for name in r.project]


def native(v: Value) -> Column:
    """A value as column of its own type; text where types differ."""
    by_kind = {"string": v.s, "number": v.n, "bool": v.b, "raw": v.j, "null": F.lit(None).cast("string")}
    if v.kind:
        return F.when(v.exists, by_kind[v.kind])
    return F.when(v.exists, v.text())


def frame(g: Graph, request: dict | Request, limit: int | None = None, offset: int = 0) -> DataFrame:
    """What a request matches as a DataFrame, in order if a limit is given.

    match: id, kind, fields.  neighbors: id, edge_id, direction, fields.  Paths: path and edges (ids joined by >),
    length, end_id, fields of the end."""
    r = parse(request)
    rs = rows(g, r)
    df = rs.df
    if limit is not None:
        df = df.orderBy(*ordered(rs, r)).offset(offset).limit(limit) if offset else df.orderBy(*ordered(rs, r)).limit(limit)
    if r.op == "match":
        return df.select("id", "kind", *(c.alias(n) for n, c in projected(g, r, rs)))
    if r.op == "neighbors":
        return df.select("id", "edge_id", "direction", *(c.alias(n) for n, c in projected(g, r, rs)))
    out = df.select(F.array_join("vs", ">").alias("path"), F.array_join("es", ">").alias("edges"), "length", "end_id")
    names = list(r.project)
    if not names:
        return out
    ends = g.nodes((r.end_kind,) if r.end_kind else (), None, tuple(names)).withColumnRenamed("id", "end_id").drop("kind")
    values = _packed(g, (r.end_kind,) if r.end_kind else (), names)
    return out.join(ends, "end_id").select("path", "edges", "length", "end_id", *(native(values[n]).alias(n) for n in names))


def ranked(g: Graph, request: dict | Request) -> DataFrame:
    """frame() of all that a match matches, with each row's rank (from 1) in the order of the request."""
    r = parse(request)
    rs = rows(g, r)
    df = rs.df.orderBy(*ordered(rs, r)).select("id", "kind", *(c.alias(n) for n, c in projected(g, r, rs)))
    numbered = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))  # by ranges of the order, not in one window
    return df.sparkSession.createDataFrame(numbered, T.StructType([*df.schema.fields, T.StructField("rank", T.LongType(), False)]))


def _aggregate(rs: Rows, op: str, name: str) -> Column:
    if op == "count":
        return F.count(F.lit(1))
    v = rs.value(name)
    n = F.when(v.exists & v.is_kind("number"), v.n) if v.n is not None else F.lit(None).cast("double")
    return {"sum": F.coalesce(F.sum(n), F.lit(0.0)), "avg": F.avg(n), "min": F.min(n), "max": F.max(n)}[op]


def count_by(g: Graph, request: dict | Request, field: str) -> DataFrame:
    """value (as text), count of all rows that the request matches."""
    r = replace(parse(request), aggregate=(("n", "count_by", field),))
    rs = rows(g, r)
    return rs.df.groupBy(rs.value(field).text().alias("value")).agg(F.count(F.lit(1)).alias("count"))


def aggregates(g: Graph, request: dict | Request) -> DataFrame:
    """One row: the request's aggregates, but for count_by, over all it matches."""
    r = parse(request)
    rs = rows(g, r)
    return rs.df.agg(*(_aggregate(rs, op, f).alias(name) for name, op, f in r.aggregate if op != "count_by"))


def _json(v: Value) -> Column:
    text = F.to_json(F.array(v.s)) if v.s is not None else None
    quoted = F.substring(text, 2, 1 << 30) if text is not None else F.lit("null]")
    number = number_text(v.n) if v.n is not None else F.lit("null")
    flag = v.b.cast("string") if v.b is not None else F.lit("null")
    return F.when(v.exists & v.is_kind("string"), F.regexp_replace(quoted, r"\]$", "")).when(v.exists & v.is_kind("number"), number).when(v.exists & v.is_kind("bool"), flag).when(v.exists & v.is_kind("raw"), v.j if v.j is not None else F.lit("null")).otherwise("null")


def groups(g: Graph, request: dict | Request) -> DataFrame:
    """A row for each group that having lets pass: the keys in their own types, and the aggregates.

    Values of different types are different keys; a missing field is the same key as null."""
    r = parse(request)
    rs = rows(g, r)
    wanted = r.aggregate or (("count", "count", ""),)
    keys = [_json(rs.value(k)).alias(f"__key{i}") for i, k in enumerate(r.group_by)]
    shown = [F.first(native(rs.value(k)), ignorenulls=True).alias(k) for k in r.group_by]
    df = rs.df.groupBy(*keys).agg(*shown, *(_aggregate(rs, op, f).alias(name) for name, op, f in wanted if name not in r.group_by and op != "count_by"))
    names = [f"__key{i}" for i in range(len(keys))]
    for name, op, f in wanted:
        if op == "count_by":  # a map from the field's text to the number of rows
            each = rs.df.groupBy(*keys, rs.value(f).text().alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
            df = df.join(each.groupBy(*names).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__value", "__n")))).alias(name)), names)
    if r.having is not None:
        kinds = {k: rs.value(k).kind for k in r.group_by}

        def value(name: str) -> Value:
            if name in kinds or any(name == n for n, _, _ in wanted):
                return Value.of(F.col(f"`{name}`"), df.schema[name].dataType)
            return Value.missing()

        df = df.where(_condition(r.having, value))
    return df.orderBy(*(f"__key{i}" for i in range(len(r.group_by)))).drop(*(f"__key{i}" for i in range(len(r.group_by))))


def _condition(tree, value) -> Column:
    if isinstance(tree, Filter):
        return holds(value(tree.field), tree)
    op, parts = tree
    cs = [_condition(p, value) for p in parts]
    if op == "not":
        return ~cs[0]
    out = cs[0]
    for c in cs[1:]:
        out = out & c if op == "and" else out | c
    return out


def plan(g: Graph, r: Request) -> dict[str, Any]:
    """How a request will be answered, by the planner's names, and Spark's own plan."""
    strategy, index = {"match": "kind-scan", "pattern": "pattern", "neighbors": "neighbors", "traverse": "bounded-bfs", "impact": "impact-bfs", "shortest_path": "shortest-bfs"}[r.op], None
    flat = r.where[1] if isinstance(r.where, tuple) and r.where[0] == "and" else [r.where] if isinstance(r.where, Filter) else []
    if r.op in ("match", "pattern"):
        for f in (x for x in flat if isinstance(x, Filter)):
            if f.field == "id" and f.op == "eq":
                strategy, index = "entity-id-lookup", f
                break
            if f.op in ("eq", "in") and strategy != "field-index":
                strategy, index = "field-index", f
            elif f.op in ("gt", "gte", "lt", "lte", "prefix") and index is None:
                strategy, index = "field-index-scan", f
    warnings = ["where is not applied by " + r.op] if r.where is not None and r.op in ("traverse", "impact", "shortest_path") else []
    df = frame(g, replace(r, cursor=""), None) if r.op != "shortest_path" else None
    return {"op": r.op, "strategy": strategy, "index_field": index.field if index else "", "index_op": index.op if index else "", "steps": [{"name": strategy}], "warnings": warnings, "spark": df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if df is not None else ""}


def _entities(g: Graph, ids: list[str], fields: tuple[str, ...] = ()) -> dict[str, dict]:
    """Entities by id; ids are those of one page."""
    found = {}
    for kind, t in g.kinds.items():
        part = t.with_ids(sorted(set(ids)))
        if part is None:  # none of the ids can be of this kind
            continue
        if fields:
            for row in part.select("id", *(t.value(f).packed().alias(f"v{i}") for i, f in enumerate(fields))).collect():
                found[row["id"]] = {"id": row["id"], "kind": kind, "fields": {f: unpacked_python(row[f"v{i}"]) for i, f in enumerate(fields)}}
        else:
            for row in part.collect():
                found[row["id"]] = {"id": row["id"], "kind": kind, "fields": entity_fields(row.asDict())}
    return found


def _edges(g: Graph, ids: list[str]) -> dict[str, dict]:
    out = {}
    for row in g.edges.df.where(F.col("id").isin(sorted(set(ids)))).collect():
        d = row.asDict()
        out[d["id"]] = {"id": d["id"], "type": d["type"], "from": d["src"], "to": d["dst"], "fields": entity_fields(d)}
    return out


#: Requests that run now, by id: what they ask for, and since when.
RUNNING: dict[str, dict[str, Any]] = {}


def running() -> list[dict[str, Any]]:
    """The requests that run now, the oldest first."""
    return sorted(({"id": k, "op": v["request"].op, "seconds": round(time.monotonic() - v["began"], 3)} for k, v in list(RUNNING.items())), key=lambda x: -x["seconds"])


def kill(g: Graph, id_: str) -> bool:
    """Ends the jobs of a running request, which then raises; False if there is none of this id."""
    if id_ not in RUNNING:
        return False
    RUNNING[id_]["killed"] = "killed"
    g.spark.interruptTag(id_)
    return True


@contextlib.contextmanager
def admitted(g: Graph, r: Request) -> Iterator[None]:
    """While a request runs: it is listed, ends at its timeout, and its levels go when it is done."""
    id_, kept = f"graphloom-{uuid.uuid4().hex}", P.held()
    RUNNING[id_] = {"request": r, "began": time.monotonic(), "killed": ""}
    stopped = threading.Event()

    def watch() -> None:
        while not stopped.wait(0.1):  # again and again: a request is many jobs, and the next may only start
            if time.monotonic() - RUNNING[id_]["began"] > r.timeout_ms / 1000:
                RUNNING[id_]["killed"] = f"took more than {r.timeout_ms} ms"
                g.spark.interruptTag(id_)

    if r.timeout_ms:
        threading.Thread(target=watch, daemon=True).start()
    g.spark.addTag(id_)
    try:
        yield
        if RUNNING[id_]["killed"]:
            raise LimitExceeded(RUNNING[id_]["killed"])
    except LimitExceeded:
        raise
    except Exception as e:
        if RUNNING[id_]["killed"]:
            raise LimitExceeded(RUNNING[id_]["killed"]) from e
        raise
    finally:
        stopped.set()
        g.spark.removeTag(id_)
        del RUNNING[id_]
        P.release(g.spark, kept)


def within(df: DataFrame, cost: int) -> list:
    """The rows of df; raises if there are more than the cost limit."""
    found = df.limit(cost + 1).collect()
    if len(found) > cost:
        raise LimitExceeded(f"more than {cost} rows")
    return found


def execute(g: Graph, request: dict | Request) -> dict[str, Any]:
    """A page of results with version, cursor, aggregates, groups, statistics and, where asked for, plan and profile.

    A request that matches more rows, or reaches more paths on a level, than its cost limit (COST_LIMIT if it has none)
    raises, and so does one that takes longer than its timeout or is killed.  A match without sort, aggregates and groups
    only counts the rows up to the end of its page and one more."""
    r = parse(request)
    if r.op in ("explain", "profile"):
        target = replace(r, op=r.target_op, target_op="", profile=r.op == "profile")
        if r.op == "explain":
            return {"version": g.version, "results": [], "plan": plan(g, target), "stats": {"returned": 0, "truncated": False}}
        return execute(g, target)
    if r.min_version > g.version and not r.allow_stale:
        raise InvalidQuery(f"version {r.min_version} is not there yet")
    with admitted(g, r):
        return _page(g, r)


def _page(g: Graph, r: Request) -> dict[str, Any]:
    times: list[dict] = []

    def timed(name: str, f):
        began = time.perf_counter()
        out = f()
        times.append({"name": name, "ms": round((time.perf_counter() - began) * 1000, 1)})
        return out

    offset, after = decode_cursor(g.version, r)
    cost = r.cost_limit or COST_LIMIT
    rs = rows(g, replace(r, cost_limit=cost))
    df, size = rs.df, r.page_size
    keyset = after is not None and not r.sort
    early = r.op == "match" and not (r.sort or r.aggregate or r.group_by)  # reads no further than its page, and costs no more
    reach = min(cost, (0 if keyset else offset) + size if early else cost) + 1
    if reach > cost and timed("admit", lambda: df.limit(reach).count()) > cost:
        raise LimitExceeded(f"more than {cost} rows")
    if keyset:  # go on behind the last row, without counting those before
        df = df.where(F.struct(*rs.identity) > _literal_struct(after, [df.select(c).schema[0].dataType for c in rs.identity]))
    page = df.orderBy(*ordered(rs, r))
    page = (page if keyset or not offset else page.offset(offset)).limit(size + 1)
    columns = {"match": ["id"], "neighbors": ["id", "edge_id", "direction"]}.get(r.op, ["vs", "es", "length", "end_id"])
    found = timed(r.op, lambda: page.select(*dict.fromkeys([*columns, *rs.keys])).collect())
    more, found = len(found) > size, found[:size]
    results: list[dict] = []
    if r.op == "match" or r.op == "neighbors":
        held = timed("hydrate", lambda: _entities(g, [x["id"] for x in found], r.project)) if found else {}
        links = _edges(g, [x["edge_id"] for x in found]) if found and r.op == "neighbors" else {}
        for x in found:
            out = {"entity": held[x["id"]]}
            if r.project:
                out["fields"] = dict(held[x["id"]]["fields"])
            if r.op == "neighbors":
                out |= {"edge": links[x["edge_id"]], "direction": x["direction"]}
            results.append(out)
    elif found:
        held = timed("hydrate", lambda: _entities(g, [v for x in found for v in x["vs"]]))
        links = _edges(g, [e for x in found for e in x["es"]])
        ends = _entities(g, [x["end_id"] for x in found], r.project) if r.project else {}
        for x in found:
            out = {"path": {"entities": [held[v] for v in x["vs"]], "edges": [links[e] for e in x["es"]]}}
            if r.project:
                out |= {"entity": ends[x["end_id"]], "fields": dict(ends[x["end_id"]]["fields"])}
            results.append(out)
    response: dict[str, Any] = {"version": g.version, "results": results, "next_cursor": "", "stats": {"returned": len(results), "truncated": more}}
    if more:
        response["next_cursor"] = encode_cursor(g.version, r, offset + len(results), [found[-1][k] for k in rs.keys])
    if r.aggregate:
        response["aggregates"] = timed("aggregate", lambda: {**(aggregates(g, r).head().asDict() if any(op != "count_by" for _, op, _ in r.aggregate) else {}), **{name: {x["value"]: x["count"] for x in within(count_by(g, r, f), cost)} for name, op, f in r.aggregate if op == "count_by"}})
    if r.group_by:
        names = list(r.group_by)
        response["groups"] = [{"key": {k: x[k] for k in names}, "aggregates": {k: v for k, v in x.asDict().items() if k not in names}} for x in timed("group", lambda: within(groups(g, r), cost))]
    if r.profile:
        response |= {"plan": plan(g, r), "profile": times}
    return response


def _literal_struct(values: list, types: list[T.DataType]) -> Column:
    return F.struct(*(F.lit(v).cast(t) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast(t) for v, t in zip(values, types, strict=True)))


def stream(g: Graph, request: dict | Request) -> Iterator[dict]:
    """Everything a request matches, row by row, a partition at a time: what the caller doesn't read isn't held."""
    r = parse(request)
    yield {"meta": {"version": g.version}}
    n = 0
    for row in frame(g, r).toLocalIterator():
        n += 1
        yield {"result": row.asDict()}
    yield {"done": {"returned": n}}


def scan_entities(g: Graph, kind: str = "", source: str = "", after: str = "", limit: int = 100) -> DataFrame:
    """id, kind, source of entities in order of id; a source is an entity's own or one of its others."""
    parts = []
    for t in g.tables((kind,) if kind else None).values():
        df = t.df.where(F.col("id") > after) if after else t.df
        if source:
            hit = t.value("source").equals(source)
            if "sources" in t.df.columns:
                hit = hit | F.coalesce(F.exists("sources", lambda x: x["source"] == source), F.lit(False))
            df = df.where(hit)
        parts.append(df.select("id", "kind", t.value("source").s.alias("source")))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("id").limit(min(limit, 1000))


def scan_edges(g: Graph, type_: str = "", src: str = "", source: str = "", after: str = "", limit: int = 100) -> DataFrame:
    df = g.edges.df
    for test in ([F.col("type") == type_] if type_ else []) + ([F.col("src") == src] if src else []) + ([g.edges.value("source").equals(source)] if source else []) + ([F.col("id") > after] if after else []):
        df = df.where(test)
    return df.select("id", "type", F.col("src").alias("from"), F.col("dst").alias("to")).orderBy("id").limit(min(limit, 1000))


__all__ = ["Table", "aggregates", "count_by", "execute", "frame", "groups", "kill", "plan", "rows", "running", "scan_edges", "scan_entities", "stream"]
