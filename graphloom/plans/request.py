"""Requests: the JSON form of a query, checked before anything is planned."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

OPS = ("match", "pattern", "neighbors", "traverse", "impact", "shortest_path")
FILTER_OPS = ("eq", "neq", "in", "gt", "gte", "lt", "lte", "prefix", "contains", "fuzzy", "exists")
AGGREGATES = ("count", "count_by", "sum", "avg", "min", "max")
LIMIT, MAX_LIMIT, MAX_DEPTH, MAX_STEPS, MAX_PATHS, COST_LIMIT = 100, 1000, 16, 8, 1001, 100_000


class InvalidQuery(ValueError):
    """The request makes no sense, or names what isn't there."""


class LimitExceeded(RuntimeError):
    """The request would cost more than its limit."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str = "eq"
    value: Any = None


@dataclass(frozen=True)
class Step:
    direction: str = ""
    relation_types: tuple[str, ...] = ()
    node_kinds: tuple[str, ...] = ()
    where: Any = None
    edge_where: Any = None


@dataclass(frozen=True)
class Request:
    """where and its like are boolean trees: ("and" | "or" | "not", [trees]) or Filter, or None."""

    op: str
    target_op: str = ""
    kind: str = ""
    where: Any = None
    edge_where: Any = None
    id: str = ""
    target_id: str = ""
    direction: str = ""
    direction_strategy: str = ""
    relation_types: tuple[str, ...] = ()
    depth: int = 0
    node_kinds: tuple[str, ...] = ()
    end_kind: str = ""
    end_where: Any = None
    steps: tuple[Step, ...] = ()
    max_paths: int = 0
    sort: tuple[tuple[str, bool], ...] = ()
    project: tuple[str, ...] = ()
    aggregate: tuple[tuple[str, str, str], ...] = ()  # name, op, field
    group_by: tuple[str, ...] = ()
    having: Any = None
    limit: int = 0
    cursor: str = ""
    timeout_ms: int = 0
    cost_limit: int = 0
    profile: bool = False
    min_version: int = 0
    allow_stale: bool = False

    @property
    def page_size(self) -> int:
        return min(self.limit or LIMIT, MAX_LIMIT)

    @property
    def hops(self) -> int:
        return min(self.depth or (4 if self.op == "impact" else 1), MAX_DEPTH)

    def digest(self) -> str:
        """Of what a cursor is bound to."""
        same = replace(self, cursor="", limit=0, timeout_ms=0, cost_limit=0, profile=False)
        return hashlib.sha256(json.dumps(asdict(same), sort_keys=True, default=str).encode()).hexdigest()


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise InvalidQuery(message)


def flat_filter(x: dict) -> Filter:
    op = x.get("op") or "eq"
    _need(op in FILTER_OPS, f"unsupported filter op {op!r}")
    _need(x.get("field"), "a filter requires a field")
    value = x.get("value")
    _need(op != "exists" or value is None or isinstance(value, bool), "exists takes true, false or nothing")
    _need(op != "in" or isinstance(value, list | tuple), "in takes a list of values")
    return Filter(x["field"], op, list(value) if op == "in" else value)


def expression(x: dict | None) -> Any:
    if x is None:
        return None
    op = (x.get("op") or "").lower() or ("eq" if x.get("field") else "")
    if op in ("and", "or"):
        _need(x.get("children"), f"nothing to combine under {op!r}")
        return (op, [expression(c) for c in x["children"]])
    if op == "not":
        _need(len(x.get("children") or ()) == 1, "not negates one expression")
        return ("not", [expression(x["children"][0])])
    return flat_filter({**x, "op": op})


def both(flat: list | None, tree: dict | None, equal: dict | None = None) -> Any:
    """All of a flat list, a tree, and a mapping of equal values; None if there is none of them."""
    parts = [flat_filter({"field": k, "value": v}) for k, v in (equal or {}).items()]
    parts += [flat_filter(x) for x in flat or ()]
    parts += [expression(tree)] if tree else []
    return parts[0] if len(parts) == 1 else ("and", parts) if parts else None


def _direction(x: str | None) -> str:
    _need((x or "") in ("", "out", "in", "both"), f"unsupported direction {x!r}")
    return x or ""


def parse(x: dict[str, Any] | Request) -> Request:
    """A request from its JSON form; raises InvalidQuery."""
    if isinstance(x, Request):
        return x
    known = {f.name for f in fields(Request)} - {"node_kinds", "end_kind", "end_where", "steps", "max_paths"}
    known |= {"filters", "where_expr", "edge_where_expr", "relation_type", "path", "having_expr"}
    _need(not (set(x) - known), f"unknown fields {sorted(set(x) - known)}")
    path = x.get("path") or {}
    steps = tuple(
        Step(_direction(s.get("direction")), tuple(s.get("relation_types") or ()), tuple(s.get("node_kinds") or ()), both(s.get("where"), s.get("where_expr")), both(s.get("edge_where"), s.get("edge_where_expr")))
        for s in path.get("steps") or ()
    )
    one = [x["relation_type"]] if x.get("relation_type") else []
    relations = tuple(sorted({*one, *(x.get("relation_types") or ()), *(path.get("relation_types") or ())}))
    out = Request(
        op=x.get("op") or "", target_op=x.get("target_op") or "", kind=x.get("kind") or "",
        where=both(x.get("where"), x.get("where_expr"), x.get("filters")), edge_where=both(x.get("edge_where"), x.get("edge_where_expr")),
        id=x.get("id") or "", target_id=x.get("target_id") or "", direction=_direction(x.get("direction")), direction_strategy=x.get("direction_strategy") or "",
        relation_types=relations, depth=x.get("depth") or 0, node_kinds=tuple(path.get("node_kinds") or ()), end_kind=path.get("end_kind") or "",
        end_where=both(path.get("end_where"), path.get("end_where_expr")), steps=steps, max_paths=path.get("max_paths") or 0,
        sort=tuple((s["field"], bool(s.get("desc"))) for s in x.get("sort") or ()), project=tuple(x.get("project") or ()),
        aggregate=tuple((a.get("name") or (f"{a['op']}_{a['field']}" if a.get("field") else a["op"]), a["op"], a.get("field") or "") for a in x.get("aggregate") or ()),
        group_by=tuple(x.get("group_by") or ()), having=both(x.get("having"), x.get("having_expr")),
        limit=x.get("limit") or 0, cursor=x.get("cursor") or "", timeout_ms=x.get("timeout_ms") or 0, cost_limit=x.get("cost_limit") or 0, profile=bool(x.get("profile")),
        min_version=x.get("min_version") or 0, allow_stale=bool(x.get("allow_stale")),
    )
    target = out
    if out.op in ("explain", "profile"):
        _need(out.target_op in OPS, f"{out.op} requires a target_op")
        target = replace(out, op=out.target_op, target_op="")
    check(target)
    return out


def check(r: Request) -> None:
    _need(r.op in OPS, f"unsupported op {r.op!r}")
    for name in ("limit", "timeout_ms", "cost_limit", "depth", "max_paths"):
        _need(getattr(r, name) >= 0, f"{name} must be >= 0")
    _need(r.having is None or r.group_by, "having requires group_by")
    _need(r.direction_strategy in ("", "impact"), f"unsupported direction_strategy {r.direction_strategy!r}")
    for _, op, name in r.aggregate:
        _need(op in AGGREGATES, f"unsupported aggregate op {op!r}")
        _need(op == "count" or name, f"aggregate {op!r} requires field")
    if r.op == "pattern":
        _need(r.kind, "pattern requires a start kind")
        _need(0 < len(r.steps) <= MAX_STEPS, f"pattern supports 1 to {MAX_STEPS} path steps")
        _need(r.depth in (0, len(r.steps)), "pattern depth must equal its path step count")
    elif r.op != "match":
        _need(r.id, f"{r.op} requires an id")
    if r.op == "shortest_path":
        _need(r.target_id, "shortest_path requires a target_id")


def encode_cursor(version: int, r: Request, offset: int, after: list) -> str:
    """after: the order key of the last row of a page."""
    state = {"version": version, "offset": offset, "after": after, "query": r.digest()}
    return base64.urlsafe_b64encode(json.dumps(state).encode()).decode().rstrip("=")


def decode_cursor(version: int, r: Request) -> tuple[int, list | None]:
    """Offset and order key to go on from; a bare number is an offset."""
    if not r.cursor:
        return 0, None
    if r.cursor.isdigit():
        return int(r.cursor), None
    try:
        state = json.loads(base64.urlsafe_b64decode(r.cursor + "=" * (-len(r.cursor) % 4)))
        offset, after = int(state["offset"]), list(state["after"])
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidQuery("malformed cursor") from e
    _need(state.get("version") == version, "the cursor is of another version")
    _need(state.get("query") == r.digest(), "the cursor is of another query")
    return offset, after


__all__ = ["Filter", "InvalidQuery", "LimitExceeded", "Request", "Step", "check", "decode_cursor", "encode_cursor", "parse"]
