"""The text form of queries: FIND, MATCH, NEIGHBORS, TRAVERSE, IMPACT and SHORTEST with their clauses."""

from __future__ import annotations

import re
from typing import Any

from graphloom.plans.request import InvalidQuery

# The operators' spellings.
OPERATORS = {
    "=": "eq", "==": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte",
    "EQ": "eq", "NEQ": "neq", "IN": "in", "GT": "gt", "GTE": "gte", "LT": "lt", "LTE": "lte", "PREFIX": "prefix", "CONTAINS": "contains", "FUZZY": "fuzzy", "EXISTS": "exists",
}
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(<=|>=|==|!=|<>|[=<>(),\[\]])|([^\s"'=<>!(),\[\]]+))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")


def tokens(text: str) -> list[tuple[str, bool]]:
    """(text, whether it was quoted)."""
    out, at = [], 0
    text = text.rstrip().removesuffix(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if not text[at:].strip():
                break
            raise InvalidQuery(f"unexpected text at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            out.append((re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1][1:-1]), True))
        else:
            out.append((m[2] or m[3], False))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Takes these words if they come next, in any case."""
        ahead = [t.upper() for t, _ in self.tokens[self.at : self.at + len(words)]]
        if ahead == list(words):
            self.at += len(words)
            return True
        return False

    def take(self, what: str) -> str:
        if self.at >= len(self.tokens):
            raise InvalidQuery(f"expected {what}")
        self.at += 1
        return self.tokens[self.at - 1][0]

    def names(self, what: str) -> list[str]:
        """One or more names, with commas between or brackets around them."""
        closed = self.word("[")
        out = [self.take(what)]
        while self.word(","):
            out.append(self.take(what))
        if closed and not self.word("]"):
            raise InvalidQuery(f"expected ] after {what}")
        return out

    def value(self) -> Any:
        if self.word("["):
            out: list = []
            while not self.word("]"):
                out.append(self.value())
                self.word(",")
            return out
        text, quoted = self.tokens[self.at] if self.at < len(self.tokens) else ("", False)
        self.take("a value")
        if quoted:
            return text
        if text.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text.lower()]
        if _NUMBER.match(text):
            return float(text) if re.search(r"[.eE]", text) else int(text)
        return text

    def whole(self, what: str) -> int:
        v = self.value()
        if not isinstance(v, int) or isinstance(v, bool):
            raise InvalidQuery(f"{what} requires a whole number")
        return v

    def either(self) -> dict:
        parts = [self.every()]
        while self.word("OR"):
            parts.append(self.every())
        return parts[0] if len(parts) == 1 else {"op": "or", "children": parts}

    def every(self) -> dict:
        parts = [self.one()]
        while self.word("AND"):
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else {"op": "and", "children": parts}

    def one(self) -> dict:
        if self.word("NOT"):
            return {"op": "not", "children": [self.one()]}
        if self.word("("):
            out = self.either()
            if not self.word(")"):
                raise InvalidQuery("expected )")
            return out
        if self.word("EXISTS"):
            return {"op": "exists", "field": self.take("a field"), "value": True}
        field = self.take("a field")
        negated = self.word("NOT")
        op = OPERATORS.get(self.take("an operator").upper())
        if op is None:
            raise InvalidQuery(f"unknown operator after {field}")
        if op == "exists":
            value = self.value() if self.peek().lower() in ("true", "false") else True
        else:
            value = self.value()
        out = {"op": op, "field": field, "value": value}
        return {"op": "not", "children": [out]} if negated else out


def _conditions(tree: dict, name: str) -> dict:
    """Conditions that all must hold are a flat list; anything else is a tree."""
    parts = tree["children"] if tree["op"] == "and" else [tree]
    if all(p["op"] not in ("and", "or", "not") for p in parts):
        return {name: parts}
    return {f"{name}_expr": tree}


_HEADS = {"FIND": ("match", "kind"), "MATCH": ("pattern", "kind"), "NEIGHBORS": ("neighbors", "id"), "TRAVERSE": ("traverse", "id"), "IMPACT": ("impact", "id"), "SHORTEST": ("shortest_path", "id")}


def parse_text(text: str) -> dict[str, Any]:
    """A request in its JSON form."""
    p = _Parser(text)
    wrapper = "explain" if p.word("EXPLAIN") else "profile" if p.word("PROFILE") else ""
    head = p.take("a query").upper()
    if head not in _HEADS:
        raise InvalidQuery("expected MATCH, FIND, NEIGHBORS, TRAVERSE, IMPACT, SHORTEST, EXPLAIN or PROFILE")
    op, key = _HEADS[head]
    r: dict[str, Any] = {"op": op, key: p.take(key)}
    if head == "SHORTEST":
        if not p.word("TO"):
            raise InvalidQuery("SHORTEST requires TO and a target")
        r["target_id"] = p.take("a target")
    if head == "MATCH":
        r["direction"] = "out"
    path: dict[str, Any] = {}
    step: dict[str, Any] | None = None
    while p.peek():
        here = r if step is None else step
        if p.word("WHERE"):
            here |= _conditions(p.either(), "where")
        elif p.word("EDGE", "WHERE") or p.word("EDGE"):
            here |= _conditions(p.either(), "edge_where")
        elif p.word("END", "KIND"):
            path["end_kind"], step = p.take("a kind"), None
        elif p.word("END", "WHERE"):
            path |= _conditions(p.either(), "end_where")
            step = None
        elif p.word("PATH", "STEP") or p.word("STEP"):
            step = {}
            path.setdefault("steps", []).append(step)
        elif p.word("PATH", "NODES") or p.word("NODES") or p.word("NODE_KINDS"):
            (path if step is None else step)["node_kinds"] = p.names("a kind")
        elif p.word("KIND") or p.word("KINDS"):
            (path if step is None else step)["node_kinds"] = p.names("a kind")
        elif p.word("PATH", "REL"):
            path["relation_types"] = p.names("a relation")
        elif p.word("MAX_PATHS") or p.word("MAX", "PATHS"):
            path["max_paths"], step = p.whole("MAX_PATHS"), None
        elif any(p.word(w) for w in ("REL", "RELATION", "RELATIONS", "RELATION_TYPES")):
            here["relation_types"] = p.names("a relation")
        elif any(p.word(w) for w in ("OUT", "IN", "BOTH")):
            here["direction"] = p.tokens[p.at - 1][0].lower()
        elif p.word("DEPTH"):
            r["depth"], step = p.whole("DEPTH"), None
        elif p.word("PROJECT"):
            r["project"], step = p.names("a field"), None
        elif p.word("ORDER", "BY") or p.word("SORT", "BY") or p.word("SORT"):
            keys, step = [], None
            while True:
                key = {"field": p.take("a field")}
                if p.word("DESC"):
                    key["desc"] = True
                else:
                    p.word("ASC")
                keys.append(key)
                if not p.word(","):
                    break
            r["sort"] = keys
        elif p.word("AGG") or p.word("AGGREGATE"):
            step = None
            while True:
                a: dict[str, Any] = {"op": p.take("an aggregate").lower()}
                if p.word("("):
                    if not p.word(")"):
                        field = p.take("a field")
                        a |= {} if field == "*" else {"field": field}
                        if not p.word(")"):
                            raise InvalidQuery("expected ) after the aggregate's field")
                if p.word("AS"):
                    a["name"] = p.take("a name")
                r.setdefault("aggregate", []).append(a)
                if not p.word(","):
                    break
        elif p.word("GROUP", "BY"):
            r["group_by"], step = p.names("a field"), None
        elif p.word("HAVING"):
            r |= _conditions(p.either(), "having")
            step = None
        elif p.word("LIMIT"):
            r["limit"], step = p.whole("LIMIT"), None
        elif p.word("CURSOR"):
            r["cursor"], step = p.take("a cursor"), None
        else:
            raise InvalidQuery(f"unexpected {p.peek()!r}")
    if path:
        r["path"] = path
    if wrapper:
        r = {**r, "target_op": r["op"], "op": wrapper}
    return r
