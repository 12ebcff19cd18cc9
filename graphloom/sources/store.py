"""Versions of a tenant's graph in a folder: Parquet for entities (by kind) and edges, and a manifest that makes them visible.

A version is written beside the others and becomes current when its manifest appears; the manifest's creation fails if it
is there already, so of two writers of the same version one loses and must start from the other's.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.governance import EntityType, State
from graphloom.plans.request import InvalidQuery
from graphloom.sources.graph import RelationType

TENANT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$")


class Conflict(RuntimeError):
    """Another writer has made the version."""


class Store:
    """A tenant's versions, saved queries and dead letters, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default"):
        if not TENANT.match(tenant) or ".." in tenant:
            raise InvalidQuery(f"tenant id {tenant!r}")
        self.spark, self.root = spark, f"{root.rstrip('/')}/{tenant}"
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _put(self, name: str, text: str, overwrite: bool = False) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        try:
            out = fs.create(p, overwrite)
        except Exception as e:
            if "exist" in str(e).lower():
                raise Conflict(name) from e
            raise
        out.write(text.encode())
        out.close()

    def _get(self, name: str) -> str:
        fs, p = self._fs(f"{self.root}/{name}")
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def current(self) -> int:
        return max(self.versions(), default=0)

    def save(self, state: State, expected: int | None = None) -> int:
        """Writes a state as the next version; expected: the version it was made from."""
        before = self.current()
        if expected is not None and expected != before:
            raise Conflict(f"the current version is {before}, not {expected}")
        version = before + 1
        folder = f"{self.root}/data/{version:012d}"
        # Sorted by id within a kind: row-group statistics then answer lookups and ranges of ids.
        state.entities.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/entities")
        state.edges.repartitionByRange("src").sortWithinPartitions("src", "type").write.mode("overwrite").parquet(f"{folder}/edges")
        manifest = {"version": version, "relations": [asdict(r) for r in state.relations.values()], "types": [asdict(t) for t in state.types.values()]}
        self._put(f"manifests/{version:012d}.json", json.dumps(manifest))
        return version

    def load(self, version: int | None = None, min_version: int = 0) -> State:
        version = self.current() if version is None else version
        if version < min_version:
            raise InvalidQuery(f"version {min_version} is not there yet")
        if not version:
            return State.empty(self.spark)
        manifest = json.loads(self._get(f"manifests/{version:012d}.json"))
        empty, folder = State.empty(self.spark), f"{self.root}/data/{version:012d}"
        read = lambda name, like: self.spark.read.schema(like.schema).parquet(f"{folder}/{name}")
        relations = {r["name"]: RelationType(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in manifest["relations"]}
        types = {t["name"]: EntityType(t["name"], tuple(t["extends"]), t["fields"], {k: (tuple(v[0]), v[1], v[2]) for k, v in t["identity_keys"].items()}) for t in manifest["types"]}
        return State(self.spark, read("entities", empty.entities), read("edges", empty.edges), relations, types, version)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Deletes all but the newest versions."""
        gone = self.versions()[:-keep] if keep else []
        for v in gone:
            for name in (f"manifests/{v:012d}.json", f"data/{v:012d}"):
                fs, p = self._fs(f"{self.root}/{name}")
                fs.delete(p, True)
        return gone

    def clone(self, tenant: str) -> Store:
        """The current version as another tenant's first."""
        other = Store(self.spark, self.root.rpartition("/")[0], tenant)
        other.save(self.load(), 0)
        return other

    def export(self, path: str, version: int | None = None) -> None:
        """A version as JSON Lines that imports can read."""
        state = self.load(version)
        graph_rows(state).write.text(path)

    def save_query(self, name: str, request: dict) -> None:
        self._put(f"queries/{name}.json", json.dumps(request), overwrite=True)

    def saved_queries(self) -> dict[str, dict]:
        return {n.removesuffix(".json"): json.loads(self._get(f"queries/{n}")) for n in self._names("queries") if n.endswith(".json")}

    def run_saved(self, name: str, **changes) -> dict:
        from graphloom.operators.query import execute

        return execute(self.load().graph(), {**self.saved_queries()[name], **changes})


def _plain(v: F.Column) -> F.Column:
    """A packed value as JSON text."""
    text = F.regexp_replace(F.to_json(F.struct(v["s"].alias("v"))), r'^\{"v":|\}$', "")
    return F.when(v["k"] == "string", text).when(v["k"] == "number", v["n"].cast("string")).when(v["k"] == "bool", v["b"].cast("string")).when(v["k"] == "raw", v["j"]).otherwise("null")


def _object(fields: F.Column) -> F.Column:
    entries = F.transform(F.map_entries(fields), lambda e: F.concat(F.regexp_replace(F.to_json(F.struct(e["key"].alias("v"))), r'^\{"v":|\}$', ""), F.lit(":"), _plain(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def graph_rows(state: State) -> DataFrame:
    """One line of JSON for each entity, then each edge."""
    text = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":|\}$', "")
    meta = [F.lit(',"source":'), text("source"), F.lit(',"external_id":'), text("external_id"), F.lit(',"confidence":'), F.col("confidence").cast("string"), F.lit(',"source_priority":'), F.col("source_priority").cast("string")]
    fields = _object(F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<k:string,s:string,n:double,b:boolean,j:string>>"))))
    entities = state.entities.select(F.concat(F.lit('{"entity":{"id":'), text("id"), F.lit(',"kind":'), text("kind"), *meta, F.lit(',"fields":'), fields, F.lit("}}")).alias("value"))
    edges = state.edges.select(F.concat(F.lit('{"edge":{"type":'), text("type"), F.lit(',"from":'), text("src"), F.lit(',"to":'), text("dst"), *meta, F.lit(',"fields":'), fields, F.lit("}}")).alias("value"))
    return entities.unionByName(edges)
