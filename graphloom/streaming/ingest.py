"""Ingest: batches of items from a stream, each applied once, with rejected lines kept as dead letters."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.governance import SourcePolicy, State
from graphloom.plans.request import InvalidQuery
from graphloom.sources.imports import _items, apply_items, entities_of
from graphloom.sources.store import Conflict, Store


class Ingest:
    """A store's batches.  A batch has a key; one whose key is in the ledger is skipped."""

    def __init__(self, store: Store, policy: SourcePolicy | None = None, quota: tuple[int, int] = (0, 0)):
        """quota: at most so many entities and edges (0: any number)."""
        self.store, self.policy, self.quota = store, policy, quota

    def done(self, key: str) -> dict[str, Any] | None:
        name = hashlib.sha256(key.encode()).hexdigest()
        return json.loads(self.store._get(f"batches/{name}.json")) if f"{name}.json" in self.store._names("batches") else None

    def apply(self, lines: DataFrame, key: str, source: str = "", full_sync: bool = False, stale_kind: str = "", stale_action: str = "mark_stale", cursor: str = "", keep_letters: bool = True) -> dict[str, Any]:
        """lines: seq, line (an item as JSON).  full_sync: what the source doesn't name is stale, unless a line failed.

        Lines that are no items, and items that the store's types, relations or priorities reject, are dead letters."""
        if (before := self.done(key)) is not None:
            return {**before, "skipped": True, "skip_reason": "idempotent_replay"}
        items, errors = _items(lines)
        state = self.store.load()
        new, conflicts, rejected = apply_items(state, items, source, self.policy)
        rejected = lines.select("seq", "line").join(rejected.groupBy("seq").agg(F.min("error").alias("error")), "seq")
        errors = errors.unionByName(rejected.select(*errors.columns)).persist()
        failed = errors.count()
        applied = items.count() - rejected.count()
        new.within_quota(*self.quota)
        if full_sync and not failed:
            seen = entities_of(items, source).where(F.col("source") == source)
            seen = seen if not stale_kind else seen.where(F.col("kind") == stale_kind)
            new = new.mark_stale(source, seen.select("external_id"), stale_kind, stale_action)
        suppressed = conflicts.count()
        if same(state, new):
            result = {"key": key, "version": state.version, "applied": applied, "failed": failed, "suppressed": suppressed, "skipped": True, "skip_reason": "logical_noop", "cursor": cursor}
        else:
            version = self.store.save(new, state.version)
            result = {"key": key, "version": version, "applied": applied, "failed": failed, "suppressed": suppressed, "skipped": False, "cursor": cursor}
        if failed and keep_letters:
            errors.withColumn("key", F.lit(key)).withColumn("source", F.lit(source)).write.mode("append").parquet(f"{self.store.root}/dead_letters")
        try:
            self.store._put(f"batches/{hashlib.sha256(key.encode()).hexdigest()}.json", json.dumps(result))
        except Conflict:
            return {**self.done(key), "skipped": True, "skip_reason": "idempotent_replay"}
        return result

    def dead_letters(self) -> DataFrame:
        spark = self.store.spark
        schema = "seq long, line string, error string, key string, source string"
        return spark.read.schema(schema).parquet(f"{self.store.root}/dead_letters") if "dead_letters" in self.store._names("") else spark.createDataFrame([], schema)

    def open_letters(self, source: str | None = None) -> DataFrame:
        """Dead letters that no replay has applied yet."""
        spark, schema = self.store.spark, "key string, seq long"
        done = spark.read.schema(schema).parquet(f"{self.store.root}/resolved") if "resolved" in self.store._names("") else spark.createDataFrame([], schema)
        letters = self.dead_letters().join(done, ["key", "seq"], "left_anti")
        return letters if source is None else letters.where(F.col("source") == source)

    def replay(self, source: str) -> dict[str, Any]:
        """Applies a source's open dead letters once more; those that pass now are resolved, the others stay."""
        letters = self.open_letters(source).select("key", F.col("seq").alias("old"), "line").persist()
        lines = letters.withColumn("seq", F.monotonically_increasing_id()).persist()
        scanned = lines.count()
        state = self.store.load()
        items, errors = _items(lines.select("seq", "line"))
        new, _, rejected = apply_items(state, items, source, self.policy)
        bad = errors.select("seq").unionByName(rejected.select("seq")).distinct().persist()
        passed = lines.join(bad, "seq", "left_anti").select("key", F.col("old").alias("seq"))
        applied = passed.count()
        version = state.version if not applied or same(state, new) else self.store.save(new.within_quota(*self.quota), state.version)
        if applied:
            passed.write.mode("append").parquet(f"{self.store.root}/resolved")
        return {"scanned": scanned, "applied": applied, "failed": scanned - applied, "version": version}

    def import_lines(self, lines: DataFrame, import_id: str, batch: int = 100_000, source: str = "", on_error: str = "continue") -> dict[str, Any]:
        """lines: seq, line.  Applied in batches, in the order of seq; run again, it goes on behind the last batch that was applied.

        on_error: continue, or abort at the first batch with a failed line, which isn't applied."""
        if on_error not in ("continue", "abort"):
            raise InvalidQuery(f"on_error {on_error!r}")
        total = {"applied": 0, "failed": 0, "batches": 0, "skipped": 0}
        for number, (low, high) in enumerate(batches(lines, batch)):
            some = lines.where(F.col("seq").between(low, high))
            key = f"{import_id}-{number:06d}"
            if on_error == "abort" and self.done(key) is None and (bad := self.rejected(some, source).head()):
                raise InvalidQuery(f"batch {number}, line {bad['seq']}: {bad['error']}")
            got = self.apply(some, key, source, cursor=str(high))
            total["skipped"] += got.get("skip_reason") == "idempotent_replay"
            for name in ("applied", "failed"):
                total[name] += got[name]
            total["batches"] += 1
        return {**total, "version": self.store.current()}

    def rejected(self, lines: DataFrame, source: str = "") -> DataFrame:
        """seq, error of the lines that apply() would reject."""
        items, errors = _items(lines)
        return errors.select("seq", "error").unionByName(apply_items(self.store.load(), items, source, self.policy)[2])

    def stream(self, spark: SparkSession, folder: str, source: str, checkpoint: str):
        """A query that applies each new JSON Lines file of a folder; a batch that is run again changes nothing."""
        lines = spark.readStream.text(folder)

        def each(batch: DataFrame, number: int) -> None:
            held = batch.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")).persist()
            try:
                self.apply(held, f"{source}/{checkpoint}/{number}", source)
            finally:
                held.unpersist()

        return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(lines: DataFrame, size: int) -> list[tuple[int, int]]:
    """First and last seq of runs of about so many lines, in order: seq is ranked by ranges, not in one window."""
    ranges = lines.select("seq").repartitionByRange("seq").withColumn("part", F.spark_partition_id())
    counts = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    place = Window.partitionBy("part").orderBy("seq")
    held = F.broadcast(lines.sparkSession.createDataFrame(offsets, "part int, before long"))
    ranked = ranges.join(held, "part").withColumn("batch", F.floor((F.row_number().over(place) - 1 + F.col("before")) / size))
    return [(r["low"], r["high"]) for r in ranked.groupBy("batch").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("batch").collect()]  # one row for each batch


def fingerprint(state: State) -> tuple:
    """Of the contents of a state, whatever its version and order."""
    out = []
    for df, names in ((state.entities, ("id", "kind", "source", "external_id", "confidence", "source_priority")), (state.edges, ("id", "source", "external_id", "confidence", "source_priority"))):
        whole = F.xxhash64(*names, F.to_json(F.array_sort(F.map_entries("fields"))), F.to_json(F.array_sort(F.map_entries("owners"))), F.to_json("sources"))
        row = df.select(whole.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).head()
        out += list(row)
    return tuple(out)


def same(a: State, b: State) -> bool:
    return a.relations == b.relations and a.types == b.types and fingerprint(a) == fingerprint(b)
