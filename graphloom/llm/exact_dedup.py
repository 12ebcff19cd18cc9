"""Exact deduplication with a log-structured merge index of text digests.

* Memtables: each task gathers digests in a table of bounded size and flushes it as a sorted run of
  (digest, smallest id, count).  Runs are Parquet files with Bloom filters on the digest, so that point
  lookups skip runs and row groups that can't hold it.
* Compaction merges the sorted runs, range by range, into one level that keeps the smallest identifier of
  each digest.  Copies meet as one row of each run, so a text with very many copies is no hot key.
* Hits are found through the level: a Bloom filter of the digests that it counts more than once (of bounded
  size) passes by the rows that can't be one; the others are looked up, hot digests over several tasks.
* Hits receive byte verification: each task sends the distinct texts of a digest that it holds once, however
  many rows have them.  Digests that two different texts share are told apart by their SHA-256.

Defined cases: null text is empty, and empty texts are equal; a null doc_id sorts after every id;
of rows that repeat both id and text one stays; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ID, bloom, dealt, filter_bits, hot_keys, materialize, may_hold, new_path, normalized, one_of_each, table, text_tag

RUN = "digest long, id long, row long, n long"


def signatures(docs: DataFrame) -> DataFrame:
    """row (distinct), doc_id, id (doc_id, null last), tag, digest, text_sha256 of each row."""
    text = docs.select("doc_id", text_tag().alias("tag"), normalized(F.col("text")).alias("norm"))
    return text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        "tag",
        F.xxhash64("norm").alias("digest"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def merge_runs(digest: np.ndarray, ident: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One sorted run: the smallest (id, row) and the summed count of each digest."""
    order = np.lexsort((row, ident, digest))
    digest, ident, row, n = digest[order], ident[order], row[order], n[order]
    first = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]]) if len(digest) else np.empty(0, int)
    return digest[first], ident[first], row[first], np.add.reduceat(n, first) if len(first) else n


class DigestIndex:
    """An index over (digest, id) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 1 << 18):
        self.spark, self.path, self.memtable_rows = spark, path or new_path(spark, "digest_index"), memtable_rows
        self.runs: list[str] = []

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}"
        df.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(1 << 20)).parquet(path)
        return path

    def flush(self, sigs: DataFrame) -> None:
        """Adds the rows of sigs (digest, id, row) as sorted runs; memory is bounded by memtable_rows."""
        limit = self.memtable_rows

        def memtables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def merged() -> tuple[np.ndarray, ...]:
                return merge_runs(*(np.concatenate([x[i] for x in held]) for i in range(4)))

            for b in batches:
                held.append(merge_runs(b.digest.to_numpy(), b.id.to_numpy(), b.row.to_numpy(), np.ones(len(b), np.int64)))
                size += len(held[-1][0])
                if size >= limit:
                    held = [merged()]
                    size = len(held[0][0])
                    if 2 * size >= limit:
                        yield pd.DataFrame(dict(zip(("digest", "id", "row", "n"), held[0], strict=True)))
                        held, size = [], 0
            if held:
                yield pd.DataFrame(dict(zip(("digest", "id", "row", "n"), merged(), strict=True)))

        runs = sigs.select("digest", "id", "row").mapInPandas(memtables, RUN)
        self.runs.append(self._write(runs, f"run-{len(self.runs)}"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], RUN)

    def compact(self) -> DataFrame:
        """Merges all runs into one level, sorted by digest; the smallest identifier of each digest stays."""

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple[np.ndarray, ...] | None = None  # the last digest, which the next batch may go on with
            for b in batches:
                part = [b[c].to_numpy() for c in ("digest", "id", "row", "n")]
                done = merge_runs(*(part if held is None else [np.r_[x, y] for x, y in zip(held, part, strict=True)]))
                held = tuple(x[-1:] for x in done)
                yield pd.DataFrame(dict(zip(("digest", "id", "row", "n"), (x[:-1] for x in done), strict=True)))
            if held is not None:
                yield pd.DataFrame(dict(zip(("digest", "id", "row", "n"), held, strict=True)))

        runs = self.read().repartitionByRange("digest").sortWithinPartitions("digest", "id", "row")
        self.runs = [self._write(runs.mapInPandas(merge, RUN), f"level-{len(self.runs)}")]
        return self.read()

    def lookup(self, digest: int) -> list[tuple[int, int]]:
        """(smallest id, count) of a digest, or nothing; sorted files and filters bound what is read."""
        return [(r["id"], r["n"]) for r in self.read().where(F.col("digest") == digest).groupBy().agg(F.min("id").alias("id"), F.sum("n").alias("n")).collect() if r["n"]]


def unequal(texts: DataFrame) -> DataFrame:
    """The digests whose texts aren't all the same, byte by byte.  texts: digest, norm."""
    return texts.groupBy("digest").agg(F.collect_set("norm").alias("texts")).where(F.size("texts") > 1).select("digest")


def decide(docs: DataFrame, memtable_rows: int = 1 << 18) -> DataFrame:
    """row, doc_id, id, tag, digest, text_sha256, keep_id, group_size, kept of each row of docs."""
    sigs = materialize(signatures(docs), "signatures")
    index = DigestIndex(docs.sparkSession, memtable_rows=memtable_rows)
    index.flush(sigs)
    hits = materialize(index.compact().where("n > 1"), "hits")
    total, n_hits = sigs.count(), hits.count()
    bits = filter_bits(n_hits)
    words = materialize(bloom(hits, "digest", bits), "filter")
    norm = docs.select(normalized(F.col("text")).alias("norm")).withColumn("digest", F.xxhash64("norm"))
    clash = materialize(unequal(may_hold(norm, "digest", words, bits)), "clashes")
    found = may_hold(sigs, "digest", words, bits).withColumn("sub", F.lit(""))
    hits = hits.withColumn("sub", F.lit(""))
    if clash.head(1):
        found = found.join(clash.withColumn("split", F.lit(True)), "digest", "left").withColumn("sub", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
        apart = found.where("sub != ''").groupBy("digest", "sub").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("n"))
        hits = hits.join(clash, "digest", "left_anti").unionByName(apart.select("digest", "least.id", "least.row", "n", "sub"))
    keep = hits.select("digest", "sub", F.col("id").alias("keep"), F.col("row").alias("keep_row"), "n")
    found = dealt(found, keep, ["digest", "sub"], hot_keys(hits, ["digest", "sub"], total), "row", "left")
    plain = may_hold(sigs, "digest", words, bits, "left_anti")
    out = found.drop("sub").unionByName(plain.withColumns({"keep": F.lit(None).cast("long"), "keep_row": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}))
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id").cast("long")).when(F.col("keep") != NO_ID, F.col("keep"))
    return out.select(
        "row", "doc_id", "id", "tag", "digest", "text_sha256", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    done = materialize(decide(docs).select("id", "tag", F.col("kept").alias("stays")), "decisions")
    return one_of_each(docs, done)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
