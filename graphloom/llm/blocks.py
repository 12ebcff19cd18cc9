"""Documents in blocks, and an exchange of packed arrays between blocks and hash shards.

Corpus-wide counts need every word or phrase of every document to meet its equals.  Rows for single words
would cost far more than the text itself, so documents are packed into blocks of about BLOCK_BYTES of text
(one row each), a block sends each shard one packed array of what it has in that shard, in a fixed order, and
the shard answers each block with an array in the same order.  Every task holds one block, or one shard, of
bounded size: the number of shards follows the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ID, new_path, remove, tidy

BLOCK_BYTES = 6 << 20
PARTS = "block long, shard int, size long, data binary"
PAYLOAD, NOTE = -1, -2


def press(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes() if isinstance(x, np.ndarray) else x)


def unpress(x: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def pack_docs(ids: list[int | None], texts: list[str | None]) -> bytes:
    batch = pa.record_batch({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_docs(data: bytes) -> tuple[list[int | None], list[str]]:
    t = pa.ipc.open_stream(data).read_all()
    return t.column("id").to_pylist(), [x or "" for x in t.column("text").to_pylist()]


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in keys) of sorted distinct 64-bit hashes: each shard is a range of hashes."""
    edges = np.searchsorted(keys, (np.arange(1, shards, dtype=np.uint64) * np.uint64(2**64 // shards)).astype(np.uint64))
    for s, (a, b) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
        if b > a:
            yield s, slice(int(a), int(b))


Part = tuple[int, int, int, bytes]  # block, shard, size, data


def blocks_of(docs: DataFrame, make: Callable[[int, list, list], Iterable[Part]], limit: int = BLOCK_BYTES) -> DataFrame:
    """make(block, ids, texts) of each block of documents, sorted by id (null last); written to the shared folder.

    docs: doc_id, text.  The parts' kinds (payload, or for shards) are folders, so that either is read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        texts: list = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, size, count
            order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
            parts = make(base + count, [ids[i] for i in order], [texts[i] or "" for i in order])
            ids, texts, size, count = [], [], 0, count + 1
            for p in parts:
                yield pa.RecordBatch.from_pydict({"block": [p[0]], "shard": pa.array([p[1]], pa.int32()), "size": [p[2]], "data": pa.array([p[3]], pa.binary())})

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 16
                if size >= limit:
                    yield from close()
        if ids:
            yield from close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PARTS)
    return stored(rows, "blocks")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Written by kind; `kind` is part of the path."""
    path = new_path(rows.sparkSession, name)
    kinds = rows.withColumn("kind", F.when(F.col("shard") >= 0, "part").when(F.col("shard") == PAYLOAD, "payload").otherwise("note"))
    with tidy(rows.sparkSession):
        kinds.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(PARTS + ", kind string").parquet(path)


def drop_parts(rows: DataFrame) -> None:
    """Deletes what a stored table sent to shards, once all have answered."""
    if files := rows.inputFiles():
        remove(rows.sparkSession, files[0].rpartition("/kind=")[0] + "/kind=part")


def parts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'part'").drop("kind")


def payloads(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'payload'").drop("kind")


def notes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'note'").drop("kind")


def per_shard(rows: DataFrame, answer: Callable[[int, pd.DataFrame], Iterable[Part]]) -> DataFrame:
    """answer(shard, its parts ordered by block): parts again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        return pd.DataFrame(list(answer(int(pdf.shard[0]), pdf)), columns=["block", "shard", "size", "data"])

    return rows.groupBy("shard").applyInPandas(run, PARTS)


def per_block(rows: DataFrame, finish: Callable[[int, bytes, dict[int, tuple[int, bytes]], pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """finish(block, payload, (size, data) by shard, notes) of all parts that belong to a block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        own = pdf[pdf.shard == PAYLOAD]
        return finish(int(pdf.block[0]), own.data.iloc[0], {s: (n, d) for s, n, d in zip(pdf.shard, pdf["size"], pdf.data, strict=True) if s >= 0}, pdf[pdf.shard == NOTE])

    return rows.groupBy("block").applyInPandas(run, schema)


def shard_count(docs: DataFrame) -> int:
    """Shards for a table, by its number of rows (which Parquet knows): about 4,000 documents a shard, 64 at least."""
    return int(min(1 << 14, max(64, docs.count() // 4000)))
