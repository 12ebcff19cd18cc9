"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the smallest ``gram``-word hash is a fingerprint, on both sides.  A span of
``window`` words that a document shares with an item therefore shares its fingerprint, so no shared span is missed.
The fingerprints of the test side meet those of the documents in a Bloom filter of bounded size; around each hit the
windows that can hold it go on as texts, and are joined with the windows of the items, word by word.  A window that very
many documents hold is dealt over several tasks.  An item of fewer words is one window of its own length, whose whole
hash is its fingerprint.

Documents are read once, whatever the size of the benchmark, of which nothing but the filter is broadcast.

Defined cases: null and empty texts have no words and no hits; a null item_id counts as empty text; items with equal
item_id count once; rows of documents are judged one by one, whatever repeats; an empty benchmark leaves all clean; other
columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ID, bloom, dealt, filter_bits, hot_keys, materialize, roll, table, text_tag, word_hashes

WINDOW, GRAM, CHUNK_BYTES = 10, 5, 1 << 20
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
SPOTS = "row long, id long, tag long, n_words long, spots array<struct<start:int,size:int,text:string>>"
_SPOT = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("text", pa.string())]))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def sliding(h: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    n = len(h) - width + 1
    out = h[: max(n, 0)].copy()
    for i in range(1, width):
        op(out, h[i : i + n], out=out)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some window of words."""
    h = roll(hashes, gram)
    width = window - gram + 1
    if len(h) < width:
        return np.empty(0, np.int64), h[:0]
    least = sliding(h, width)
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """text, size, items of each distinct window of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                size = min(window, len(w))
                texts = list({b" ".join(w[i : i + size]).decode("utf-8", "surrogatepass") for i in range(len(w) - size + 1)}) if w else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array([size] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["item", "size", "text"])

    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(run, "item string, size int, text string").groupBy("text", "size").agg(F.collect_set("item").alias("items"))


def fingerprints(windows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """h, size of the smallest gram of each whole window, and of each short window as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [int(roll(word_hashes(t.encode("utf-8", "surrogatepass").split()), gram if n == window else n).min()) for t, n in zip(b.column("text").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), b.column("size")], ["h", "size"])

    return windows.select("text", "size").mapInArrow(run, "h long, size int").distinct()


class Prints:
    """A Bloom filter of the fingerprints, and the lengths of the short windows."""

    def __init__(self, prints: DataFrame, window: int, most_bits: int):
        kinds = {r["size"]: r["n"] for r in prints.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
        self.bits = filter_bits(sum(kinds.values()), most_bits)
        self.short = sorted(k for k in kinds if k != window)
        self.words = np.zeros(1 << self.bits, np.uint64)
        found = bloom(prints, "h", self.bits).toPandas()
        self.words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(h), np.uint64)
        for i in range(3):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return self.words[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & mask == mask


def spots(texts: list[str | None], prints: Prints, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, list[dict]]]:
    """(number of words, windows that may be an item's) of each text."""
    for part in chunks(texts):
        each = [words(t) for t in texts[part]]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
        w = [x for e in each for x in e]
        hashes = word_hashes(w)
        at, h = winnow(hashes, window, gram)
        p = at[prints.may_hold(h)]
        start = np.unique((p[:, None] + np.arange(gram - window, 1)).ravel())
        found = [(start, window)]
        for size in prints.short:
            found.append((np.flatnonzero(prints.may_hold(roll(hashes, size))), size))
        out: list[list[dict]] = [[] for _ in each]
        for start, size in found:
            start = start[(start >= 0) & (start + size <= len(w))]
            doc = np.searchsorted(bounds, start, "right") - 1
            whole = start + size <= bounds[doc + 1]
            for s, d in zip(start[whole].tolist(), doc[whole].tolist(), strict=True):
                out[d].append({"start": s - int(bounds[d]), "size": size, "text": b" ".join(w[s : s + size]).decode("utf-8", "surrogatepass")})
        yield from zip(map(len, each), out, strict=True)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive slices of texts with about limit characters; one long text is a slice by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def joined(docs: DataFrame, bench: DataFrame, most_bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """row, id, tag, n_words of each row of docs; and row, id, tag, start, size, items of each window that is an item's.

    The filter takes at most 8 * 2**most_bits bytes."""
    windows = materialize(item_windows(bench), "item_windows")
    held = docs.sparkSession.sparkContext.broadcast(Prints(materialize(fingerprints(windows), "fingerprints"), WINDOW, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = zip(*spots(b.column("text").to_pylist(), held.value), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("tag"), pa.array(n, pa.int64()), pa.array(found, _SPOT)], ["row", "id", "tag", "n_words", "spots"])

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_tag().alias("tag"), "text")
    rows = materialize(named.mapInArrow(run, SPOTS), "spots")
    each = rows.where(F.size("spots") > 0).select("row", "id", "tag", F.explode("spots").alias("s")).select("row", "id", "tag", "s.*")
    counts = each.groupBy("text").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum(F.size("spots"))).first()[0] or 0
    return rows.drop("spots"), dealt(each, windows.select("text", "items"), ["text"], hot_keys(counts, ["text"], total), "row")


def report(docs: DataFrame, bench: DataFrame, most_bits: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of each row of docs."""
    rows, hits = joined(docs, bench, most_bits)
    hits = materialize(hits.select("row", "start", "size", "items"), "hits")
    step = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        F.array_sort("spans"), step,
        lambda a, x: F.struct((a["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("covered"), F.greatest(a["reach"], x["end"]).alias("reach")),
        lambda a: a["covered"].cast("long"),
    )
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans")).select("row", covered.alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(items, "row")
    out = rows.join(found, "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def clean(docs: DataFrame, bench: DataFrame, most_bits: int = 20) -> DataFrame:
    """The rows of docs without any word of a benchmark window, with all their columns."""
    _, hits = joined(docs.select("doc_id", "text"), bench, most_bits)
    gone = materialize(hits.select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct(), "contaminated")
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__tag": text_tag()})
    return rows.join(gone, ["__id", "__tag"], "left_anti").drop("__id", "__tag")


def op7_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and items) of every document."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
