"""Near-duplicate detection with Order MinHash.

A document's k-mers are its runs of five words, each labelled with its occurrence number.  A sketch takes, for
each of 24 hash functions, the four smallest labelled k-mers and keeps them in text order; documents that share
one of these become candidates.  Two long documents at similarity 0.8 share none with probability 3e-6; short ones
more often (8 of 10 k-mers in common: 6e-5; 4 of 5: 0.47 %).

Verification: labelled k-mers agree to 0.8 or more (Jaccard), and a banded alignment of the words leaves at
least 0.8 of the longer text matched, so a text with its parts in another order is no copy.

Groups are never paired out.  Equal texts are one vertex.  Each bucket compares its members with its first one
(a star).  What that leaves in different components is compared within the bucket where a link is possible at all:
the triangle inequality of the Jaccard distance must allow it, and the two must share one of the rarest k-mers of
each (at similarity 0.8 two texts share one of the first 20 % of theirs, by any order).  Two texts that share several
buckets are compared in the first of them.  A task holds at most CHUNK members, of which each weighs one and one more
for every WEIGHT bytes of packed text.  A heavier bucket is split by those rarest k-mers into smaller ones that keep every
possible link; if one doesn't get smaller, half of what a task holds are heads that meet all others in pieces and then
leave the bucket, round by round.  So no link between bucket mates of different components is lost, whatever the size of
a bucket; and keys and leaders that very many rows have are dealt over several tasks.

Defined cases: null and empty texts (no words) are classes of their own; texts of fewer than five words are one
k-mer; a null doc_id sorts after every id, and a class of such rows has class id null; repeated rows are equal
texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.blocks import press, unpress
from graphloom.llm.common import NO_ID, dealt, hot_keys, materialize, mix, one_of_each, roll, table, text_tag, word_hashes

K, SIMILARITY, SKETCHES, SMALLEST, CHUNK, WEIGHT = 5, 0.8, 24, 4, 4000, 4096
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def labelled(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k-mers in text order, each mixed with the number of its like before it."""
    grams = roll(hashes, min(k, len(hashes))) if len(hashes) else hashes
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    if len(first) == len(s):
        return grams
    number = np.empty(len(s), np.uint64)
    number[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    with np.errstate(over="ignore"):
        return mix(grams + number * np.uint64(0xD6E8FEB86659FD93))


def sketch(grams: np.ndarray, smallest: int = SMALLEST) -> np.ndarray:
    """For each hash function one value, of the smallest labelled k-mers in text order."""
    if not len(grams):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        ranks = (grams[None, :] ^ _SEEDS) * np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(32)
        if len(grams) > smallest:
            at = np.sort(np.argpartition(ranks, smallest - 1, axis=1)[:, :smallest], axis=1)
        else:
            at = np.tile(np.arange(len(grams)), (SKETCHES, 1))
        value = np.zeros(SKETCHES, np.uint64)
        for c in grams[at].T:
            value = mix(value * np.uint64(31) + c)
    return (value ^ _SEEDS[:, 0]).view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - Jaccard of two sorted arrays of distinct labelled k-mers."""
    if not len(a) or not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / (len(a) + len(b) - both)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether a banded alignment matches at least this share of the longer text's words.

    The band is as wide as the share allows.  A row of the table is one integer, with a bit for each column."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return False
    short = min(n, m)
    diff = np.flatnonzero(a[:short] != b[:short])
    head = int(diff[0]) if len(diff) else short
    rest = short - head
    diff = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else diff
    tail = (int(diff[0]) if len(diff) else rest) if rest else 0
    matched, need, band = head + tail, least * max(n, m), int((1 - least) * max(n, m)) + 1
    a, b = a[head : n - tail], b[head : m - tail]
    if matched >= need or not len(a) or not len(b):
        return matched >= need
    places: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    full, row, width = (1 << len(b)) - 1, (1 << len(b)) - 1, (1 << (2 * band + 1)) - 1
    for i, w in enumerate(a.tolist()):
        hit = places.get(w, 0) & (width << (i - band) if i >= band else width >> (band - i))
        u = row & hit
        row = ((row + u) | (row - u)) & full
    return matched + len(b) - row.bit_count() >= need


class Text:
    def __init__(self, data: bytes):
        self.words = word_hashes(unpress(data).split())
        self.grams = np.sort(labelled(self.words))

    def far(self, other: Text) -> float:
        return distance(self.grams, other.grams)


def linked(x: Text, y: Text, far: float) -> bool:
    return far <= 1 - SIMILARITY + 1e-9 and aligned(x.words, y.words)


SIGNATURE = "row long, id long, tag long, one long, two long, n long, keys array<long>, data binary"


def signatures(docs: DataFrame) -> DataFrame:
    """row (distinct), id (null last), 128-bit hash of the words, their number, sketch and packed text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column("text").to_pylist():
                words = split(text)
                joined = b" ".join(words)
                high, low = divmod(xxhash.xxh3_128_intdigest(joined), 1 << 64)
                out[0].append(high - (1 << 63))
                out[1].append(low - (1 << 63))
                out[2].append(len(words))
                out[3].append(sketch(labelled(word_hashes(words))))
                out[4].append(press(joined))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("tag"), *map(pa.array, out, kinds)], ["row", "id", "tag", "one", "two", "n", "keys", "data"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_tag().alias("tag"), "text")
    return materialize(rows.mapInArrow(run, SIGNATURE), "sketches")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v, far, link of each pair (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, Text | None] = (None, None)
        for b in batches:
            far, link = [], []
            for u, mine, other in zip(b.column("u").to_pylist(), b.column("of_u").to_pylist(), b.column("of_v").to_pylist(), strict=True):
                x = last[1] if last[0] == u else Text(mine)
                last, y = (u, x), Text(other)
                far.append(x.far(y))
                link.append(linked(x, y, far[-1]))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(far, pa.float64()), pa.array(link, pa.bool_())], ["u", "v", "far", "link"])

    leaders = pairs.groupBy("u").agg(F.count("*").alias("n"))
    hot = hot_keys(leaders, ["u"], pairs.count())
    one = pairs.join(texts.select(F.col("row").alias("v"), F.col("data").alias("of_v")), "v")
    both = dealt(one, texts.join(leaders.select(F.col("u").alias("row")), "row", "left_semi").select(F.col("row").alias("u"), F.col("data").alias("of_u")), ["u"], hot, "v")
    return both.sortWithinPartitions("u").select("u", "v", "of_u", "of_v").mapInArrow(run, "u long, v long, far double, link boolean")


def components(edges: DataFrame) -> DataFrame:
    """row, comp (smallest row of its component) for each row that has an edge (u, v), by alternating stars."""
    e = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    mark, total = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = dealt(both, least.select("u", "m"), ["u"], hot_keys(least, ["u"], 2 * total), "v").where("v > u").select(F.greatest("v", "m").alias("hi"), F.least("v", "m").alias("lo")).where("hi != lo").distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = dealt(large, small_least.select("hi", "m"), ["hi"], hot_keys(small_least, ["hi"], total), "lo").where("lo != m").select(F.col("lo").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(small_least.select(F.col("hi").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        new = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            break
        mark, total = new, new[0]
    roots = e.select(F.col("v").alias("row")).distinct().withColumn("comp", F.col("row"))
    return e.select(F.col("u").alias("row"), F.col("v").alias("comp")).unionByName(roots)


def prefix(size: int) -> int:
    """Of so many k-mers, how many of the rarest any text at the similarity shares one of."""
    return size - int(np.ceil(SIMILARITY * size - 1e-9)) + 1


def resolve(groups: DataFrame) -> DataFrame:
    """Links (u, v) between different components within each (key, chunk): bucket, row, comp, far (from the bucket's first), data, keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        texts = [Text(d) for d in pdf.data]
        far, comp, rows = pdf.far.to_numpy(), pdf.comp.to_numpy().copy(), pdf.row.to_numpy()
        keys, bucket = np.stack(pdf["keys"].to_list()), pdf.bucket[0]
        owner = np.repeat(np.arange(len(texts)), [len(t.grams) for t in texts])
        _, gram, count = np.unique(np.concatenate([t.grams for t in texts]), return_inverse=True, return_counts=True)
        order = np.lexsort((gram, count[gram], owner))
        owner, gram = owner[order], gram[order]
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        rarest = np.concatenate([np.arange(first[i], first[i] + prefix(len(t.grams))) for i, t in enumerate(texts)])
        shared = rarest[count[gram[rarest]] > 1]
        by_gram = shared[np.lexsort((owner[shared], gram[shared]))]
        lists = np.split(owner[by_gram], np.flatnonzero(np.diff(gram[by_gram])) + 1) if len(by_gram) else []
        mates: list[list[np.ndarray]] = [[] for _ in texts]
        for members in lists:
            if len(members) > 1 and len(np.unique(comp[members])) > 1:
                for at, i in enumerate(members.tolist()):
                    mates[i].append(members[:at])
        out = []
        for i, some in enumerate(mates):
            if not some:
                continue
            others = np.unique(np.concatenate(some))
            may = others[(comp[others] != comp[i]) & (np.abs(far[others] - far[i]) <= 1 - SIMILARITY + 1e-9)]
            first_shared = (keys[may] == keys[i]).argmax(1)
            for j in may[keys[i][first_shared] == bucket].tolist():
                if comp[j] != comp[i] and linked(texts[j], texts[i], texts[j].far(texts[i])):
                    out.append((rows[j], rows[i]))
                    comp[comp == comp[i]] = comp[j]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return groups.groupBy("key", "chunk").applyInPandas(run, "u long, v long")


def finer(state: DataFrame, texts: DataFrame) -> DataFrame:
    """Buckets (bucket, key, row, comp, far, weight) split by the members' rarest k-mers: members that can have a link share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [Text(d).grams.view(np.int64) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), pa.array(grams, pa.list_(pa.int64()))], ["key", "row", "grams"])

    held = state.join(texts, "row").select("key", "row", "data").mapInArrow(run, "key long, row long, grams array<long>")
    each = materialize(held.select("key", "row", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "grams")
    common = materialize(each.groupBy("key", "gram").agg(F.count("*").alias("n")), "common")
    place = Window.partitionBy("key", "row").orderBy("n", "gram")
    least = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    counted = dealt(each, common, ["key", "gram"], hot_keys(common, ["key", "gram"], each.count()), "row")
    rarest = counted.withColumn("place", F.row_number().over(place)).where((F.col("place") <= least) & (F.col("n") > 1))
    return state.join(rarest.select("key", "row", "gram"), ["key", "row"]).select("bucket", F.xxhash64("key", "gram").alias("key"), "row", "comp", "far", "weight")


def dealt_rounds(state: DataFrame, sized: DataFrame, turn: int) -> DataFrame:
    """state with w, head and in_chunks: a bucket that one task can hold is one chunk; of a heavier one members of about
    CHUNK / 2 by weight are heads, which are in all chunks, and each other member is in one of them.

    sized: key, w (weight), n of each bucket.  What is drawn differs from turn to turn."""
    draw = F.pmod(F.xxhash64("row", "key", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
    heavy = F.col("w") > CHUNK
    drawn = state.withColumn("draw", draw)
    least = drawn.groupBy("key").agg(F.min("draw").alias("least"))  # one head at least
    buckets = sized.where("n > 1").join(least, "key")
    both = dealt(drawn, buckets.drop("n"), ["key"], hot_keys(buckets, ["key"], state.count()), "row")
    marked = both.withColumn("head", heavy & ((F.col("draw") < F.lit(CHUNK / 2) / F.col("w")) | (F.col("draw") == F.col("least"))))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("w") * 2 / CHUNK)).cast("long")
    own = F.array(F.pmod(F.xxhash64("row", F.lit(turn), F.lit("chunk")), chunks))
    in_chunks = F.when(~heavy, F.array(F.lit(0).cast("long"))).when(F.col("head"), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(own)
    return materialize(marked.withColumn("in_chunks", in_chunks).drop("draw", "least"), "work")


def with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.drop("comp").join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row"))


def left_over(state: DataFrame) -> DataFrame:
    """Members of buckets (key, row, comp, ...) that still can have a link to another component there; written."""
    state = materialize(state, "members_left")
    each = state.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a != b")
    return dealt(state, each.select("key"), ["key"], hot_keys(each, ["key"], state.count()), "row")


def classes(docs: DataFrame) -> DataFrame:
    """row, id, tag, class_id, class_size, is_first of each row of docs."""
    sigs = signatures(docs)
    some = sigs.where("n > 0")
    first = materialize(some.groupBy("one", "two").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "texts_once")
    once = some.select("row", "one", "two", "keys", "data").join(first.select(F.col("rep").alias("row")), "row", "left_semi")
    members = materialize(once.select("row", F.explode(F.array_distinct("keys")).alias("key")), "members")
    n_members = members.count()
    size = materialize(members.groupBy("key").agg(F.min("row").alias("leader"), F.count("*").alias("n")).where("n > 1"), "sizes")
    hot = hot_keys(size, ["key"], n_members)
    buckets = materialize(dealt(members, size.select("key", "leader"), ["key"], hot, "row"), "buckets")
    texts = materialize(once.join(buckets.select("row").distinct(), "row", "left_semi").select("row", "data", "keys", (1 + F.floor(F.length("data") / WEIGHT)).cast("long").alias("weight")), "candidates")
    pairs = materialize(buckets.where("row != leader").select(F.col("leader").alias("u"), F.col("row").alias("v")).distinct(), "pairs")
    checked = materialize(verify(pairs, texts), "checked")
    edges = checked.where("link").select("u", "v")
    comps = materialize(components(edges), "components")

    # What a bucket's first member leaves in different components.
    far = checked.select(F.col("u").alias("leader"), F.col("v").alias("row"), "far")
    state = with_component(buckets.where("row != leader").join(far, ["leader", "row"]), comps)
    lead = comps.select(F.col("row").alias("leader"), F.col("comp").alias("lead"))
    state = materialize(dealt(state, lead, ["leader"], hot_keys(checked.groupBy(F.col("u").alias("leader")).agg(F.count("*").alias("n")), ["leader"], n_members), "row", "left").withColumn("lead", F.coalesce("lead", "leader")), "led")
    near = state.where("comp != lead").groupBy("key").agg(F.min("far").alias("near"))
    state = left_over(dealt(state, near, ["key"], hot, "row").where((F.col("comp") != F.col("lead")) | (F.col("far") >= F.col("near") - (1 - SIMILARITY))).select(F.col("key").alias("bucket"), "key", "row", "comp", "far"))
    state = materialize(state.join(texts.select("row", "weight"), "row"), "left_over")
    again, largest = 0, None  # a bucket is split by its members' k-mers before the first round, as long as that helps
    while True:
        sized = materialize(state.groupBy("key").agg(F.sum("weight").alias("w"), F.count("*").alias("n")), "sized")
        most = sized.agg(F.max("w")).first()[0] or 0
        if most > CHUNK and not again and (largest is None or most <= 0.8 * largest):
            largest = most
            large = sized.where(F.col("w") > CHUNK).select("key")
            split_up = left_over(finer(state.join(large, "key", "left_semi"), texts))  # at most sum(w) / CHUNK keys are large
            state = materialize(state.join(large, "key", "left_anti").unionByName(split_up), "left_over")
            continue
        work = dealt_rounds(state, sized, again)
        groups = work.withColumn("chunk", F.explode("in_chunks")).join(texts.drop("weight"), "row").select("bucket", "key", "chunk", "row", "comp", "far", "data", "keys")
        found = materialize(resolve(groups), "links")
        edges = materialize(edges.unionByName(found), "all_links")
        comps = materialize(components(edges), "components") if found.head(1) else comps
        if most <= CHUNK:
            break
        rest = left_over(with_component(work.where("w > %d and not head" % CHUNK).select("bucket", "key", "row", "far", "weight"), comps))
        state = materialize(rest.select("bucket", "key", "row", "comp", "far", "weight"), "left_over")
        again += 1

    roots = with_component(first.select("one", "two", F.col("rep").alias("row")), comps).select("one", "two", "comp")
    placed = dealt(sigs.select("row", "id", "tag", "one", "two", "n"), roots, ["one", "two"], hot_keys(first, ["one", "two"], sigs.count()), "row", "left")
    placed = materialize(placed.select("row", "id", "tag", F.when(F.col("n") > 0, F.col("comp")).otherwise(-1 - F.col("row")).alias("comp")), "placed")
    least = materialize(placed.groupBy("comp").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("class_size")), "least")
    out = dealt(placed, least, ["comp"], hot_keys(least.withColumnRenamed("class_size", "n"), ["comp"], placed.count()), "row")
    class_id = F.when(F.col("least.id") != NO_ID, F.col("least.id"))
    return out.select("row", "id", "tag", class_id.alias("class_id"), "class_size", (F.col("row") == F.col("least.row")).alias("is_first"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their class, with all their columns."""
    done = materialize(classes(docs.select("doc_id", "text")), "decisions")
    return one_of_each(docs, done.select("id", "tag", F.col("is_first").alias("stays")))


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id (its class's smallest doc_id), class_size, is_first of every document."""
    done = classes(table(spark, sf_dir, "documents"))
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "class_id", "class_size", "is_first")
