"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; bytes.split() in Python splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing doc_id when ids are ordered: null sorts after every id.
NO_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session without one gets a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = path or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_RECORDS: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}/{name}"
    for made in _RECORDS:
        made.append(path)
    return path


@contextlib.contextmanager
def recorded(made: list[str]) -> Iterator[None]:
    """Adds to made the folders that operators write meanwhile, so that they can go once nothing reads them."""
    _RECORDS.append(made)
    try:
        yield
    finally:
        _RECORDS.pop()


def release(spark: SparkSession, made: list[str]) -> None:
    """Deletes folders that recorded() has listed."""
    while made:
        remove(spark, made.pop())


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While a table is written: the shuffle files behind it go once it is there."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote and no plan reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalized(text: Column) -> Column:
    """White-space runs become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


#: A key with more than 1 / HOT of all rows is hot; there are less than HOT of them, whatever the input.  Each is dealt over SALTS tasks.
HOT, SALTS = 1000, 64


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> list[int]:
    """Hashes of the hot keys: less than HOT.  counts: keys, n (rows of the key)."""
    return [r["h"] for r in counts.where(F.col("n") > max(1, total // HOT)).select(F.xxhash64(*keys).alias("h")).collect()]


def dealt(big: DataFrame, small: DataFrame, keys: list[str], hot: list[int], by: str, how: str = "inner") -> DataFrame:
    """big joined with small on keys, hot keys of big dealt over several tasks by the column `by`; small's rows of a hot key are
    repeated for each of these tasks."""
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)  # of two keys with one hash both are dealt, on either side
    left = big.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0))
    right = small.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [*keys, "salt"], how).drop("salt")


def filter_bits(n: int, most: int = 18) -> int:
    """log2 of the 64-bit words that a Bloom filter of n hashes takes at about 12 bits each; at most `most`, which bounds its size."""
    return int(min(most, max(4, np.ceil(np.log2(max(n, 1) * 12 / 64)))))


def filter_word(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - bits)


def filter_mask(h: str) -> Column:
    """The three bits of a hash within its word."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({h}, {6 * i}) & 63 as int))" for i in range(3)))


def bloom(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """word, mask of a Bloom filter: at most 2**bits rows, whatever hashes holds; words without a bit are left out."""
    return hashes.select(filter_word(h, bits).alias("word"), filter_mask(h).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def may_hold(rows: DataFrame, h: str, words: DataFrame, bits: int, how: str = "left_semi") -> DataFrame:
    """rows whose hash the filter may hold (left_anti: can't hold); its size is bounded, so it is broadcast."""
    held = F.broadcast(words.select(F.col("word").alias("__word"), F.col("mask").alias("__mask")))
    own = filter_mask(h)
    return rows.join(held, (filter_word(h, bits) == F.col("__word")) & (F.col("__mask").bitwiseAND(own) == own), how)


def text_tag(text: str = "text") -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text, F.col(text).isNull())


def one_of_each(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay.  decided: id (null as NO_ID), tag (text_tag), stays (boolean) of each row of docs."""
    on = ["__id", "__tag"]
    named = decided.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "stays")
    gone = named.where("not stays").select(*on).distinct()
    again = materialize(gone.join(named.where("stays").select(*on), on, "left_semi"), "repeats")  # rows that repeat id and text
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__tag": text_tag()})
    left = rows.join(gone.join(again, on, "left_anti"), on, "left_anti")
    if again.head(1):
        left = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(on))
    return left.drop(*on)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def roll(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each k consecutive word hashes (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= np.uint64(base)
            out += hashes[i : i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
