"""Mixing sources to target weights by weighted fair queueing.  DataFrame operations only.

Each source is a queue in which every document stands ``repeats`` times, in a shuffled order that
only depends on the seed.  A document's virtual finish time is the number of its source's words up to
and with it, divided by the source's weight.  All documents are ordered by that time and taken until
the budget is spent.  A source whose queue is empty takes part no longer, so its share passes to the
others by weight; the targets are the water level at which this ends.

Defined cases: null text has size 0 and is taken 0 times; null source is a source of its own, after
all others; repeated rows are documents of their own, equal rows are taken alike; an empty table
gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, materialize, table

SEED = 20240229


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, key (orders sources, null last), size, shuffle."""
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull()).alias("shuffle"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> tuple[DataFrame, float, float]:
    """sources: key, source_size.  Adds weight and target; also returns the water level and the budget.

    The table has a row for each source, so its windows have as many rows as there are sources.
    """
    by_key, by_ratio = Window.orderBy("key"), Window.orderBy("ratio", "key")
    ranked = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_key) - 1) % len(weights) + 1)
    )
    capped = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = capped.withColumn(
        "level",
        (F.lit(budget) - (F.sum("cap").over(by_ratio) - F.col("cap")))
        / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    ).where("ratio > level")
    water = level.agg(F.min_by("level", F.struct("ratio", "key"))).first()[0]
    water = float("inf") if water is None else water
    target = F.when(F.col("ratio") <= water, F.col("cap")).otherwise(F.col("weight") * min(water, 1e300))
    return capped.select("key", "source_size", "weight", target.alias("target")), water, budget


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs."""
    rows = materialize(sized(docs, seed), "sizes")
    n = rows.count()
    parts = min(1 << 16, max(256, n // 4000))
    rows = rows.withColumn("part", F.pmod(F.shiftright("shuffle", 11), F.lit(parts)))
    # Running sums in two steps, so that a source with a third of the rows is no task of its own.
    spans = rows.groupBy("key", "part").agg(F.sum("size").alias("span"))
    sources = materialize(spans.groupBy("key").agg(F.sum("span").alias("source_size")), "sources")
    aimed, water, budget = targets(sources, weights, share, repeats)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum("span").over(before), F.lit(0))).join(aimed, "key").drop("span")
    within = Window.partitionBy("key", "part").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("sum", F.sum("size").over(within)).join(offsets, ["key", "part"])
    queued = queued.withColumn("end", F.col("offset") + F.col("sum")).drop("sum", "offset", "part")
    queued = materialize(queued, "queues")

    def order(copy: int) -> F.Column:
        finish = (F.col("end") + copy * F.col("source_size")) / F.col("weight")
        return F.struct(finish.alias("finish"), F.col("key"), F.col("shuffle"), F.col("doc_id"))

    if not n or budget <= 0:
        return queued.select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    # The global order is cut into ranges of virtual time; only the range in which the budget ends is ordered row by row.
    items = queued.where("size > 0").select("size", F.explode(F.array(*(order(c) for c in range(repeats)))).alias("at"))
    ranges = items.select("size", "at", F.least(F.floor(F.col("at.finish") / water * parts), F.lit(2 * parts)).alias("range"))
    sums = ranges.groupBy("range").agg(F.sum("size").alias("size"))
    upto = sums.withColumn("upto", F.sum("size").over(Window.orderBy("range")))
    cut = upto.where(F.col("upto") > budget).orderBy("range").first()
    if cut is None:  # everything fits
        copies = F.when(F.col("size") > 0, F.lit(repeats)).otherwise(0)
    else:
        left = budget - (cut["upto"] - cut["size"])
        last = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        ordered = ranges.where(F.col("range") == cut["range"]).withColumn("upto", F.sum("size").over(last))
        first_out = ordered.where(F.col("upto") > left).agg(F.min("at").alias("at")).select("at.*").first()
        bound = F.struct(*(F.lit(first_out[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("key", "string"), ("shuffle", "long"), ("doc_id", dict(queued.dtypes)["doc_id"]))))
        copies = F.when(F.col("size") > 0, sum((F.when(order(c) < bound, 1).otherwise(0) for c in range(repeats)), F.lit(0))).otherwise(0)
    return queued.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken (and source, copies)."""
    return mix(table(spark, sf_dir, "documents"))
