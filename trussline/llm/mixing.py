"""Mixing of sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's share of the whole follows its weight, but no source is repeated
beyond its largest number of epochs; what a clamped source can't take goes to
the others by weight, until none is above its cap. This fixed point is a water
level: with the sources in order of cap / weight, the first ones are clamped
and all others get level * weight, which running sums over the (few) sources
give at once. Of a source with ratio r = target / size each document is taken
floor(r) times, and a seeded order decides which documents are taken once more;
the document on which the target falls is taken in part, so that each source
meets its target to within a word.

A source's seeded order is that of a hash of id and text, by buckets of the
hash first. Only narrow rows (source, size, hash) are summed: bucket totals show
the one bucket of a source in which its target falls, and only that bucket is
put in order, to find the hash on which it falls. Every row is then decided
where it is read, by comparing its hash with its source's; the row of that very
hash takes what is left, which repeated rows share evenly (to within a word for
each). So no text moves, and a source with a third of all rows is spread over
as many tasks as any other rows.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; sources of size 0 get target 0; no rows give
no rows; repeated rows are sampled as rows of their own; null or equal ids with
different texts are ordered by their texts; other columns are kept out of the
result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets of a source's seeded order, at least; more rows to a source make more.
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat over the sources in code point order, null last.

    One row per source: sources are names of collections, not a key that grows with the rows.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    filled = (
        capped.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_from", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("cap_before", F.lit(0.0))) / F.col("w_from"))
        .withColumn("clamped", F.col("level") * F.col("w") > F.col("cap"))
    )
    # The water level is the first one at which the source itself is not clamped.
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return filled.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3, seed: int = 17, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep columns, size, source_size, target, taken for every document."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text")
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "source", word_count(F.col("text")).alias("size"), order.alias("h"))
    narrow = written(own.select("source", "size", "h"), "sizes")
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = targets(by_source.select("source", "source_size"), weights, epochs)
    plan = plan.join(by_source.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = plan.select("*", F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"))
    plan = plan.withColumn("more", F.coalesce(F.round(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0)).cast("long")).withColumnRenamed("source", "plan_source")
    plan = written(plan, "plan")
    bucket = F.pmod(F.shiftright("h", 20), F.col("buckets"))
    same_source = F.col("source").eqNullSafe(F.col("plan_source"))
    # The bucket in which a source's target falls, and in it the hash.
    rows = narrow.join(plan, same_source).withColumn("bucket", bucket)
    totals = rows.groupBy("plan_source", "more", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("plan_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = totals.withColumn("before", F.sum("n").over(upto) - F.col("n")).where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("n"))).select(F.col("plan_source").alias("e_source"), F.col("bucket").alias("edge"), "before")
    inside = rows.join(edge, F.col("plan_source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("edge"))).groupBy("plan_source", "more", "edge", "before", "h").agg(F.sum("size").alias("n"), F.count("*").alias("same"))
    upto = Window.partitionBy("plan_source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("start", F.col("before") + F.sum("n").over(upto) - F.col("n")).where((F.col("start") < F.col("more")) & (F.col("more") <= F.col("start") + F.col("n")))
    cut = inside.select(F.col("plan_source").alias("c_source"), "edge", F.col("h").alias("cut"), F.floor((F.col("more") - F.col("start")) / F.col("same")).alias("left"))
    plan = written(plan.join(cut, F.col("plan_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "plan")
    rows = own.join(plan, same_source)
    on_edge = (bucket == F.col("edge")) & (F.col("h") == F.col("cut"))
    before = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (F.col("h") < F.col("cut")))
    extra = F.when(on_edge, F.least("size", "left")).when(before, F.col("size")).otherwise(0)
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"))
