"""One-to-one assignment of alike rows of two tables, without forming all their pairs.

Rows of one likeness and place can be thousands (bolts of one kind in one cell),
so nothing here pairs a group with a group. Rows are numbered inside their group by
ranges (a group with a third of all rows is spread over many tasks) and meet by
number; or they meet in the cells of a grid, crowded cells by bands of
numbers, and the pairs, whose count grows with the rows, are settled by rounds
of mutual best choices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.scratch import checkpointed

#: Rows of one likeness in a cell beyond which two cells meet by bands of so many numbers.
CROWD = 64


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """rows with their number, from 1, among those of the same by (nulls are a value), in that order.

    Rows are dealt by ranges of by and order and numbered inside a range; a group that goes on
    from earlier ranges is moved up by what those hold of it: one group a range, so
    that table is broadcast. Ranges are checkpointed, as a second sampling might differ.
    """
    ranged = checkpointed(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("_before", earlier).where("_before > 0").select(F.col("_range").alias("_r"), "_before", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    return inside.join(F.broadcast(before), same, "left").withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def by_number(old: DataFrame, new: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(o_key, n_key): the k-th old row of a group with its k-th new one; columns are by and order after o_ and n_. Null groups pair nothing."""
    sides = []
    for rows, s in ((old, "o"), (new, "n")):
        sound = rows.dropna(subset=[f"{s}_{c}" for c in by])
        kept = list(dict.fromkeys([*(f"{s}_{c}" for c in by), *(f"{s}_{c}" for c in order), f"{s}_key"]))
        sides.append(numbered(sound.select(*kept), [f"{s}_{c}" for c in by], [f"{s}_{c}" for c in order], f"{s}_at"))
    same = F.col("o_at") == F.col("n_at")
    for c in by:
        same = same & (F.col(f"o_{c}") == F.col(f"n_{c}"))
    return sides[0].join(sides[1], same).select("o_key", "n_key")


def _placed(rows: DataFrame, s: str, by: Sequence[str], width: float, crowd: int) -> DataFrame:
    """rows with their cell, whether more than crowd of their likeness are in it, and there their number in it."""
    cells = [f"{s}_c{a}" for a in "xyz"]
    home = [f"{s}_{c}" for c in by] + cells
    out = rows.dropna(subset=[f"{s}_{c}" for c in (*by, "x", "y", "z")]).withColumns({f"{s}_c{a}": F.floor(F.col(f"{s}_{a}") / width) for a in "xyz"})
    sizes = out.groupBy(*home).agg(F.count("*").alias(f"{s}_here")).where(F.col(f"{s}_here") > crowd)
    many = out.join(sizes, home, "leftsemi")
    few = out.join(sizes, home, "leftanti").withColumn(f"{s}_at", F.lit(None).cast("bigint"))
    return few.unionByName(numbered(many, home, [f"{s}_x", f"{s}_y", f"{s}_z", f"{s}_key"], f"{s}_at"))


def neighbours(old: DataFrame, new: DataFrame, by: Sequence[str], width: float, crowd: int = CROWD) -> DataFrame:
    """All columns of pairs of old and new rows of the same by in the same or neighbouring cells, and apart (difference of their numbers).

    Two cells that are both crowded compare rows whose numbers, in order of position, are in the same or
    neighbouring bands of crowd; all others compare every row, so a row has 27 * 3 * crowd partners at most.
    """
    a, b = checkpointed(_placed(old, "o", by, width, crowd)), checkpointed(_placed(new, "n", by, width, crowd))
    for x in "xyz":
        b = b.withColumn(f"h{x}", F.explode(F.sequence(F.col(f"n_c{x}") - 1, F.col(f"n_c{x}") + 1)))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"o_{c}") == F.col(f"n_{c}"))
    for x in "xyz":
        same = same & (F.col(f"o_c{x}") == F.col(f"h{x}"))
    band = lambda s: F.floor((F.col(f"{s}_at") - 1) / crowd)
    few = a.where("o_at is null").join(b, same).unionByName(a.where("o_at is not null").join(b.where("n_at is null"), same))
    banded = b.where("n_at is not null").withColumn("_band", F.explode(F.sequence(band("n") - 1, band("n") + 1)))
    many = a.where("o_at is not null").withColumn("_own", band("o")).join(banded, same & (F.col("_own") == F.col("_band"))).drop("_own", "_band")
    apart = F.when(F.col("o_at").isNotNull() & F.col("n_at").isNotNull(), F.abs(F.col("o_at") - F.col("n_at"))).otherwise(F.lit(0).cast("bigint"))
    extra = [f"{s}_{c}" for s in "on" for c in ("cx", "cy", "cz", "at")] + [f"h{x}" for x in "xyz"]
    return few.unionByName(many).withColumn("apart", apart).drop(*extra)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """(o_key, n_key, confidence) one to one: rounds in which the pairs that are best for both of their rows are taken, until no pair is left.

    Best is the highest confidence, then the least difference of numbers, then the least hash, one order for
    both sides, so every round takes a pair at least, and rows that stand in a line don't wait for one another.
    """
    order = [F.desc("confidence"), "apart", F.xxhash64("o_key", "n_key"), "o_key", "n_key"]
    left = checkpointed(pairs.groupBy("o_key", "n_key").agg(F.max("confidence").alias("confidence"), F.min("apart").alias("apart")))
    done = left.limit(0).drop("apart")
    while True:
        first = lambda s: F.row_number().over(Window.partitionBy(f"{s}_key").orderBy(*order))
        taken = checkpointed(left.select("*", first("o").alias("a"), first("n").alias("b")).where("a = 1 and b = 1").select("o_key", "n_key", "confidence"))
        if taken.isEmpty():
            return done
        done = done.unionByName(taken)
        left = checkpointed(left.join(taken.select("o_key"), "o_key", "leftanti").join(taken.select("n_key"), "n_key", "leftanti"))
