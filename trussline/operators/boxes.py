"""Joins of axis-aligned boxes: closed-interval overlap on two or three axes, by grid cells.

Boxes are columns key, x0, y0, z0, x1, y1, z1. Each box goes to every cell of a
grid that it touches, and boxes meet by an equi-join on the cell, which Spark
shuffles, broadcasts or splits as it does any join. A pair that meets in several
cells is kept only in the one that holds the lower corner of its overlap, so no
distinct is needed. Huge boxes are not copied to many cells: each box has a level
by its size, whose cells are STEP times as wide as those of the level below, and
a pair meets on the level of its coarser box. There is no last level: a box of
any size touches two cells an axis at most on its own, and goes up only to the
levels that boxes of the other side have. Boxes alike meet as one with a list of
at most ALIKE keys, and pairs of keys are made where such boxes have met, so
thousands of copies of a box cost what one costs until the pairs are given out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider the cells of a level are than those of the level below; a box is no wider than a cell of its own level.
STEP = 8
AXES = "xyz"
#: Keys that a row holds at most where rows alike go as one.
ALIKE = 256


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows that differ in key alone as one with the array of their keys, or as several of at most ALIKE keys each; by one shuffle."""
    same = [c for c in rows.columns if c != key]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(key)) - 1
    return rows.withColumn("_part", F.floor(nth / ALIKE)).groupBy(*same, "_part").agg(F.collect_list(key).alias(key)).select(*rows.columns)


def sound(boxes: DataFrame, axes: str = AXES) -> DataFrame:
    """Boxes without null, NaN or infinite coordinates; a box with one overlaps nothing."""
    ok = F.lit(True)
    for c in [f"{a}{i}" for i in "01" for a in axes]:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    return boxes.where(ok & F.col("key").isNotNull())


def _cells(boxes: DataFrame, cell: float, inflate: Column, side: str, by: Sequence[str], axes: str) -> DataFrame:
    own = sound(boxes, axes).select(F.col("key").alias(f"key_{side}"), *by, *[(F.col(f"{a}0") - inflate).alias(f"{side}{a}0") for a in axes], *[(F.col(f"{a}1") + inflate).alias(f"{side}{a}1") for a in axes])
    size = F.greatest(*[F.col(f"{side}{a}1") - F.col(f"{side}{a}0") for a in axes])
    return own.withColumn(f"level_{side}", F.greatest(F.lit(0), F.ceil(F.log(float(STEP), F.greatest(size / cell, F.lit(1e-9)))).cast("int")))


def _dealt(boxes: DataFrame, side: str, cell: float, axes: str, levels: DataFrame | None, home: bool) -> DataFrame:
    """A row for each grid cell that a box touches, on its own level (home) and on the coarser ones among levels."""
    own = F.col(f"level_{side}")
    out = boxes.withColumn("level", own) if home else None
    if levels is not None:
        # A box has one level, and all levels are a few dozen numbers at most (a range of doubles has some 700).
        up = boxes.join(F.broadcast(levels), F.col("level") > own)
        up = up.select(*boxes.columns, "level")
        out = up if out is None else out.unionByName(up)
    out = out.withColumn("width", cell * F.pow(F.lit(float(STEP)), "level"))
    for a in axes:
        out = out.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"{side}{a}0") / F.col("width")), F.floor(F.col(f"{side}{a}1") / F.col("width")))))
    return out


def box_join(left: DataFrame, right: DataFrame, inflate: float | Column = 0.0, cell: float = 1.0, keys: str = "differ", by: Sequence[str] = (), axes: str = AXES, alike: bool = False) -> DataFrame:
    """(key_a, key_b), by and both boxes, of overlapping boxes, touching ones included, right grown by max(inflate, 0) on every side.

    inflate: a number, or a column of right. keys: which pairs count: those
    whose keys "differ"; in a self-join "ascend", which gives each unordered
    pair once; "any" if the sides' keys are of different kinds. by: columns of
    both sides that have to be equal as well. axes: which the boxes have.
    alike: boxes that are equal meet as one; a further shuffle of both sides,
    which pays where many are.
    """
    grow = F.greatest(F.lit(0.0), inflate) if isinstance(inflate, Column) else F.lit(max(inflate, 0.0))
    a, b = _cells(left, cell, F.lit(0.0), "a", by, axes), _cells(right, cell, grow, "b", by, axes)
    if alike:
        a, b = packed(a, "key_a"), packed(b, "key_b")
    grid = ["level", *[f"g{x}" for x in axes], *by]
    levels = [d.select(F.col(f"level_{s}").alias("level")).distinct() for d, s in ((a, "a"), (b, "b"))]
    # Each pair meets on the level of its coarser box, which is at home there; two boxes that are both away from home never meet.
    meets = [(_dealt(a, "a", cell, axes, None, True), _dealt(b, "b", cell, axes, levels[0], True).drop("width")), (_dealt(a, "a", cell, axes, levels[1], False), _dealt(b, "b", cell, axes, None, True).drop("width"))]
    asked = {"differ": F.col("key_a") != F.col("key_b"), "ascend": F.col("key_a") < F.col("key_b"), "any": F.lit(True)}[keys]
    hit = F.lit(True) if alike else asked
    for x in axes:
        hit = hit & (F.col(f"a{x}0") <= F.col(f"b{x}1")) & (F.col(f"b{x}0") <= F.col(f"a{x}1"))
        hit = hit & (F.col(f"g{x}") == F.floor(F.greatest(f"a{x}0", f"b{x}0") / F.col("width")))
    # How many cells a box touches is unknown to the planner, which would take a small table's cells for small and broadcast them.
    both = [p.join(q.hint("merge"), grid).where(hit).select("key_a", "key_b", *by, *[f"{s}{x}{i}" for s in "ab" for i in "01" for x in axes]) for p, q in meets]
    met = both[0].unionByName(both[1])
    return met.withColumn("key_a", F.explode("key_a")).withColumn("key_b", F.explode("key_b")).where(asked) if alike else met


def self_join(boxes: DataFrame, inflate: float = 0.0, cell: float = 1.0) -> DataFrame:
    """Each unordered pair of overlapping boxes once, without a shuffle of the pairs."""
    return box_join(boxes, boxes, inflate, cell, "ascend", alike=True)


def capped(pairs: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, bool]:
    """At most so many pairs (0: the default), kept on the executors' disks so that what is counted is what is read, and whether that many were reached."""
    out = pairs.limit(most or 1_000_000).persist(StorageLevel.DISK_ONLY)
    return out, out.count() >= (most or 1_000_000)


def bounds(rows: DataFrame, axes: str = AXES) -> DataFrame:
    """x0, y0, z0, x1, y1, z1 of the finite points of rows."""
    ok = [F.when(~F.isnan(a) & (F.abs(a) != float("inf")), F.col(a)) for a in axes]
    return rows.agg(*[f(c).alias(f"{a}{i}") for i, f in ((0, F.min), (1, F.max)) for a, c in zip(axes, ok, strict=True)])


def overlap_depth() -> Column:
    """Least overlap over the axes of a joined pair, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(*[F.least(f"a{x}1", f"b{x}1") - F.greatest(f"a{x}0", f"b{x}0") for x in AXES]))


def mesh_boxes(triangles: DataFrame, key: str = "key") -> DataFrame:
    """Boxes of meshes given as (key, ax, ay, az, ..., cz), one row per triangle."""
    ends = [f(F.least(*[F.col(f"{v}{x}") for v in "abc"]) if f is F.min else F.greatest(*[F.col(f"{v}{x}") for v in "abc"])).alias(f"{x}{i}") for i, f in ((0, F.min), (1, F.max)) for x in AXES]
    return triangles.groupBy(F.col(key).alias("key")).agg(*ends)
