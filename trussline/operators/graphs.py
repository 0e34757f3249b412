"""Rows that refer to each other: positions along chains, digests of what a row stands for, and parts that share rows.

Each is a few joins a step, of what the step before has changed only; steps are
checkpointed, so a lost executor costs one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.lookup import looked_up
from trussline.functions.scratch import checkpointed

#: A placement: the three axes as columns of a matrix, row by row, and the origin.
PLACE = ("xx", "yx", "zx", "ox", "xy", "yy", "zy", "oy", "xz", "yz", "zz", "oz")
#: Parts that one bitmap of a row holds.
PARTS = 63


def composed(outer: list[Column], inner: list[Column]) -> list[Column]:
    """The placement inner, which is relative to outer, in outer's own frame; both as in PLACE."""
    out = []
    for r in range(3):
        row = outer[4 * r : 4 * r + 4]
        for c in range(4):
            value = row[0] * inner[c] + row[1] * inner[4 + c] + row[2] * inner[8 + c]
            out.append(value + row[3] if c == 3 else value)
    return out


def absolute(placements: DataFrame) -> DataFrame:
    """id and the placement (PLACE) of each row in the frame of its outermost ancestor's parent, of (id, parent, PLACE relative to parent).

    Pointer doubling: every round, each row takes over the placement of the row
    that its own is relative to so far, so a chain of depth d takes log2(d) rounds. A
    parent with any number of children is no task's hot key. Rows whose chain has no end (a ring, or
    a parent that is not there) are left out.
    """
    own = [F.col(c).cast("double") for c in PLACE]
    now, ended = checkpointed(placements.select("id", F.col("parent").alias("up"), *own)), -1
    while True:
        whole, n = now.where("up is null"), now.where("up is null").count()
        left = now.where("up is not null")
        # Chains of every length below the longest one end in some round: if none does, what is left are rings.
        if n == ended or left.isEmpty():
            return whole.select("id", *PLACE)
        ended = n
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(True).alias("there"), *[F.col(c).alias(f"{c}_up") for c in PLACE])
        met = looked_up(left, above, ["up"]).where("there")
        turned = composed([F.col(f"{c}_up") for c in PLACE], [F.col(c) for c in PLACE])
        now = checkpointed(whole.unionByName(met.select("id", F.col("next").alias("up"), *[c.alias(k) for k, c in zip(PLACE, turned, strict=True)])).repartition("id"))


def number_text(value: Column) -> Column:
    """A number to six significant digits, as text, so that what differs by rounding alone is equal."""
    v = value.cast("double")
    return F.when(v == 0, "0").otherwise(F.format_string("%.5e", v))


def fingerprints(rows: DataFrame) -> DataFrame:
    """id and fingerprint of (id, own, refs): an md5 of own text and of the fingerprints of what the row refers to, in order.

    Ids are left out, so renumbered rows have equal fingerprints; own should hold
    numbers as number_text gives them. From the rows without references upwards, level by level; a
    reference to a row that is not there counts as such. Rows in a ring have none (null).
    """
    base = checkpointed(rows.select("id", F.coalesce("own", F.lit("")).alias("own"), F.coalesce("refs", F.array().cast(dict(rows.dtypes)["refs"])).alias("refs")))
    edges = base.where("size(refs) > 0").select("id", F.posexplode("refs").alias("at", "target"))
    known = base.select(F.col("id").alias("target"), F.lit(True).alias("there"))
    waiting = checkpointed(looked_up(checkpointed(edges), known, ["target"]).select("id", "at", "target", F.when(F.col("there").isNull(), F.md5(F.lit("missing"))).alias("f")))
    fresh = checkpointed(base.where("size(refs) = 0").select("id", F.md5("own").alias("fingerprint")))
    done = [fresh]
    while True:
        open_ = waiting.where("f is null")
        whole = checkpointed(looked_up(open_, fresh.select(F.col("id").alias("target"), "fingerprint"), ["target"]).select("id", "at", "target", F.col("fingerprint").alias("f")).unionByName(waiting.where("f is not null")).repartition("id"))
        ready = whole.groupBy("id").agg(F.count_if(F.col("f").isNull()).alias("open"), F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs")).where("open = 0")
        fresh = checkpointed(ready.join(base.select("id", "own"), "id").select("id", F.md5(F.concat_ws("|", "own", F.transform("fs", lambda x: x["f"]))).alias("fingerprint")))
        if fresh.isEmpty():
            rest = whole.select("id").distinct().select("id", F.lit(None).cast("string").alias("fingerprint"))
            return reduce(DataFrame.unionByName, [*done, rest])
        done.append(fresh)
        waiting = checkpointed(whole.join(fresh.select("id"), "id", "leftanti"))


def parts(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, part) for everything that the roots (id, part: a number from 0) of each part reach over links (source, target), roots included.

    All parts at once: a row carries bitmaps of the parts that have reached it, and only bits that are new to a
    row go on along its links; a row that several parts need is in each of them.
    """
    word, bit = F.floor(F.col("part") / PARTS).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(part % {PARTS} as int))").alias("bits")
    steps = [checkpointed(roots.where("id is not null").select("id", word, bit).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))]
    while not steps[-1].isEmpty():
        ahead = steps[-1].join(links.select(F.col("source").alias("id"), "target"), "id").groupBy(F.col("target").alias("id"), "word").agg(F.bit_or("bits").alias("bits")).where("id is not null")
        known = reduce(DataFrame.unionByName, steps).groupBy("id", "word").agg(F.bit_or("bits").alias("old"))
        fresh = ahead.join(known, ["id", "word"], "left").select("id", "word", F.expr("bits & ~coalesce(old, 0L)").alias("bits")).where("bits <> 0")
        steps.append(checkpointed(fresh))
        if len(steps) > 16:
            steps = [checkpointed(reduce(DataFrame.unionByName, steps[:-1]).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))), steps[-1]]
    every = reduce(DataFrame.unionByName, steps).groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    return every.select("id", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("k")).where("shiftright(bits, k) & 1 = 1").select("id", (F.col("word") * PARTS + F.col("k")).cast("int").alias("part"))
