"""Lookups whose keys may be hot on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of found (one row a key at most, null keys aside) where the key is there, else null; both are written tables.

    Keys that hold a thousandth of rows or more, so a thousand keys at most, are
    broadcast with what found says of them; only the others meet by a shuffle, so no task gets a hot key.
    """
    total = rows.count()
    often = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") * 1000 >= total).select(*on)
    more = [c for c in found.columns if c not in on]
    hot = found.join(F.broadcast(often), on, "leftsemi").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *more, F.lit(True).alias("_there"))
    same, null = F.lit(True), F.lit(False)
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"_k{i}"))
        null = null | F.col(c).isNull()
    met = rows.join(F.broadcast(hot), same, "left")
    names = [*rows.columns, *more]
    # Rows with a null key find nothing and need not meet.
    return met.where(F.col("_there") | null).select(*names).unionByName(met.where(F.col("_there").isNull() & ~null).select(*rows.columns).join(found, on, "left").select(*names))
