"""Quantity take-off: sums and value counts per group, totals, used columns, natural order, CSV lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.numbers import csv_field, csv_number, finite, natural_key
from trussline.functions.scratch import checkpointed

#: Quantity columns of a row unless others are asked for (fixed values).
STANDARD = ("count", "length", "area", "volume", "weight")
#: Title of the group column unless another is given (fixed value).
HEADER = "Gruppo"


def quantity(name: str, source: str = "qty") -> Column:
    """One quantity of a row's map; null if it is absent or not finite."""
    return finite(F.element_at(F.col(source), F.lit(name)))


def aggregate(rows: DataFrame, key: str, columns: dict[str, Column], total: bool = True) -> DataFrame:
    """key, n, sum_<c> and have_<c> for each column, is_total; one more row for everything if total.

    Null and empty keys are one group. Values that are not finite count in n
    only. One shuffle with partial sums, whatever the size of a group.
    """
    prepared = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), *[finite(c.cast("double")).alias(n) for n, c in columns.items()])
    measures = [F.count("*").alias("n"), *[f for n in columns for f in (F.coalesce(F.sum(n), F.lit(0.0)).alias(f"sum_{n}"), F.count(n).alias(f"have_{n}"))]]
    if not total:
        return prepared.groupBy("key").agg(*measures).withColumn("is_total", F.lit(False))
    out = prepared.rollup("key").agg(F.grouping("key").alias("_g"), *measures)
    return out.withColumn("is_total", F.col("_g") == 1).drop("_g")


def used_columns(aggregated: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns, in the order asked for, that have at least one value."""
    row = aggregated.agg(*[F.max(F.col(f"have_{c}") > 0).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def natural_rank(groups: DataFrame, key: str = "key", rank: str = "rank") -> DataFrame:
    """Rank of each group in natural order, the empty key last.

    Groups are dealt by ranges of that order, ranked inside a range, and moved up
    by the counts of the ranges before; the ranges are checkpointed, as a second
    sampling of their bounds might differ.
    """
    order = [F.col(key) == "", natural_key(F.col(key)), F.col(key)]
    ranged = checkpointed(groups.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", inside).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(rank, (F.col("_at") + F.col("_before")).cast("int")).drop("_range", "_r", "_at", "_before")


def csv_lines(groups: DataFrame, columns: Sequence[str], titles: dict[str, str] | None = None, sep: str = ";", decimal: str = ",", empty: str = "(no value)", total: str = "TOTAL") -> DataFrame:
    """line_no and line: a header, a line for each group in natural order, and the total row; write with CRLF ends."""
    body = natural_rank(groups.where("not is_total"), rank="line_no").withColumn("label", F.when(F.col("key") == "", empty).otherwise(F.col("key")))
    last = groups.where("is_total").withColumn("line_no", F.lit(2147483647)).withColumn("label", F.lit(total))
    rows = body.unionByName(last)
    line = F.concat_ws(sep, csv_field(F.col("label"), sep), F.col("n").cast("string"), *[F.when(F.col(f"have_{c}") > 0, csv_number(F.col(f"sum_{c}"), decimal)).otherwise("") for c in columns])
    names = {"key": HEADER, "n": "N"} | (titles or {})
    head = groups.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.concat_ws(sep, *[csv_field(F.lit(names.get(c, c)), sep) for c in ("key", "n", *columns)]).alias("line"))
    return head.unionByName(rows.select("line_no", line.alias("line")))


def write_csv(lines: DataFrame, path: str) -> None:
    """The lines in order as one CRLF text file."""
    lines.orderBy("line_no").select("line").coalesce(1).write.text(path, lineSep="\r\n")
