"""Interference matrices: cells from CSV lines, reduction to rules, and back to CSV."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.numbers import csv_field, to_number

CELLS = "row_name string, col_name string, type string, tol_mm double, r int, c int"
ERRORS = "line int, msg string"
#: Classes that stand for their more special ones as well (fixed values).
SUBCLASSES = {
    "IFCWALL": ("IFCWALLSTANDARDCASE", "IFCWALLELEMENTEDCASE"),
    "IFCSLAB": ("IFCSLABSTANDARDCASE", "IFCSLABELEMENTEDCASE"),
    "IFCBEAM": ("IFCBEAMSTANDARDCASE",),
    "IFCCOLUMN": ("IFCCOLUMNSTANDARDCASE",),
    "IFCMEMBER": ("IFCMEMBERSTANDARDCASE",),
    "IFCPLATE": ("IFCPLATESTANDARDCASE",),
    "IFCDOOR": ("IFCDOORSTANDARDCASE",),
    "IFCWINDOW": ("IFCWINDOWSTANDARDCASE",),
    "IFCOPENINGELEMENT": ("IFCOPENINGSTANDARDCASE",),
}


def cell_kind(cell: Column) -> Column:
    """struct(type, tol_mm, error) of a cell's text: '' or '-' is no test, H or X hard (with a tolerance after ':'), a positive number a clearance."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    hard = F.regexp_extract(t, r"(?s)\A[HhXx]\s*(?::\s*(.*))?\z", 1)
    tol, gap = to_number(hard), to_number(t)
    row = lambda kind, mm, error: F.struct(kind.cast("string").alias("type"), mm.cast("double").alias("tol_mm"), error.cast("string").alias("error"))
    none = F.lit(None)
    return (
        F.when((t == "") | (t == "-"), row(none, none, none))
        .when(F.upper(t).isin("H", "X"), row(F.lit("hard"), none, none))
        .when(F.regexp_like(t, F.lit(r"(?s)\A[HhXx]\s*:.*\z")), F.when(tol >= 0, row(F.lit("hard"), tol, none)).otherwise(row(none, none, F.lit("hard tolerance must be a number of 0 or more"))))
        .when(gap > 0, row(F.lit("clearance"), gap, none))
        .when(gap.isNotNull(), row(none, none, F.lit("clearance must be above 0")))
        .otherwise(row(none, none, F.lit("not recognised")))
    )


@dataclass
class Matrix:
    cells: DataFrame
    errors: DataFrame
    rows: list[str]
    cols: list[str]


def parse_matrix(spark: SparkSession, text: str) -> Matrix:
    """Cells in long form and the errors found; parsing goes on after an error.

    The separator is ';' if the first line has one outside quotes, else ','. A matrix is a
    file that people write, so its lines are split here; cells are typed in Spark.
    """
    lines = [(i, x) for i, x in enumerate(text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1) if x.strip()]
    if not lines:
        return Matrix(spark.createDataFrame([], CELLS), spark.createDataFrame([(0, "the file is empty")], ERRORS), [], [])
    sep = ";" if ";" in re.sub(r'"[^"]*"', "", lines[0][1]) else ","
    split = lambda x: [c.strip() for c in next(csv.reader(io.StringIO(x), delimiter=sep), [])]
    cols, rows, raw, errors = split(lines[0][1])[1:], [], [], []
    for i, line in lines[1:]:
        name, *cells = split(line) or [""]
        if not name:
            if any(cells):
                errors.append((i, "row without a name"))
            continue
        rows.append(name)
        for j, cell in enumerate(cells):
            if not cell or cell == "-":
                continue
            if j >= len(cols) or not cols[j]:
                errors.append((i, f"cell {j + 1} has no column name"))
            else:
                raw.append((name, cols[j], cell, len(rows) - 1, j, i))
    typed = spark.createDataFrame(raw, "row_name string, col_name string, cell string, r int, c int, line int").withColumn("k", cell_kind(F.col("cell")))
    bad = typed.where("k.error is not null").select("line", F.concat_ws(": ", "cell", "k.error").alias("msg"))
    good = typed.where("k.type is not null").select("row_name", "col_name", "k.type", "k.tol_mm", "r", "c")
    return Matrix(good, spark.createDataFrame(errors, ERRORS).unionByName(bad), rows, [c for c in cols if c])


def matrix_rules(cells: DataFrame, default_hard_mm: float = 1.0) -> DataFrame:
    """One rule per unordered pair: hard beats clearance; the least hard tolerance, or the largest clearance. tol is in metres.

    The reduction is commutative, so partial sums on the map side are exact.
    """
    hard = F.col("type") == "hard"
    pair = cells.groupBy(F.least("row_name", "col_name").alias("a_name"), F.greatest("row_name", "col_name").alias("b_name"))
    out = pair.agg(F.bool_or(hard).alias("_h"), F.min(F.when(hard, F.coalesce("tol_mm", F.lit(default_hard_mm)))).alias("_hard"), F.max(F.when(~hard, F.col("tol_mm"))).alias("_gap"))
    return out.select("a_name", "b_name", F.when(F.col("_h"), "hard").otherwise("clearance").alias("type"), F.when(F.col("_h"), F.col("_hard")).otherwise(F.col("_gap")).alias("tol_mm")).withColumn("tol", F.col("tol_mm") / 1000)


def matrix_grid(cells: DataFrame, cols: list[str]) -> DataFrame:
    """Back to a grid: one row per row name, one text column per set; of several cells the last one counts."""
    number = F.regexp_replace(F.col("tol_mm").cast("string"), r"\.0\z", "")
    text = F.when(F.col("type") == "hard", F.when(F.col("tol_mm").isNull(), "H").otherwise(F.concat(F.lit("H:"), number))).otherwise(number)
    return cells.withColumn("_t", text).groupBy("row_name").pivot("col_name", cols).agg(F.max_by("_t", F.struct("r", "c")))


def matrix_lines(cells: DataFrame, cols: list[str], sep: str = ";", decimal: str | None = None) -> DataFrame:
    """line_no and line of a matrix as text: a header, and one line for each row name in order of its number r; write with CRLF ends (``quantities.write_csv``).

    decimal: a comma by default where the separator is ';'. Reading the text gives the same cells.
    """
    point = decimal or ("," if sep == ";" else ".")
    grid = matrix_grid(cells, cols)
    # Where two rows have one name, the first one's place and both rows' cells.
    places = cells.groupBy(F.col("row_name").alias("_n")).agg(F.min("r").alias("_r"))
    text = [csv_field(F.replace(F.coalesce(f"`{c}`", F.lit("")), F.lit("."), F.lit(point)), sep) for c in cols]
    body = grid.join(places, F.col("row_name").eqNullSafe(F.col("_n"))).select((F.col("_r") + 1).alias("line_no"), F.concat_ws(sep, csv_field(F.col("row_name"), sep), *text).alias("line"))
    head = cells.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.concat_ws(sep, *[csv_field(F.lit(c), sep) for c in ("", *cols)]).alias("line"))
    return head.unionByName(body)


def expand_classes(sets: DataFrame, name: str = "name") -> DataFrame:
    """set, ifc_class: the class of each name and its special ones, upper-cased; '' gives nothing."""
    known = F.create_map(*[x for k, v in SUBCLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    upper = F.upper(F.trim(F.col(name)))
    return sets.where(upper != "").select(F.col(name).alias("set"), F.explode(F.concat(F.array(upper), F.coalesce(F.element_at(known, upper), F.array().cast("array<string>")))).alias("ifc_class"))


def clash_key(a: Column, b: Column, rule: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), rule)


#: Parts into which the names of a rule are dealt, so that a rule of many names is not one task.
DEALT = 16


def clash_counts(rows: DataFrame) -> DataFrame:
    """clash (key of both names and 'r' and the rule) and n: how many ordered pairs of rows (rule, name, key) of a rule, with different keys, have it.

    Names meet, not rows: n of two names is the product of their numbers of rows, less
    the pairs with one key. Each two names meet once, and their key is no other's, so what comes
    out is not shuffled; but for names that are null or hold the separator, and a name with itself.
    """
    rows = rows.where("rule is not null and key is not null")
    every = rows.groupBy("rule", "name", "key").agg(F.count("*").alias("m"))
    names = every.groupBy("rule", "name").agg(F.sum("m").alias("m"))
    plain = F.coalesce(~F.contains(F.col("name"), F.lit("|")), F.lit(False))
    text = F.concat(F.lit("r"), F.col("rule").cast("string"))
    # What pairs of two names have too many: rows with one key.
    side = lambda d, x: d.withColumnsRenamed({"name": f"name_{x}", "m": f"m_{x}"})
    one = side(every, "a").join(side(every, "b").hint("merge"), ["rule", "key"]).where("not (name_a <=> name_b)").groupBy("rule", "name_a", "name_b").agg(F.sum(F.col("m_a") * F.col("m_b")).alias("less"))
    a = side(names.where(plain), "a").withColumn("part", F.pmod(F.xxhash64("name_a"), F.lit(DEALT)))
    b = side(names.where(plain), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>")))
    met = a.join(b.hint("merge"), ["rule", "part"]).where("name_a < name_b")
    # Where each key has one name, which is the rule, the pairs of names need no shuffle.
    shared = not one.isEmpty()
    met = met.join(one.where("name_a < name_b"), ["rule", "name_a", "name_b"], "left") if shared else met.withColumn("less", F.lit(None).cast("long"))
    out = met.select(clash_key(F.col("name_a"), F.col("name_b"), text).alias("clash"), (2 * (F.col("m_a") * F.col("m_b") - F.coalesce("less", F.lit(0)))).alias("n")).where("n > 0")
    same = every.groupBy("rule", "name").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("n")).select(clash_key(F.col("name"), F.col("name"), text).alias("clash"), "n")
    odd = side(names.where(~plain), "a").join(side(names, "b").hint("merge"), "rule").where("not (name_a <=> name_b)")
    less = (F.col("rule") == F.col("l_rule")) & F.col("name_a").eqNullSafe(F.col("l_a")) & F.col("name_b").eqNullSafe(F.col("l_b"))
    odd = odd if not shared else odd.join(one.withColumnsRenamed({"rule": "l_rule", "name_a": "l_a", "name_b": "l_b"}), less, "left")
    odd = odd if shared else odd.withColumn("less", F.lit(None).cast("long"))
    # Between two such names both orders come; with another one the order that is left out is added.
    other = F.coalesce(~F.contains(F.col("name_b"), F.lit("|")), F.lit(False))
    odd = odd.select(clash_key(F.col("name_a"), F.col("name_b"), text).alias("clash"), (F.when(other, 2).otherwise(1) * (F.col("m_a") * F.col("m_b") - F.coalesce("less", F.lit(0)))).alias("n"))
    return out.unionByName(same.unionByName(odd).where("n > 0").groupBy("clash").agg(F.sum("n").alias("n")))
