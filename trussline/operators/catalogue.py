"""Lookup of codes in a catalogue of patterns, most special rule first.

A catalogue has rows (codice, categoria, tipologia, tol_mm, note). codice is an
exact code, a prefix ``X*``, a segment ``*XXX*`` (a part of the code between dots
and hyphens), or a regular expression ``/.../``; rows without one set category
and tolerance of a typology. Exact, prefix and segment rules are equi-joins on
pieces of the code, so no pair of every code and every rule is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = "codice string, categoria string, tipologia string, tol_mm double, note string"
#: Tolerance in mm of a category without one of its own (fixed values).
DEFAULT_TOL = {"primaria": 70.0, "secondaria": 100.0}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon file with # comments and a header."""
    return spark.read.csv(path, sep=";", comment="#", header=True, schema=COLUMNS)


def lookup(codes: DataFrame, catalogue: DataFrame, code: str = "code", default_mm: float = 100.0) -> DataFrame:
    """codes with tipologia, categoria, tol_mm and rule of the first rule that fits: exact, then the longest prefix, segment, expression."""
    rules = catalogue.where("codice is not null and codice <> ''")
    c = F.col("codice")
    kind = F.when(F.regexp_like(c, F.lit(r"\A\*.+\*\z")), "segment").when(F.regexp_like(c, F.lit(r"\A[^*]+\*\z")), "prefix").when(F.regexp_like(c, F.lit(r"\A/.+/\z")), "regex").otherwise("exact")
    rules = rules.select(kind.alias("kind"), F.regexp_replace(c, r"\A[*/]|[*/]\z", "").alias("piece"), c.alias("rule"), "tipologia", F.col("categoria").alias("own_cat"), F.col("tol_mm").alias("own_tol"))
    lengths = [r[0] for r in rules.where("kind = 'prefix'").select(F.length("piece")).distinct().collect()]
    names = codes.select(F.col(code).alias("_code")).where("_code is not null").distinct()
    exact = F.array(F.struct(F.lit("exact").alias("kind"), F.col("_code").alias("piece")))
    prefixes = F.array(*[F.struct(F.lit("prefix").alias("kind"), F.substring("_code", 1, n).alias("piece")) for n in sorted(lengths)]) if lengths else F.slice(exact, 1, 0)
    segments = F.transform(F.array_distinct(F.split("_code", r"[.\-]")), lambda x: F.struct(F.lit("segment").alias("kind"), x.alias("piece")))
    hits = names.select("_code", F.explode(F.concat(exact, prefixes, segments)).alias("p")).select("_code", "p.*").join(rules, ["kind", "piece"])
    # All expressions in one pass over the names: a catalogue has a few dozen, which people write.
    patterns = rules.where("kind = 'regex'").collect()
    if patterns:
        fits = F.filter(F.array(*[F.when(F.regexp_like("_code", F.lit(r["piece"])), F.struct(*[F.lit(r[k]).cast(t).alias(k) for k, t in rules.dtypes])) for r in patterns]), lambda x: x.isNotNull())
        hits = hits.unionByName(names.select("_code", F.explode(fits).alias("f")).select("_code", "f.*"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("exact", 0), ("prefix", 1), ("segment", 2), ("regex", 3)) for x in kv]), F.col("kind"))
    best = hits.groupBy("_code").agg(F.min_by(F.struct("rule", "tipologia", "own_cat", "own_tol"), F.struct(rank, -F.length("piece"), "piece")).alias("m")).select("_code", "m.*")
    kinds = catalogue.where("codice is null or codice = ''").groupBy(F.col("tipologia").alias("_t")).agg(F.first("categoria", True).alias("t_cat"), F.first("tol_mm", True).alias("t_tol"))
    found = best.join(kinds, F.col("tipologia") == F.col("_t"), "left")
    cat = F.coalesce("own_cat", "t_cat")
    default = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_TOL.items() for x in kv]), cat)
    found = found.select("_code", "rule", "tipologia", cat.alias("categoria"), F.coalesce("own_tol", "t_tol", default, F.lit(default_mm)).alias("tol_mm"))
    return codes.join(found, F.col(code) == F.col("_code"), "left").drop("_code")


def plain_number_field(df: DataFrame, c: str, name: str):
    """Column name as field c of df is compared: numbers to six significant digits."""
    col = F.col(name)
    if dict(df.dtypes)[c] in ("double", "float"):
        scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(col))))
        return F.when(col == 0, 0.0).otherwise(F.round(col * scale) / scale)
    return col


def revision_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, modified, same) and the changed fields of two revisions; numbers to six significant digits."""
    both = old.withColumn("_in", F.lit(True)).alias("o").join(new.withColumn("_in", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "fullouter")
    changed = F.filter(F.array(*[F.when(~plain_number_field(old, c, f"o.{c}").eqNullSafe(plain_number_field(new, c, f"n.{c}")), c) for c in fields]), lambda x: x.isNotNull())
    change = F.when(F.col("o._in").isNull(), "added").when(F.col("n._in").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("same")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), F.when(change == "modified", F.array_join(changed, ",")).otherwise("").alias("fields"))
