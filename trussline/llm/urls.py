"""URL filter: allow and block rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark's own tree learner: no Python on
the executors. The labelled URLs are those that a rule fits; the trees learn
from them and judge the others. Suffix statistics (how many labelled URLs there
are under a host's last label, its last two, and under what follows the host, up
to the path's second slash, and what share of them is blocked) are taken over
all labelled URLs; a labelled URL is described by those
of the other FOLDS only, so that its own label is no part of what the trees see.
Suffixes with fewer than SUFFIX_ROWS labelled URLs have the overall share.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits
no rule and is judged by the trees from its (empty) features; without any
labelled URL the verdict is allow, and with labels of one kind only it is that
kind; repeated rows are judged alike; empty input gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: About so many labelled URLs at most train the trees (a seeded hash picks them); trees, their depth, and the weight of the prior in a suffix's block rate.
TRAIN_ROWS, TREES, DEPTH, PRIOR = 50_000, 10, 4, 20.0
#: Folds of the suffix statistics, and labelled URLs that a suffix needs to have its own.
FOLDS, SUFFIX_ROWS = 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise((n - F.length(F.replace(text, c, F.lit("")))).cast("double")))
    return F.when(n > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda text, what: F.regexp_count(text, F.lit(what)).cast("double")
    return {
        "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"), "labels": count(host, "[^.]+"), "digits": count(u, "[0-9]") / n, "entropy": _entropy(u), "host_entropy": _entropy(host),
        "params": count(u, r"[?&][^?&#=]+"), "fragment": count(u, "#"), "hyphens": count(host, "-"), "secure": F.startswith(u, F.lit("https:")).cast("double"), "page": count(path, r"\.[A-Za-z]{2,5}\z"),
    }


def _with_suffix(rows: DataFrame, s: str, rate: float) -> DataFrame:
    """rows with f_<s>_n and f_<s>_rate of their suffix in column s; labelled rows by the other folds."""
    fold = F.pmod("x", F.lit(FOLDS))
    own = [f for i in range(FOLDS) for f in (F.count_if(fold == i).alias(f"n{i}"), F.sum(F.when(fold == i, F.col("label"))).alias(f"b{i}"))]
    stat = rows.where("label is not null").groupBy(F.col(s).alias("_s")).agg(F.count("*").alias("n"), F.sum("label").alias("b"), *own).where(F.col("n") >= SUFFIX_ROWS)
    out = rows.join(stat, F.col(s) == F.col("_s"), "left")
    labelled = F.col("label").isNotNull()
    part = lambda k: F.coalesce(F.element_at(F.array(*[F.col(f"{k}{i}").cast("double") for i in range(FOLDS)]), (fold + 1).cast("int")), F.lit(0.0))
    n, b = (F.coalesce(F.col(k) - F.when(labelled, part(k)).otherwise(0.0), F.lit(0.0)) for k in "nb")
    out = out.withColumns({f"f_{s}_n": F.log1p(n), f"f_{s}_rate": (b + PRIOR * rate) / (n + PRIOR)})
    return out.drop("_s", "n", "b", *[f"{k}{i}" for i in range(FOLDS) for k in "nb"])


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, train_rows: int = TRAIN_ROWS, keep: str = "page_id", learn: Column | None = None) -> DataFrame:
    """keep column, host, path, rule, verdict, and predicted, the trees' verdict of every row; learn: which labelled URLs (by column url) may be learned from."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    allowed = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    base = pages.select(F.col(keep).alias("k"), F.col("url").alias("u"), allowed.alias("allowed")).withColumn("h", host(F.col("u"))).withColumn("p", path(F.col("u"))).withColumn("m", matched(F.col("h"), F.col("p"), rules))
    names = lexical(F.col("u"), F.col("h"), F.col("p"))
    label = F.when(F.col("allowed"), (F.col("m.verdict") == "block").cast("double"))
    rows = base.select("k", "h", "p", "m", F.xxhash64(F.col("u")).alias("x"), label.alias("label"), F.substring_index("h", ".", -1).alias("s1"), F.substring_index("h", ".", -2).alias("s2"), F.substring_index("p", "/", 2).alias("s3"), *[c.alias(f"f_{n}") for n, c in names.items()])
    found = {r["label"]: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}

    def judged(rows: DataFrame, verdict: Column) -> DataFrame:
        return rows.select(F.col("k").alias(keep), F.col("h").alias("host"), F.col("p").alias("path"), F.col("m.rule").alias("rule"), F.coalesce("m.verdict", verdict).alias("verdict"), verdict.alias("predicted"))

    if len(found) < 2:
        return judged(base, F.lit("block" if set(found) == {1.0} else "allow"))
    n = sum(found.values())
    for s in ("s1", "s2", "s3"):
        rows = _with_suffix(rows, s, found[1.0] / n)
    inputs = [c for c in rows.columns if c.startswith("f_")]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    grain = 1 << 20
    picked = rows.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("x", F.lit(7)), F.lit(grain)) < int(grain * min(1.0, train_rows / n))))
    train = written(picked.select("label", *inputs).coalesce(4), "urls")
    kinds = [r[0] for r in train.select("label").distinct().collect()]
    if len(kinds) < 2:
        return judged(rows, F.lit("block" if kinds == [1.0] else "allow"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(assemble.transform(train))
    return judged(model.transform(assemble.transform(rows)), F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
