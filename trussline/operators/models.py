"""Operations on whole models as tables: extraction, patching, editing by rule, checks, merging and closures.

An element is a row with an id; properties are rows (owner, pset, name, value),
where an owner is an element or a type. Everything is joins and aggregates with
partial sums; rules are compiled to one expression and evaluated in one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.scratch import checkpointed
from trussline.operators.assignment import CROWD, by_number, mutual_best, neighbours

Wanted = Sequence[tuple[str, str, str]]
#: Tables of found rows that a closure keeps apart.
MERGED = 16


def _pivoted(props: DataFrame, wanted: Wanted, owner: str, suffix: str) -> DataFrame:
    """One row per owner with the wanted (column, pset, name); of several values the least counts. One shuffle with partial maxima."""
    pick = [F.min(F.when((F.col("pset") == s) & (F.col("name") == n) & (F.col("value") != ""), F.col("value"))).alias(c + suffix) for c, s, n in wanted]
    return props.where(F.col("pset").isin(sorted({s for _, s, _ in wanted})) & F.col("name").isin(sorted({n for _, _, n in wanted}))).groupBy(F.col("owner").alias(owner)).agg(*pick)


def extract(elements: DataFrame, props: DataFrame, wanted: Wanted, type_props: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """elements (element, type_key, ...) with a column for each wanted property; what an element lacks comes from its type, if type_props are given; complete leaves out rows with a gap."""
    out = elements.join(_pivoted(props, wanted, "_e", "_own"), F.col("element") == F.col("_e"), "left")
    if type_props is not None:
        out = out.join(_pivoted(type_props, wanted, "_t", "_type"), F.col("type_key") == F.col("_t"), "left")
    values = [F.coalesce(f"{c}_own", *([f"{c}_type"] if type_props is not None else [])).alias(c) for c, _, _ in wanted]
    out = out.select(*[F.col(c) for c in elements.columns], *values)
    return out.dropna(subset=[c for c, _, _ in wanted]) if complete else out


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, rows): on how many rows a column has a value."""
    one = rows.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("filled")) for i, c in enumerate(columns)])).alias("c")).select("c.column", "c.filled", "rows")


def grouped(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """One row per type or storey: elements, and of each column the one value they share, and whether they differ."""
    each = [f for c in columns for f in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    out = rows.groupBy(by).agg(F.count("*").alias("elements"), *each)
    return out.select(by, "elements", *[F.when(F.col(f"{c}_lo") == F.col(f"{c}_hi"), F.col(f"{c}_lo")).alias(c) for c in columns], *[(F.col(f"{c}_lo") != F.col(f"{c}_hi")).alias(f"{c}_differs") for c in columns])


def class_patch(elements: DataFrame, mapping: DataFrame, reference: str) -> DataFrame:
    """elements with ifc_class and predefined_type rewritten where mapping (code, new_class, new_type) has their reference property, and whether they were; of several rows of a code the least counts."""
    one = mapping.groupBy("code").agg(F.min(F.struct("new_class", "new_type")).alias("to"))
    out = elements.join(one, F.col(reference) == F.col("code"), "left")
    kept = [c for c in elements.columns if c not in ("ifc_class", "predefined_type")]
    return out.select(*kept, F.coalesce(F.upper("to.new_class"), F.col("ifc_class")).alias("ifc_class"), F.coalesce("to.new_type", F.when(F.col("to").isNull(), F.col("predefined_type"))).alias("predefined_type"), F.col("to").isNotNull().alias("patched"))


def chainage_text(metres: Column) -> Column:
    """Metres as K+MMM,CC (1234.56 is 1+234,56), half up."""
    cents = F.floor(F.abs(metres) * 100 + 0.5).cast("long")
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    text = F.concat(F.when((metres < 0) & (cents > 0), "-").otherwise(""), F.floor(cents / 100000).cast("string"), F.lit("+"), pad(F.floor(cents / 100) % 1000, 3), F.lit(","), pad(cents % 100, 2))
    return F.when(~F.isnan(metres) & (F.abs(metres) != float("inf")), text)


def chainage_metres(text: Column) -> Column:
    """K+MMM,CC (or with a point, or without a fraction) as metres; null for anything else."""
    pattern = r"\A\s*(-?)([0-9]+)\+([0-9]{3})(?:[.,]([0-9]+))?\s*\z"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = F.concat(part(2), part(3), F.lit("."), F.when(part(4) == "", "0").otherwise(part(4))).try_cast("double")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.when(part(1) == "-", -number).otherwise(number))


@dataclass
class Edit:
    """When a condition holds, a property gets a value; where it has another one, keep it or overwrite it."""

    condition: Column
    name: str
    value: Column
    overwrite: bool = False


def edit(rows: DataFrame, edits: Sequence[Edit]) -> tuple[DataFrame, DataFrame]:
    """(rows with the edits made, change log): of the edits of a property the first whose condition holds decides.

    The log has the other columns, property, rule (its place), old, new, and
    action: set, overwritten, or kept (a conflict left as it was).
    """
    out, logs = rows, []
    for name in dict.fromkeys(e.name for e in edits):
        old = F.col(name)
        empty = F.coalesce(old == "", F.lit(True))
        step = F.lit(None)
        for i, e in reversed([(i, e) for i, e in enumerate(edits) if e.name == name]):
            action = F.when(empty, "set").when(old == e.value, F.lit(None)).otherwise("overwritten" if e.overwrite else "kept")
            step = F.when(F.coalesce(e.condition, F.lit(False)), F.struct(F.lit(name).alias("property"), F.lit(i).alias("rule"), old.alias("old"), F.when(action == "kept", old).otherwise(e.value).alias("new"), action.alias("action"))).otherwise(step)
        out = out.withColumn(f"_log_{name}", step)
        logs.append(name)
    changes = F.filter(F.array(*[F.col(f"_log_{n}") for n in logs]), lambda x: x["action"].isNotNull())
    log = out.withColumn("_c", F.explode(changes)).select(*[c for c in rows.columns if c not in logs], "_c.property", "_c.rule", "_c.old", "_c.new", "_c.action")
    done = out.select(*[(F.coalesce(f"_log_{c}.new", c) if c in logs else F.col(c)).alias(c) for c in rows.columns])
    return done, log


@dataclass
class Check:
    """What is wrong with an element, its cause as text (problems are counted by cause), and how grave it is: blocking, fix or note."""

    name: str
    wrong: Column
    severity: str = "fix"
    cause: Column | None = None


def health_check(elements: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """check, severity, problems (distinct causes) and elements of every check, from one scan; sums are partial by (check, cause)."""
    found = F.filter(F.array(*[F.when(F.coalesce(c.wrong, F.lit(False)), F.struct(F.lit(i).alias("i"), (c.cause if c.cause is not None else F.lit("")).cast("string").alias("cause"))) for i, c in enumerate(checks)]), lambda x: x.isNotNull())
    causes = elements.select(F.explode(found).alias("f")).groupBy("f.i", "f.cause").agg(F.count("*").alias("n"))
    sums = causes.groupBy("i").agg(F.count("*").alias("problems"), F.sum("n").alias("elements"))
    names = elements.sparkSession.createDataFrame([(i, c.name, c.severity) for i, c in enumerate(checks)], "k int, check string, severity string")
    return names.join(sums, F.col("k") == F.col("i"), "left").select("check", "severity", F.coalesce("problems", F.lit(0)).alias("problems"), F.coalesce("elements", F.lit(0)).alias("elements"))


def gate(result: DataFrame) -> DataFrame:
    """deliverable: whether no blocking check found anything, and how many did."""
    bad = F.count_if((F.col("severity") == "blocking") & (F.col("elements") > 0))
    return result.agg((bad == 0).alias("deliverable"), bad.alias("blocking"))


def with_uses(elements: DataFrame, key: str, name: str) -> DataFrame:
    """elements and how many of them share a key."""
    uses = elements.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(name))
    return elements.join(uses, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def merge(models: Sequence[DataFrame]) -> DataFrame:
    """model, id, guid, refs of all models (id, guid, refs array<bigint>) as one: ids and references move above those of the models before.

    A guid that an earlier row (by model, then id) has is made anew from model,
    id and guid, and so is a null one, from model and id.
    """
    tops = [F.broadcast(m.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))) for m in models[:-1]]
    parts = []
    for i, m in enumerate(models):
        moved = m.withColumn("_by", F.lit(0).cast("long"))
        for t in tops[:i]:
            moved = moved.crossJoin(t).withColumn("_by", F.col("_by") + F.col("top")).drop("top")
        parts.append(moved.select(F.lit(i).alias("model"), (F.col("id") + F.col("_by")).alias("id"), "guid", F.transform("refs", lambda r: r + F.col("_by")).alias("refs")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy(F.col("guid").alias("_g")).agg(F.min("id").alias("_first"))
    again = F.md5(F.concat_ws("|", F.col("model").cast("string"), F.col("id").cast("string"), "guid"))
    return every.join(first, F.col("guid") == F.col("_g"), "left").select("model", "id", F.when(F.col("id") == F.col("_first"), F.col("guid")).otherwise(F.coalesce(again, "guid")).alias("guid"), "refs")


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """id of everything that roots (id) reach over links (source, target), roots included.

    Each step follows the links of what the step before found, and only that is
    written, so a lost executor costs one step and nothing is written twice.
    """
    steps = [checkpointed(roots.select("id").where("id is not null").distinct())]
    while not steps[-1].isEmpty():
        ahead = steps[-1].join(links, F.col("id") == F.col("source")).select(F.col("target").alias("id")).where("id is not null").distinct()
        for s in steps:
            ahead = ahead.join(s, "id", "leftanti")
        steps.append(checkpointed(ahead))
        if len(steps) > MERGED:  # so that a step looks at a few tables, however many came before
            steps = [checkpointed(reduce(DataFrame.unionByName, steps[:-1])), steps[-1]]
    return reduce(DataFrame.unionByName, steps)


def georeference(sites: DataFrame, tolerance_deg: float = 0.01, tolerance_m: float = 1.0) -> DataFrame:
    """sites (site, xa, xo, rotation, true_north, east, north, ref_east, ref_north) with what is wrong, comma-separated.

    degenerate: an axis of length 0; rotation: it and true north disagree (turns
    of 360 degrees aside); origin: the two origins disagree; missing: no slot is set.
    """
    turn = F.pmod(F.col("rotation") - F.col("true_north") + 180, F.lit(360.0)) - 180
    apart = F.greatest(F.abs(F.col("east") - F.col("ref_east")), F.abs(F.col("north") - F.col("ref_north")))
    none = F.coalesce("xa", "xo", "rotation", "true_north", "east", "north", "ref_east", "ref_north").isNull()
    said = [F.when((F.col("xa") == 0) & (F.col("xo") == 0), "degenerate"), F.when(F.abs(turn) > tolerance_deg, "rotation"), F.when(apart > tolerance_m, "origin"), F.when(none, "missing")]
    return sites.select("site", F.concat_ws(",", *said).alias("wrong"))


def sampled(rows: DataFrame, by: str, key: str, most: int = 32, seed: int = 7) -> DataFrame:
    """At most so many rows of each group, alike at every run: those of least hash. Groups are cut before they are shuffled."""
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def matched_diff(old: DataFrame, new: DataFrame, fields: Sequence[str], tolerance: float = 0.001, cell: float = 1.0, sure: float = 0.9) -> DataFrame:
    """key, new_key, change, fields, confidence of two revisions (key, class, geometry, name, x, y, z, ...).

    Rows of one key are compared by fields (numbers to six significant digits)
    and position (moved if farther than tolerance, in metres). Orphans, removed
    and added rows, are matched again one to one (``rematched``): recreated from
    sure on, proposed below.
    """
    from trussline.operators.catalogue import plain_number_field

    o, n = (d.select(*[F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys(("key", "class", "geometry", "name", "x", "y", "z", *fields))]) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, F.col("o_key") == F.col("n_key"))
    changed = F.filter(F.array(*[F.when(~plain_number_field(old, c, f"o_{c}").eqNullSafe(plain_number_field(new, c, f"n_{c}")), c) for c in fields], F.when(F.coalesce(_apart() > tolerance, F.lit(False)), "position")), lambda x: x.isNotNull())
    kept = both.select(F.col("o_key").alias("key"), F.col("n_key").alias("new_key"), F.when(F.size(changed) > 0, "modified").otherwise("same").alias("change"), F.array_join(changed, ",").alias("fields"), F.lit(1.0).alias("confidence"))
    gone, fresh = checkpointed(o.join(n, F.col("o_key") == F.col("n_key"), "leftanti")), checkpointed(n.join(o, F.col("o_key") == F.col("n_key"), "leftanti"))
    best = checkpointed(rematched(gone, fresh, tolerance, cell)).withColumnsRenamed({"o_key": "m_old", "n_key": "m_new"})
    again = best.select(F.col("m_old").alias("key"), F.col("m_new").alias("new_key"), F.when(F.col("confidence") >= sure, "recreated").otherwise("proposed").alias("change"), F.lit("").alias("fields"), "confidence")
    none = F.lit(None)
    removed = gone.join(best, F.col("o_key") == F.col("m_old"), "leftanti").select(F.col("o_key").alias("key"), none.cast(dict(new.dtypes)["key"]).alias("new_key"), F.lit("removed").alias("change"), F.lit("").alias("fields"), F.lit(1.0).alias("confidence"))
    added = fresh.join(best, F.col("n_key") == F.col("m_new"), "leftanti").select(none.cast(dict(old.dtypes)["key"]).alias("key"), F.col("n_key").alias("new_key"), F.lit("added").alias("change"), F.lit("").alias("fields"), F.lit(1.0).alias("confidence"))
    return kept.unionByName(again).unionByName(removed).unionByName(added)


def _apart() -> Column:
    return F.sqrt(sum((F.col(f"o_{a}") - F.col(f"n_{a}")) * (F.col(f"o_{a}") - F.col(f"n_{a}")) for a in "xyz"))


def rematched(gone: DataFrame, fresh: DataFrame, tolerance: float = 0.001, cell: float = 1.0, crowd: int = CROWD) -> DataFrame:
    """(o_key, n_key, confidence): old and new rows (o_ and n_ key, class, geometry, name, x, y, z) that are the same thing under a new key, one to one.

    Class and geometry always agree. In this order, each on what is left:
    1. twins: name and position (to the tolerance) agree too; n of them meet n in order of position and key;
    2. where a cell of a grid is crowded on both sides, rows of one name in the same or neighbouring cells of a grid 16 times as fine;
    3. rows in the same or neighbouring cells, and rows that are the only ones of their class, geometry and name on both sides;
    4. rows of one name in a cell, in order of position and key.
    Steps 2 and 3 take mutual best pairs until none is left. Confidence is 0.5
    for class and geometry, 0.25 for the name, and up to 0.25 by distance within a cell.
    """
    like = ["class", "geometry"]
    score = F.round(0.5 + F.when(F.col("o_name") == F.col("n_name"), 0.25).otherwise(0.0) + 0.25 * F.greatest(F.lit(0.0), 1 - F.coalesce(_apart(), F.lit(float("inf"))) / cell), 6).alias("confidence")
    places = lambda d, s, width, tag: d.withColumns({f"{s}_{tag}{a}": F.floor(F.col(f"{s}_{a}") / width + (0.5 if tag == "t" else 0.0)) for a in "xyz"})
    grain = max(tolerance, 1e-9)

    def scored(keys: DataFrame) -> DataFrame:
        return keys.join(gone, "o_key").join(fresh, "n_key").select("o_key", "n_key", score)

    def without(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        return gone.join(done, "o_key", "leftanti"), fresh.join(done, "n_key", "leftanti")

    order = ["x", "y", "z", "key"]
    done = checkpointed(scored(by_number(places(gone, "o", grain, "t"), places(fresh, "n", grain, "t"), [*like, "name", "tx", "ty", "tz"], order)))
    o, n = (checkpointed(d) for d in without(done))
    homes = [checkpointed(d.groupBy(*[F.col(f"{s}_{c}").alias(c) for c in (*like, "cx", "cy", "cz")]).agg(F.count("*").alias("here")).where(F.col("here") > crowd)) for d, s in ((places(o, "o", cell, "c"), "o"), (places(n, "n", cell, "c"), "n"))]
    crowded = homes[0].join(homes[1], [*like, "cx", "cy", "cz"], "leftsemi")
    if not crowded.isEmpty():
        some = [places(d, s, cell, "c").join(crowded, [F.col(f"{s}_{c}") == F.col(c) for c in (*like, "cx", "cy", "cz")], "leftsemi").drop(*[f"{s}_c{a}" for a in "xyz"]) for d, s in ((o, "o"), (n, "n"))]
        fine = neighbours(*some, [*like, "name"], cell / 16, crowd)
        done = checkpointed(done.unionByName(mutual_best(fine.select("o_key", "n_key", score, "apart"))))
        o, n = (checkpointed(d) for d in without(done))
    single = lambda d, s: d.groupBy(f"{s}_class", f"{s}_geometry", f"{s}_name").agg(F.count("*").alias("uses"), *[F.min(f"{s}_{c}").alias(f"{s}_{c}") for c in order[3:] + order[:3]]).where("uses = 1").drop("uses")
    alone = single(o, "o").join(single(n, "n"), (F.col("o_class") == F.col("n_class")) & (F.col("o_geometry") == F.col("n_geometry")) & (F.col("o_name") == F.col("n_name")))
    pairs = neighbours(o, n, like, cell, crowd).select("o_key", "n_key", score, "apart").unionByName(alone.select("o_key", "n_key", score, F.lit(0).cast("bigint").alias("apart")))
    done = checkpointed(done.unionByName(mutual_best(pairs)))
    o, n = without(done)
    return done.unionByName(scored(by_number(places(o, "o", cell, "c"), places(n, "n", cell, "c"), [*like, "name", "cx", "cy", "cz"], order)))
