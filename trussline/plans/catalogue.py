"""The registered queries and their SQL: each operator over a projection of the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.numbers import csv_number, format_number, to_number
from trussline.functions.scratch import scratch_path
from trussline.operators import boxes, catalogue, clashes, events, graphs, matrix, models, quantities, solids
from trussline.plans import ids

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _money(*columns: str) -> list:
    return [F.round(c, 2).cast("decimal(18,2)").alias(c) for c in columns]


def _lines(spark: SparkSession, sf_dir: str, total: bool) -> DataFrame:
    q = quantities.aggregate(_t(spark, sf_dir, "lineitem"), "l_returnflag", {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice")}, total)
    return q.select("key", "n", *_money("sum_qty", "sum_price"), "have_qty", "have_price", "is_total")


_SUMS = "count(*) AS n, CAST(round(sum(l_quantity), 2) AS DECIMAL(18,2)) AS sum_qty, CAST(round(sum(l_extendedprice), 2) AS DECIMAL(18,2)) AS sum_price, count(l_quantity) AS have_qty, count(l_extendedprice) AS have_price"


@query(f"SELECT l_returnflag AS key, {_SUMS}, false AS is_total FROM lineitem GROUP BY l_returnflag")
def qto_group_sum(spark, sf_dir):
    return _lines(spark, sf_dir, False)


@query(f"SELECT l_returnflag AS key, {_SUMS}, grouping(l_returnflag) = 1 AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def qto_rollup_total(spark, sf_dir):
    return _lines(spark, sf_dir, True)


@query("SELECT l_returnflag AS key, count(*) AS n, count(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END) AS have_qty, CAST(round(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 2) AS DECIMAL(18,2)) AS sum_qty FROM lineitem GROUP BY 1")
def qto_have_counts(spark, sf_dir):
    some = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity")).when(F.col("l_linenumber") % 3 == 2, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    q = quantities.aggregate(_t(spark, sf_dir, "lineitem"), "l_returnflag", {"qty": some}, False)
    return q.select("key", "n", "have_qty", *_money("sum_qty"))


@query("WITH g AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1) SELECT key, n, CAST(row_number() OVER (ORDER BY regexp_extract(key, '^[^0-9]*'), CAST(regexp_extract(key, '[0-9]+') AS BIGINT), key) AS INT) AS rank FROM g")
def qto_natural_rank(spark, sf_dir):
    q = quantities.aggregate(_t(spark, sf_dir, "part"), "p_brand", {}, False)
    return quantities.natural_rank(q).select("key", "n", "rank")


@query()
def qto_csv_line(spark, sf_dir):
    q = quantities.aggregate(_t(spark, sf_dir, "lineitem"), "l_returnflag", {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice")})
    return quantities.csv_lines(q, ["qty", "price"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_discount END AS value FROM lineitem")
def number_text(spark, sf_dir):
    d = F.col("l_discount").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 3, F.concat(d, F.lit("d"))).when(F.col("l_linenumber") % 4 == 1, F.replace(d, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit(" "), d, F.lit(" ")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_number(text).alias("value"))


@query("SELECT p_partkey, replace(regexp_replace(regexp_replace(printf('%.3f', CAST(p_size AS DOUBLE) / 8), '0+$', ''), '\\.$', ''), '.', ',') AS csv, CAST(p_size AS VARCHAR) AS shown FROM part")
def number_format(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", csv_number(F.col("p_size") / 8, ",").alias("csv"), format_number(F.col("p_size").cast("double")).alias("shown"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("col_name"), F.col("n_regionkey").alias("r2"))
    both = n.join(r, (F.col("n_regionkey") == F.col("r2")))
    hard = (F.col("n_nationkey") + F.col("k2") * 2) % 3 == 0
    return both.select(F.col("n_name").alias("row_name"), "col_name", F.when(hard, "hard").otherwise("clearance").alias("type"), F.when(hard & (F.col("k2") % 2 == 0), None).otherwise((F.col("n_nationkey") * 7 + F.col("k2") * 3) % 50 + 1).cast("double").alias("tol_mm"), F.col("n_nationkey").alias("r"), F.col("k2").alias("c"))


_CELLS = """WITH cells AS (SELECT a.n_name AS row_name, b.n_name AS col_name, (a.n_nationkey + b.n_nationkey * 2) % 3 = 0 AS hard,
 CASE WHEN (a.n_nationkey + b.n_nationkey * 2) % 3 = 0 AND b.n_nationkey % 2 = 0 THEN NULL ELSE CAST((a.n_nationkey * 7 + b.n_nationkey * 3) % 50 + 1 AS DOUBLE) END AS tol_mm
 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)"""


@query(_CELLS + """ SELECT least(row_name, col_name) AS a_name, greatest(row_name, col_name) AS b_name, CASE WHEN bool_or(hard) THEN 'hard' ELSE 'clearance' END AS type,
 CASE WHEN bool_or(hard) THEN min(CASE WHEN hard THEN coalesce(tol_mm, 1.0) END) ELSE max(CASE WHEN NOT hard THEN tol_mm END) END AS tol_mm FROM cells GROUP BY 1, 2""")
def matrix_rules(spark, sf_dir):
    return matrix.matrix_rules(_cells(spark, sf_dir)).drop("tol")


@query(_CELLS + " SELECT row_name, " + ", ".join(f"max(CASE WHEN col_name = '{c}' THEN CASE WHEN hard THEN CASE WHEN tol_mm IS NULL THEN 'H' ELSE 'H:' || CAST(CAST(tol_mm AS INT) AS VARCHAR) END ELSE CAST(CAST(tol_mm AS INT) AS VARCHAR) END END) AS \"{c}\"" for c in ("NATION_1", "NATION_2", "NATION_3")) + " FROM cells GROUP BY row_name")
def matrix_pivot(spark, sf_dir):
    return matrix.matrix_grid(_cells(spark, sf_dir), ["NATION_1", "NATION_2", "NATION_3"])


@query("SELECT s AS set, c AS ifc_class, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'IfcWall' WHEN 1 THEN 'IfcBeam' ELSE 'IfcDuct' END AS s FROM events) e JOIN (VALUES ('IfcWall', 'IFCWALL'), ('IfcWall', 'IFCWALLSTANDARDCASE'), ('IfcWall', 'IFCWALLELEMENTEDCASE'), ('IfcBeam', 'IFCBEAM'), ('IfcBeam', 'IFCBEAMSTANDARDCASE'), ('IfcDuct', 'IFCDUCT')) v(k, c) ON e.s = v.k GROUP BY 1, 2")
def class_expand(spark, sf_dir):
    k = F.col("event_id") % 3
    sets = _t(spark, sf_dir, "events").select(F.when(k == 0, "IfcWall").when(k == 1, "IfcBeam").otherwise("IfcDuct").alias("name"))
    return matrix.expand_classes(sets).groupBy("set", "ifc_class").agg(F.count("*").alias("n"))


@query("SELECT concat_ws('|', least(a.s_name, b.s_name), greatest(a.s_name, b.s_name), 'r' || CAST(a.s_nationkey AS VARCHAR)) AS clash, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1")
def clash_key(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("rule"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return matrix.clash_counts(s).select("clash", "n")


def _boxes(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    x, y, z = (((F.col("p_partkey") * m + shift) % 400 / 4.0) for m in (37, 53, 91))
    s = F.col("p_size") / 8.0
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), x.alias("x0"), y.alias("y0"), z.alias("z0"), (x + s).alias("x1"), (y + s).alias("y1"), (z + s).alias("z1"))


def _box_sql(shift: int) -> str:
    axis = lambda m, s="": f"((p_partkey * {m} + {shift}) % 400) / 4.0{s}"
    return "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS key, " + ", ".join(f"{axis(m)} AS {a}0, {axis(m, ' + p_size / 8.0')} AS {a}1" for a, m in zip("xyz", (37, 53, 91), strict=True)) + " FROM part"


_HIT = " AND ".join(f"a.{x}0 <= b.{x}1 + {{g}} AND b.{x}0 - {{g}} <= a.{x}1" for x in "xyz")


@query(f"WITH a AS ({_box_sql(0)}), b AS ({_box_sql(5)}) SELECT a.key AS key_a, b.key AS key_b FROM a JOIN b ON a.key <> b.key AND {_HIT.format(g=0)}")
def box_join(spark, sf_dir):
    return boxes.box_join(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 5), cell=2.0, alike=True).select("key_a", "key_b")


@query(f"WITH a AS ({_box_sql(0)}), b AS ({_box_sql(5)}) SELECT a.key AS key_a, b.key AS key_b FROM a JOIN b ON a.key <> b.key AND {_HIT.format(g=0.5)}")
def box_join_inflated(spark, sf_dir):
    return boxes.box_join(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 5), inflate=0.5, cell=2.0, alike=True).select("key_a", "key_b")


@query(f"WITH a AS ({_box_sql(0)}) SELECT a.key AS key_a, b.key AS key_b FROM a JOIN a b ON a.key < b.key AND {_HIT.format(g=0)}")
def box_self_join(spark, sf_dir):
    one = _boxes(spark, sf_dir, 0)
    return boxes.self_join(one, cell=2.0).select("key_a", "key_b")


@query(f"WITH a AS ({_box_sql(0)}), b AS ({_box_sql(5)}) SELECT least(50, count(*)) AS n, count(*) >= 50 AS truncated FROM a JOIN b ON a.key <> b.key AND {_HIT.format(g=0)}")
def box_pair_cap(spark, sf_dir):
    pairs, cut = boxes.capped(boxes.box_join(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 5), cell=2.0, alike=True), 50)
    return pairs.agg(F.count("*").alias("n")).withColumn("truncated", F.lit(cut))


_DEPTH = "greatest(0.0, least(" + ", ".join(f"least(a.{x}1, b.{x}1) - greatest(a.{x}0, b.{x}0)" for x in "xyz") + "))"


@query(f"WITH a AS ({_box_sql(0)}), b AS ({_box_sql(5)}) SELECT a.key AS key_a, b.key AS key_b, CAST({_DEPTH} AS DOUBLE) AS depth FROM a JOIN b ON a.key <> b.key AND {_HIT.format(g=0)}")
def overlap_depth(spark, sf_dir):
    return boxes.box_join(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 5), cell=2.0, alike=True).select("key_a", "key_b", boxes.overlap_depth().alias("depth"))


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
 SELECT a.id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 9) AS dist FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.1 GROUP BY 1""")
def nearest_within(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[i].cast("double") for i in range(3)]
    points = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), *[c.alias(x) for c, x in zip(at, "xyz", strict=True)])
    triangles = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("tri"), *[c.alias(f"{v}{x}") for v in "abc" for c, x in zip(at, "xyz", strict=True)])
    return clashes.nearest_surface(points, triangles, 0.1).select("id", F.round("dist", 9).alias("dist"))


def _cubes(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Unit cubes of suppliers' keys as meshes."""
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    s = _t(spark, sf_dir, "supplier")
    o = [((F.col("s_suppkey") * m + shift) % 40 / 8.0) for m in (3, 7, 11)]
    tris = [F.lit(float((v >> (2 - k)) & 1)) + o[k] for f in faces for v in f for k in range(3)]
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.array(*tris).alias("tris"))


@query()
def hard_pair(spark, sf_dir):
    return clashes.hard_meshes(_cubes(spark, sf_dir, 0), _cubes(spark, sf_dir, 3))


@query()
def clearance_pair(spark, sf_dir):
    return clashes.near_meshes(_cubes(spark, sf_dir, 0), _cubes(spark, sf_dir, 3), 0.5)


@query()
def penetration(spark, sf_dir):
    return solids.penetration_meshes(_cubes(spark, sf_dir, 0), _cubes(spark, sf_dir, 3))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as element views."""
    o = _t(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    cell = F.struct(price.alias("value"), F.lit("IfcReal").alias("dataType"))
    flag = F.struct(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"), F.lit("IfcLabel").alias("dataType"))
    part_of = F.array(F.struct(F.lit("IFCRELAGGREGATES").alias("relation"), F.when(F.col("o_custkey") % 2 == 0, "IfcBuilding").otherwise("IfcSite").alias("wholeType"), F.lit(None).cast("string").alias("wholePredefinedType")))
    return o.select(
        F.when(F.col("o_orderkey") % 4 == 0, "IfcWall").when(F.col("o_orderkey") % 4 == 1, "IfcBeam").otherwise("IfcSlab").alias("ifc_type"), F.col("o_orderstatus").alias("predefined_type"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("global_id"),
        F.create_map(F.lit("Name"), F.col("o_orderpriority"), F.lit("Tag"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus"))).alias("attributes"),
        F.create_map(F.lit("Pset_Cost"), F.create_map(F.lit("Price"), cell, F.lit("Status"), flag)).alias("psets"),
        F.array(F.struct(F.lit("Uniclass").alias("system"), F.concat(F.lit("EF_"), (F.col("o_custkey") % 10).cast("string")).alias("value"))).alias("classifications"),
        F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("concrete"))).otherwise(F.array(F.lit("steel"), F.lit("paint"))).alias("materials"), part_of.alias("part_of"),
    )


def _spec(name: str, requirement: str, applies: str = "<entity><name><simpleValue>IFCWALL</simpleValue></name></entity>") -> str:
    return f'<specification name="{name}" ifcVersion="IFC4"><applicability minOccurs="0">{applies}</applicability><requirements>{requirement}</requirements></specification>'


_V = "<{0}><simpleValue>{1}</simpleValue></{0}>"
_REQUIREMENTS = {
    "entity": "<entity><name><simpleValue>IfcWall</simpleValue></name>" + _V.format("predefinedType", "F") + "</entity>",
    "attribute": "<attribute>" + _V.format("name", "Tag") + _V.format("value", "O") + "</attribute>",
    "classification": "<classification><value><restriction base='string'><pattern value='EF_[0-4]'/></restriction></value>" + _V.format("system", "Uniclass") + "</classification>",
    "property": "<property>" + _V.format("propertySet", "Pset_Cost") + _V.format("baseName", "Price") + "<value><restriction base='double'><minInclusive value='1000'/><maxExclusive value='200000'/></restriction></value></property>",
    "material": "<material>" + _V.format("value", "concrete") + "</material>",
    "part_of": "<partOf relation='IfcRelAggregates'><entity>" + _V.format("name", "IFCBUILDING") + "</entity></partOf>",
}


def _ids(*specs: str) -> list[ids.Spec]:
    return ids.parse_ids(f"<ids xmlns='http://standards.buildingsmart.org/IDS'><info><title>t</title></info><specifications>{''.join(specs)}</specifications></ids>").specs


def _ids_query(kind: str, sql: str) -> None:
    @query(f"SELECT CAST(o_orderkey AS VARCHAR) AS global_id, {sql} AS passed FROM orders WHERE o_orderkey % 4 = 0")
    def run(spark, sf_dir):
        return ids.evaluate(_views(spark, sf_dir), _ids(_spec(kind, _REQUIREMENTS[kind]))).select("global_id", "passed")

    QUERIES[f"ids_{kind}"], ORACLES[f"ids_{kind}"] = QUERIES.pop("run"), ORACLES.pop("run")


_PASSES = {
    "entity": "o_orderstatus = 'F'", "attribute": "o_orderkey % 7 <> 0 AND o_orderstatus = 'O'", "classification": "o_custkey % 10 <= 4",
    "property": "o_totalprice >= 1000 AND o_totalprice < 200000", "material": "o_custkey % 3 = 0", "part_of": "o_custkey % 2 = 0",
}
for _k, _s in _PASSES.items():
    _ids_query(_k, _s)


def _cardinalities() -> list[ids.Spec]:
    tag = "<attribute cardinality='{}'>" + _V.format("name", "Tag") + _V.format("value", "O") + "</attribute>"
    return _ids(*[_spec(c, tag.format(c)) for c in ("required", "optional", "prohibited")])


@query("""SELECT spec_idx, CAST(o_orderkey AS VARCHAR) AS global_id, CASE WHEN spec_idx = 2 THEN CASE WHEN ok THEN 'prohibited' ELSE '' END WHEN ok THEN '' ELSE 'badValue' END AS code
 FROM (SELECT *, o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AS ok FROM orders WHERE o_orderkey % 4 = 0), (VALUES (0), (1), (2)) s(spec_idx)""")
def ids_cardinality(spark, sf_dir):
    return ids.evaluate(_views(spark, sf_dir), _cardinalities()).select("spec_idx", "global_id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("code"))


@query("""SELECT spec_idx, name, count(*) AS applicable, count(*) FILTER (WHERE ok = (spec_idx <> 2)) AS passed, count(*) FILTER (WHERE ok <> (spec_idx <> 2)) AS failed
 FROM (SELECT *, o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AS ok FROM orders WHERE o_orderkey % 4 = 0), (VALUES (0, 'required'), (1, 'optional'), (2, 'prohibited')) s(spec_idx, name) GROUP BY 1, 2""")
def ids_summary(spark, sf_dir):
    specs = _cardinalities()
    return ids.summary(ids.evaluate(_views(spark, sf_dir), specs), specs)


_MARK = "<attribute>" + _V.format("name", "Mark") + "</attribute>"


@query("""WITH w AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS global_id FROM orders WHERE o_orderkey % 4 = 0)
 SELECT global_id, 'entity' AS facet_type, 'badValue' AS code, 'IFC IFCWALL' AS label, 'IFCWALL' AS expected, 'IfcWall' AS got FROM w WHERE o_orderstatus <> 'F'
 UNION ALL SELECT global_id, 'attribute', 'badValue', 'Tag', 'O', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END FROM w WHERE o_orderkey % 7 = 0 OR o_orderstatus <> 'O'
 UNION ALL SELECT global_id, 'classification', 'badValue', 'Uniclass', 'pattern: EF_[0-4]', 'EF_' || CAST(o_custkey % 10 AS VARCHAR) FROM w WHERE o_custkey % 10 > 4
 UNION ALL SELECT global_id, 'property', 'badValue', 'Pset_Cost.Price', '≥1000, <200000', CAST(o_totalprice AS VARCHAR) FROM w WHERE o_totalprice < 1000 OR o_totalprice >= 200000
 UNION ALL SELECT global_id, 'material', 'badValue', '(materiale)', 'concrete', 'steel, paint' FROM w WHERE o_custkey % 3 <> 0
 UNION ALL SELECT global_id, 'partOf', 'badValue', 'partOf IFCRELAGGREGATES', 'IFCBUILDING', '' FROM w WHERE o_custkey % 2 <> 0
 UNION ALL SELECT global_id, 'attribute', 'missing', 'Mark', '', '' FROM w""")
def ids_reasons(spark, sf_dir):
    found = ids.evaluate(_views(spark, sf_dir), _ids(_spec("all", "".join(_REQUIREMENTS.values()) + _MARK)))
    return found.select("global_id", F.explode("reasons").alias("r")).select("global_id", "r.facet_type", "r.code", "r.label", "r.expected", "r.got")


@query("SELECT event_id, value FROM events WHERE event_id % CAST((SELECT ceil(count(*) / 300.0) FROM events) AS BIGINT) = 0")
def stride_sample(spark, sf_dir):
    from trussline.sources.pointclouds import step_for

    e = _t(spark, sf_dir, "events")
    return e.where(F.col("event_id") % step_for(e.count(), 300) == 0).select("event_id", "value")


_POSE = (0.8, 0.0, 0.6, 0.0, 10.0, 20.0, 30.0)


@query("""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) * 0.001 + 5 AS x, CAST(embedding[2] AS DOUBLE) * 0.001 + 6 AS y, CAST(embedding[3] AS DOUBLE) * 0.001 + 7 AS z FROM embeddings),
 w AS (SELECT 0.28 * x + 0.96 * z + 10 - 1 AS e, y + 20 - 2 AS n, -0.96 * x + 0.28 * z + 30 - 3 AS h FROM p)
 SELECT round(min(e), 6) AS x0, round(min(h), 6) AS y0, round(min(-n), 6) AS z0, round(max(e), 6) AS x1, round(max(h), 6) AS y1, round(max(-n), 6) AS z1 FROM w""")
def pose_rebase_bounds(spark, sf_dir):
    w, a, b, c, *move = _POSE
    p = [F.col("embedding")[i].cast("double") * 0.001 + off for i, off in enumerate((5, 6, 7))]
    turn = [[1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)], [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)], [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)]]
    e, n, h = (sum(F.lit(turn[i][k]) * p[k] for k in range(3)) + move[i] - (i + 1) for i in range(3))
    world = _t(spark, sf_dir, "embeddings").select(e.alias("x"), h.alias("y"), (-n).alias("z"))
    return boxes.bounds(world).select(*[F.round(f"{x}{i}", 6).alias(f"{x}{i}") for i in "01" for x in "xyz"])


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN 'exact' WHEN p_brand LIKE 'Brand#1%' THEN 'prefix' END AS tipologia,
 CASE WHEN p_brand = 'Brand#12' THEN 15.0 WHEN p_brand LIKE 'Brand#1%' THEN 70.0 END AS tol_mm FROM part""")
def catalogue_lookup(spark, sf_dir):
    rules = [("Brand#12", None, "exact", 15.0, None), ("Brand#1*", "primaria", "prefix", None, None), ("*none*", None, "segment", None, None)]
    found = catalogue.lookup(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code")), spark.createDataFrame(rules, catalogue.COLUMNS))
    return found.select("p_partkey", "tipologia", "tol_mm")


@query("SELECT user_id AS session_id, event_type AS event, min(ts) AS ts FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2")
def event_session_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", events.control_event(F.col("event_type"), {"click": "click", "purchase": "purchase"}).alias("event"))
    return events.first_of_session(e.where("event is not null"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.ifc$') THEN 'ifc-open' WHEN regexp_matches(lower(url), '\\.(html|htm)$') THEN 'page-open' END AS kind FROM pages")
def file_kind(spark, sf_dir):
    kinds = (*events.FILE_KINDS, (r"\.(html|htm)$", "page-open"))
    return _t(spark, sf_dir, "pages").select("page_id", events.file_kind(F.col("url"), kinds=kinds).alias("kind"))


@query("""WITH n AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
 SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderstatus <> n.o_orderstatus THEN 'modified' ELSE 'same' END AS change,
 CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS fields FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def rev_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    n = o.select(F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return catalogue.revision_diff(o, n, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements of types (customers) on storeys (priorities)."""
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("element"), F.col("o_custkey").alias("type_key"), F.col("o_orderpriority").alias("storey"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    row = lambda owner, name, value: [F.col(owner).alias("owner"), F.lit("Pset_Common").alias("pset"), F.lit(name).alias("name"), value.alias("value")]
    own = o.select(*row("o_orderkey", "Status", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")))).unionByName(o.where("o_orderkey % 5 = 0").select(*row("o_orderkey", "Clerk", F.col("o_orderpriority"))))
    types = c.where("c_custkey % 2 = 0").select(*row("c_custkey", "Status", F.col("c_mktsegment")))
    return models.extract(_elements(spark, sf_dir), own, [("status", "Pset_Common", "Status"), ("clerk", "Pset_Common", "Clerk")], types)


_EXTRACT = """SELECT o_orderkey AS element, o_custkey AS type_key, o_orderpriority AS storey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS clerk FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


@query(_EXTRACT)
def data_extract(spark, sf_dir):
    return _extracted(spark, sf_dir)


@query(f"WITH e AS ({_EXTRACT}) SELECT 'status' AS \"column\", count(status) AS filled, count(*) AS rows FROM e UNION ALL SELECT 'clerk', count(clerk), count(*) FROM e")
def data_coverage(spark, sf_dir):
    return models.coverage(_extracted(spark, sf_dir), ["status", "clerk"])


@query(f"WITH e AS ({_EXTRACT}) SELECT storey, count(*) AS elements, CASE WHEN min(status) = max(status) THEN min(status) END AS status, min(status) <> max(status) AS status_differs FROM e GROUP BY storey")
def data_by_storey(spark, sf_dir):
    return models.grouped(_extracted(spark, sf_dir), "storey", ["status"])


@query("""SELECT s_suppkey, CASE WHEN n_nationkey % 2 = 0 THEN upper('IfcKerb') ELSE 'IFCBUILDINGELEMENTPROXY' END AS ifc_class, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'NOTDEFINED' END AS predefined_type, n_nationkey % 2 = 0 AS patched
 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def class_patch(spark, sf_dir):
    e = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ref"), F.lit("IFCBUILDINGELEMENTPROXY").alias("ifc_class"), F.lit("NOTDEFINED").alias("predefined_type"))
    m = _t(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"), F.lit("IfcKerb").alias("new_class"), F.col("n_name").alias("new_type"))
    return models.class_patch(e, m, "ref").drop("ref")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem)
 SELECT l_orderkey, l_linenumber, CAST(cents // 100000 AS VARCHAR) || '+' || lpad(CAST((cents // 100) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS chainage, round(cents / 100.0, 2) AS metres FROM c""")
def chainage(spark, sf_dir):
    text = models.chainage_text(F.col("l_extendedprice"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("chainage"), F.round(models.chainage_metres(text), 2).alias("metres"))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, "Z").alias("grade"), F.col("o_orderstatus").alias("status"))
    high, closed = F.col("o_totalprice") > 200000, F.col("status") == "F"
    return models.edit(rows, [models.Edit(high & closed, "grade", F.lit("A"), True), models.Edit(closed, "grade", F.lit("B")), models.Edit(~closed, "status", F.lit("open"), True)])


_RULE = "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 END"


@query(f"""SELECT o_orderkey, o_totalprice, CASE {_RULE} WHEN 0 THEN 'A' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE 'B' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Z' END END AS grade,
 CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'open' END AS status FROM orders""")
def property_edit(spark, sf_dir):
    return _edited(spark, sf_dir)[0]


@query(f"""SELECT o_orderkey, o_totalprice, 'grade' AS property, {_RULE} AS rule, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' END AS old, CASE {_RULE} WHEN 0 THEN 'A' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE 'B' END END AS new,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'set' WHEN {_RULE} = 0 THEN 'overwritten' ELSE 'kept' END AS action FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_orderkey, o_totalprice, 'status', 2, o_orderstatus, 'open', 'overwritten' FROM orders WHERE o_orderstatus <> 'F'""")
def property_edit_log(spark, sf_dir):
    return _edited(spark, sf_dir)[1]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = models.with_uses(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", "uses")
    return models.health_check(o, [
        models.Check("duplicate guid", F.col("uses") > 1, "blocking", F.col("o_custkey")), models.Check("missing class", F.col("o_orderstatus") == "P", "fix", F.lit("export setting")),
        models.Check("far from origin", F.col("o_totalprice") > 400000, "note", F.floor(F.col("o_totalprice") / 1000)), models.Check("never", F.lit(False), "blocking"),
    ])


_HEALTH = """WITH u AS (SELECT o_custkey, count(*) AS uses FROM orders GROUP BY 1)
 SELECT 'duplicate guid' AS "check", 'blocking' AS severity, count(*) AS problems, CAST(coalesce(sum(uses), 0) AS BIGINT) AS elements FROM u WHERE uses > 1
 UNION ALL SELECT 'missing class', 'fix', count(DISTINCT 1), count(*) FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT 'far from origin', 'note', count(DISTINCT floor(o_totalprice / 1000)), count(*) FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'never', 'blocking', 0, 0"""


@query(_HEALTH)
def health_check(spark, sf_dir):
    return _checked(spark, sf_dir)


@query(f"SELECT count(*) FILTER (WHERE severity = 'blocking' AND elements > 0) = 0 AS deliverable, count(*) FILTER (WHERE severity = 'blocking' AND elements > 0) AS blocking FROM ({_HEALTH})")
def delivery_gate(spark, sf_dir):
    return models.gate(_checked(spark, sf_dir))


@query("""WITH m AS (SELECT 0 AS model, s_suppkey AS id, 'g' || CAST(s_suppkey % 40 AS VARCHAR) AS guid, s_suppkey - 1 AS ref FROM supplier
  UNION ALL SELECT 1, p_partkey + (SELECT max(s_suppkey) FROM supplier), 'g' || CAST(p_partkey AS VARCHAR), p_partkey - 1 + (SELECT max(s_suppkey) FROM supplier) FROM part),
 f AS (SELECT guid, min(id) AS first FROM m GROUP BY 1)
 SELECT model, id, CASE WHEN id = first THEN m.guid ELSE md5(CAST(model AS VARCHAR) || '|' || CAST(id AS VARCHAR) || '|' || m.guid) END AS guid, ref FROM m JOIN f ON m.guid = f.guid""")
def merge_models(spark, sf_dir):
    model = lambda t, k, g: _t(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), F.concat(F.lit("g"), g.cast("string")).alias("guid"), F.array(F.col(k).cast("long") - 1).alias("refs"))
    both = models.merge([model("supplier", "s_suppkey", F.col("s_suppkey") % 40), model("part", "p_partkey", F.col("p_partkey"))])
    return both.select("model", "id", "guid", F.col("refs")[0].alias("ref"))


@query("""WITH RECURSIVE r(id) AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT o_orderkey // 2 FROM r JOIN orders ON o_orderkey = id WHERE o_orderkey // 2 > 0) SELECT id FROM r""")
def reference_closure(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    links = o.select(F.col("id").alias("source"), F.floor(F.col("id") / 2).cast("long").alias("target")).where("target > 0")
    return models.closure(links, o.where("id % 97 = 0"))


@query("""SELECT c_custkey AS site, concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'degenerate' END, CASE WHEN c_custkey % 7 = 0 THEN 'rotation' END, CASE WHEN c_custkey % 11 < 3 AND c_custkey % 11 > 1 THEN 'origin' END) AS wrong FROM customer""")
def georeference_check(spark, sf_dir):
    k = F.col("c_custkey")
    axis = F.when(k % 10 == 0, 0.0).otherwise(1.0)
    east = k.cast("double") * 10
    sites = _t(spark, sf_dir, "customer").select(k.alias("site"), axis.alias("xa"), F.lit(0.0).alias("xo"), (k % 360).cast("double").alias("rotation"), ((k % 360) + 360 + F.when(k % 7 == 0, 5).otherwise(0)).cast("double").alias("true_north"), east.alias("east"), east.alias("north"), (east + (k % 11) * F.when(k % 11 == 2, 1.0).otherwise(0.0)).alias("ref_east"), east.alias("ref_north"))
    return models.georeference(sites)


@query("""WITH e AS (SELECT p_partkey AS k, p_size FROM part)
 SELECT CAST(k AS VARCHAR) AS key, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'n' || CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS new_key,
 CASE WHEN k % 11 = 0 THEN 'removed' WHEN k % 7 = 0 THEN 'recreated' WHEN k % 5 = 0 OR k % 3 = 0 THEN 'modified' ELSE 'same' END AS change,
 CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 5 = 0 THEN 'size' END, CASE WHEN k % 3 = 0 THEN 'position' END) END AS fields, 1.0::DOUBLE AS confidence FROM e
 UNION ALL SELECT NULL, 'x' || CAST(k AS VARCHAR), 'added', '', 1.0 FROM e WHERE k % 13 = 0""")
def rev_diff_matched(spark, sf_dir):
    k = F.col("p_partkey")
    text = k.cast("string")
    p = _t(spark, sf_dir, "part")
    row = lambda key, x, size: [key.alias("key"), F.lit("IFCPLATE").alias("class"), F.concat(F.lit("geo"), (k % 50).cast("string")).alias("geometry"), F.concat(F.lit("plate "), text).alias("name"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), size.alias("size")]
    at, size = k.cast("double") * 10, F.col("p_size").cast("double")
    old = p.select(*row(text, at, size))
    moved = F.when(k % 3 == 0, at + 0.005).otherwise(at + 0.0004)
    new = p.where(k % 11 != 0).select(*row(F.when(k % 7 == 0, F.concat(F.lit("n"), text)).otherwise(text), F.when(k % 7 == 0, at).otherwise(moved), F.when(k % 5 == 0, size + 1).otherwise(size)))
    extra = p.where(k % 13 == 0).select(*row(F.concat(F.lit("x"), text), at + 5, size)).withColumn("geometry", F.lit("other"))
    return models.matched_diff(old, new.unionByName(extra), ["size"])


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || CAST(s_suppkey AS VARCHAR) AS key, (s_suppkey * 3) % 1009 / 64.0 AS x, (s_suppkey * 7) % 1009 / 64.0 AS y, (s_suppkey * 11) % 1009 / 64.0 AS z FROM supplier),
 d AS (SELECT a.k AS ka, b.k AS kb, a.key AS key_a, b.key AS key_b, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, abs(a.z - b.z) AS dz FROM s a JOIN s b ON a.k <> b.k)
 SELECT 'IFCBEAM' AS a_name, 'IFCWALL' AS b_name, 'hard' AS type, key_a, key_b, round(1 - greatest(dx, dy, dz), 6)::DOUBLE AS value FROM d WHERE ka % 3 = 1 AND kb % 3 = 0 AND greatest(dx, dy, dz) < 1
 UNION ALL SELECT 'IFCSLAB', 'IFCWALL', 'clearance', key_a, key_b, round(dist, 6)::DOUBLE FROM (SELECT *, sqrt(pow(greatest(dx - 1, 0), 2) + pow(greatest(dy - 1, 0), 2) + pow(greatest(dz - 1, 0), 2)) AS dist FROM d) WHERE ka % 3 = 2 AND kb % 3 = 0 AND dist < 0.25""")
def clash_run(spark, sf_dir):
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    k = F.col("s_suppkey")
    at = [(k * m) % 1009 / 64.0 for m in (3, 7, 11)]
    tris = F.array(*[F.lit(float((v >> (2 - i)) & 1)) + at[i] for f in faces for v in f for i in range(3)])
    kind = F.element_at(F.array(F.lit("IfcWall"), F.lit("IfcBeam"), F.lit("IfcSlab")), (k % 3 + 1).cast("int"))
    elements = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("key"), kind.alias("ifc_class"), tris.alias("tris"))
    sets = spark.createDataFrame([("IFCWALL",), ("IFCBEAM",), ("IFCSLAB",)], "name string")
    rules = spark.createDataFrame([("IFCBEAM", "IFCWALL", "hard", 0.0), ("IFCSLAB", "IFCWALL", "clearance", 0.25)], "a_name string, b_name string, type string, tol double")
    return clashes.clash_run(elements, sets, rules).select("a_name", "b_name", "type", "key_a", "key_b", F.round("value", 6).alias("value"))


@query("SELECT " + ", ".join(f"round(CAST(embedding[{i}] AS DOUBLE) * 10, 2)::DOUBLE + 0.0 AS {a}" for i, a in enumerate("xyz", 1)) + ", CAST(vec_id % 200 AS SMALLINT) AS r FROM embeddings")
def las_scan(spark, sf_dir):
    """Points written as LAS files by the tasks and read back."""
    from trussline.sources import pointclouds

    pointclouds.register(spark)
    where = scratch_path(spark, "las")
    at = [F.round(F.col("embedding")[i].cast("double") * 10, 2).alias(a) for i, a in enumerate("xyz")]
    colour = ((F.col("vec_id") % 200) * 256).cast("int")
    _t(spark, sf_dir, "embeddings").select(*at, colour.alias("r"), F.lit(65280).alias("g"), F.lit(0).alias("b")).write.format("las").mode("append").save(where)
    back = spark.read.format("las").option("path", where).option("swizzle", "false").load()
    return back.select(*[(F.round(F.col(a).cast("double"), 2) + 0.0).alias(a) for a in "xyz"], "r")


_ALIKE = """p AS (SELECT p_partkey AS k, p_partkey % 3 * 100.0 + (p_partkey % 97) * 0.01 AS x, p_partkey % 3 AS g FROM part),
 o AS (SELECT *, row_number() OVER (PARTITION BY g, x ORDER BY lpad(CAST(k AS VARCHAR), 9, '0')) AS i FROM p),
 n AS (SELECT *, row_number() OVER (PARTITION BY g, x ORDER BY lpad(CAST(k AS VARCHAR), 9, '0')) AS i FROM p WHERE k % 97 <> 5 OR k % 2 = 0)"""


@query(f"""WITH {_ALIKE} SELECT lpad(CAST(o.k AS VARCHAR), 9, '0') AS key, 'n' || lpad(CAST(n.k AS VARCHAR), 9, '0') AS new_key, CASE WHEN n.k IS NULL THEN 'removed' ELSE 'recreated' END AS change, 1.0::DOUBLE AS confidence
 FROM o LEFT JOIN n ON o.g = n.g AND o.x = n.x AND o.i = n.i""")
def rev_diff_alike(spark, sf_dir):
    """Identical bolts, hundreds in a cell and several on a spot, all under new keys, some gone: n alike meet n alike."""
    k = F.col("p_partkey")
    text = F.lpad(k.cast("string"), 9, "0")
    x = (k % 3).cast("double") * 100 + (k % 97).cast("double") * 0.01
    row = lambda key: [key.alias("key"), F.lit("IFCFASTENER").alias("class"), F.lit("bolt").alias("geometry"), F.lit("M20").alias("name"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")]
    p = _t(spark, sf_dir, "part")
    return models.matched_diff(p.select(*row(text)), p.where("p_partkey % 97 <> 5 or p_partkey % 2 = 0").select(*row(F.concat(F.lit("n"), text))), []).select("key", "new_key", "change", "confidence")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'n' || CAST(p_partkey AS VARCHAR) AS new_key, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'recreated' ELSE 'proposed' END AS change,
 CASE p_partkey % 4 WHEN 0 THEN 0.9375 WHEN 1 THEN 0.875 WHEN 2 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence FROM part""")
def rev_diff_proposed(spark, sf_dir):
    """New keys for all: moved by 0.25, by 0.5, by 50 (found by its name alone), and not moved."""
    k = F.col("p_partkey")
    text = k.cast("string")
    by = F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(50.0), F.lit(0.0)), (k % 4 + 1).cast("int"))
    row = lambda key, x: [key.alias("key"), F.lit("IFCPLATE").alias("class"), F.lit("plate").alias("geometry"), F.concat(F.lit("plate "), text).alias("name"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")]
    p, at = _t(spark, sf_dir, "part"), k.cast("double") * 1000
    return models.matched_diff(p.select(*row(text, at)), p.select(*row(F.concat(F.lit("n"), text), at + by)), []).select("key", "new_key", "change", "confidence")


_SLOPES = """p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings),
 t AS (SELECT s_suppkey AS tri, (s_suppkey * 7 % 40 - 20) / 2.0 AS ax, (s_suppkey * 11 % 40 - 20) / 2.0 AS ay, (s_suppkey * 13 % 40 - 20) / 2.0 AS az, power(4.0, s_suppkey % 8 - 3) AS s FROM supplier),
 d AS (SELECT id, tri, z - az AS h, s, x - ax AS u, y - ay AS v FROM p, t),
 e AS (SELECT id, tri, h, u, v, s, greatest(0, least(1, u / s)) * s AS eu, greatest(0, least(1, v / s)) * s AS ev, greatest(0, least(1, (s - u + v) / (2 * s))) AS w FROM d),
 f AS (SELECT id, tri, sqrt(h * h + CASE WHEN u >= 0 AND v >= 0 AND u + v <= s THEN 0 ELSE least((u - eu) * (u - eu) + v * v, u * u + (v - ev) * (v - ev), (u - s * (1 - w)) * (u - s * (1 - w)) + (v - s * w) * (v - s * w)) END) AS dist FROM e)"""


def _slopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points, and level right triangles with legs from 1/64 to 256."""
    e, s = _t(spark, sf_dir, "embeddings"), _t(spark, sf_dir, "supplier")
    points = e.select(F.col("vec_id").alias("id"), *[(F.col("embedding")[i].cast("double") * 20).alias(a) for i, a in enumerate("xyz")])
    k = F.col("s_suppkey")
    x, y, z = ((k * m % 40 - 20) / 2.0 for m in (7, 11, 13))
    leg = F.pow(F.lit(4.0), k % 8 - 3)
    corners = {"a": (x, y, z), "b": (x + leg, y, z), "c": (x, y + leg, z)}
    return points, s.select(k.cast("long").alias("tri"), *[c.alias(f"{v}{a}") for v, at in corners.items() for a, c in zip("xyz", at, strict=True)])


@query(f"WITH {_SLOPES} SELECT id, round(min(dist), 9) AS dist FROM f WHERE dist <= 0.25 GROUP BY id")
def nearest_triangles(spark, sf_dir):
    """Nearest surfaces within a radius, of triangles from a sixteenth to a thousand times its size."""
    return clashes.nearest_surface(*_slopes(spark, sf_dir), 0.25).select("id", F.round("dist", 9).alias("dist"))


@query(f"WITH {_SLOPES} SELECT id, round(min(dist), 9) AS dist FROM f GROUP BY id")
def nearest_unbounded(spark, sf_dir):
    """Nearest surfaces at any distance, of triangles of very different sizes."""
    return clashes.nearest_surface(*_slopes(spark, sf_dir)).select("id", F.round("dist", 9).alias("dist"))


_FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def _cube(at: list, side: float):
    """A cube's twelve triangles, from its lowest corner."""
    return F.array(*[F.lit(float((v >> (2 - k)) & 1) * side) + at[k] for f in _FACES for v in f for k in range(3)])


_DEEPEST = "greatest(" + ", ".join("least(" + ", ".join(f"least({v} + {s}, 4 - {v} - {s})" for v, s in zip("xyz", (a, b, c), strict=True)) + ")" for a in (0, 0.5) for b in (0, 0.5) for c in (0, 0.5)) + ")"


@query(f"""WITH c AS (SELECT 's' || CAST(p_partkey % n + 1 AS VARCHAR) AS key_a, 'p' || CAST(p_partkey AS VARCHAR) AS key_b, p_partkey % 4 AS kind,
  (p_partkey * 3 % 50) / 16.0 + 0.25 AS x, (p_partkey * 7 % 50) / 16.0 + 0.25 AS y, (p_partkey * 11 % 50) / 16.0 + 0.25 AS z FROM part, (SELECT max(s_suppkey) AS n FROM supplier))
 SELECT key_a, key_b, round({_DEEPEST}, 9)::DOUBLE AS pen, true AS measured FROM c WHERE kind <> 3""")
def penetration_nested(spark, sf_dir):
    """Small cubes that are inside large ones, hundreds in one, or between them: how deep, without any crossing surface."""
    s, p = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part")
    large = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), _cube([F.col("s_suppkey") * 10.0, F.lit(0.0), F.lit(0.0)], 4.0).alias("tris"))
    n = F.lit(s.agg(F.max("s_suppkey")).first()[0])
    k = F.col("p_partkey")
    at = [(k * m % 50) / 16.0 + 0.25 for m in (3, 7, 11)]
    corner = [(k % n + 1) * 10.0 + at[0], at[1] + F.when(k % 4 == 3, 5.0).otherwise(0.0), at[2]]
    small = p.select(F.concat(F.lit("p"), k.cast("string")).alias("key"), _cube(corner, 0.5).alias("tris"))
    return solids.penetration_meshes(large, small).select("key_a", "key_b", F.round("pen", 9).alias("pen"), "measured")


_APART = """s AS (SELECT s_suppkey AS k, 's' || CAST(s_suppkey AS VARCHAR) AS key, (s_suppkey * 3) % 1009 / 64.0 AS x, (s_suppkey * 7) % 1009 / 64.0 AS y, (s_suppkey * 11) % 1009 / 64.0 AS z FROM supplier),
 d AS (SELECT a.key AS key_a, b.key AS key_b, abs(a.x - b.x - 1 / 128.0) AS dx, abs(a.y - b.y - 1 / 128.0) AS dy, abs(a.z - b.z - 1 / 128.0) AS dz FROM s a JOIN s b ON a.k <> b.k)"""


def _apart_cubes(spark: SparkSession, sf_dir: str, shift: float) -> DataFrame:
    """Unit cubes of suppliers' keys, of which no two of different shifts have faces in one plane."""
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("key"), _cube([(k * m) % 1009 / 64.0 + shift for m in (3, 7, 11)], 1.0).alias("tris"))


@query(f"WITH {_APART} SELECT key_a, key_b, round(1 - greatest(dx, dy, dz), 6)::DOUBLE AS overlap FROM d WHERE greatest(dx, dy, dz) < 1")
def hard_overlap(spark, sf_dir):
    """Crossing cubes, and how far their boxes overlap."""
    return clashes.hard_meshes(_apart_cubes(spark, sf_dir, 0.0), _apart_cubes(spark, sf_dir, 1 / 128)).select("key_a", "key_b", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {_APART} SELECT key_a, key_b, round(dist, 6)::DOUBLE AS dist FROM (SELECT *, sqrt(pow(greatest(dx - 1, 0), 2) + pow(greatest(dy - 1, 0), 2) + pow(greatest(dz - 1, 0), 2)) AS dist FROM d) WHERE dist < 0.75")
def clearance_distance(spark, sf_dir):
    """Cubes nearer than 0.75, and how near."""
    return clashes.near_meshes(_apart_cubes(spark, sf_dir, 0.0), _apart_cubes(spark, sf_dir, 1 / 128), 0.75).select("key_a", "key_b", F.round("dist", 6).alias("dist"))


@query("SELECT " + ", ".join(f"round(CAST(embedding[{i}] AS DOUBLE) * 10, 2)::DOUBLE + 0.0 AS {a}" for i, a in enumerate("xyz", 1)) + ", CAST(vec_id % 200 AS SMALLINT) AS r FROM embeddings")
def e57_scan(spark, sf_dir):
    """Points written as E57 files by the tasks and read back in two stages."""
    from trussline.sources import pointclouds

    pointclouds.register(spark)
    where = scratch_path(spark, "e57")
    at = [F.round(F.col("embedding")[i].cast("double") * 10, 2).alias(a) for i, a in enumerate("xyz")]
    _t(spark, sf_dir, "embeddings").select(*at, (F.col("vec_id") % 200).cast("int").alias("r"), F.lit(255).alias("g"), F.lit(0).alias("b")).write.format("e57").mode("append").save(where)
    back = pointclouds.read_e57(spark, where, origin=(0.0, 0.0, 0.0), swizzle=False)
    return back.select(*[(F.round(F.col(a).cast("double"), 2) + 0.0).alias(a) for a in "xyz"], "r")


@query("SELECT CAST(vec_id % 200 AS SMALLINT) AS r, round(CAST(embedding[1] AS DOUBLE) * 10, 2)::DOUBLE + 0.0 AS x FROM embeddings WHERE round(CAST(embedding[1] AS DOUBLE) * 10, 2) > 0.505 AND round(CAST(embedding[3] AS DOUBLE) * 10, 2) < 1.005")
def las_box(spark, sf_dir):
    """Points in a box, of LAS files dealt by place: the filter leaves out files by their headers."""
    from trussline.sources import pointclouds

    pointclouds.register(spark)
    where = scratch_path(spark, "las")
    at = [F.round(F.col("embedding")[i].cast("double") * 10, 2).alias(a) for i, a in enumerate("xyz")]
    rows = _t(spark, sf_dir, "embeddings").select(*at, ((F.col("vec_id") % 200) * 256).cast("int").alias("r"), F.lit(65280).alias("g"), F.lit(0).alias("b"))
    rows.repartitionByRange("x").write.format("las").mode("append").save(where)
    back = spark.read.format("las").option("path", where).option("swizzle", "false").load().where("x > 0.505 and z < 1.005")
    return back.select("r", (F.round(F.col("x").cast("double"), 2) + 0.0).alias("x"))


@query(_CELLS + """, t AS (SELECT row_name, col_name, CASE WHEN hard THEN CASE WHEN tol_mm IS NULL THEN 'H' ELSE 'H:' || replace(CAST(CAST(tol_mm AS INT) + 0.5 AS VARCHAR), '.', ',') END ELSE replace(CAST(CAST(tol_mm AS INT) + 0.5 AS VARCHAR), '.', ',') END AS t FROM cells),
 r AS (SELECT row_name, min(n_nationkey) AS r FROM t JOIN nation ON n_name = row_name GROUP BY row_name)
 SELECT 0 AS line_no, ';NATION_1;NATION_2;NATION_3' AS line UNION ALL
 SELECT CAST(r.r + 1 AS INT), t.row_name || ';' || """ + " || ';' || ".join(f"coalesce(max(CASE WHEN col_name = 'NATION_{i}' THEN t END), '')" for i in (1, 2, 3)) + " FROM t JOIN r ON t.row_name = r.row_name GROUP BY t.row_name, r.r")
def matrix_text(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("tol_mm", F.col("tol_mm") + 0.5)
    return matrix.matrix_lines(cells, ["NATION_1", "NATION_2", "NATION_3"])


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, own) of regions, their nations, their customers, and the orders of those, as one tree of four levels."""
    level = lambda t, n, key, up, text: _t(spark, sf_dir, t).select((F.col(key).cast("long") * 4 + n).alias("id"), (up.cast("long") * 4 + n - 1).alias("parent"), text.alias("own"))
    none = F.lit(None).cast("long")
    rows = level("region", 0, "r_regionkey", none, F.col("r_name")).unionByName(level("nation", 1, "n_nationkey", F.col("n_regionkey"), F.col("n_name")))
    return rows.unionByName(level("customer", 2, "c_custkey", F.col("c_nationkey"), F.col("c_mktsegment"))).unionByName(level("orders", 3, "o_orderkey", F.col("o_custkey"), F.col("o_orderstatus")))


@query("""WITH r AS (SELECT r_regionkey AS k, r_regionkey * 4 AS id, md5(r_name) AS f FROM region),
 n AS (SELECT n_nationkey AS k, n_nationkey * 4 + 1 AS id, md5(n_name || '|' || coalesce(f, md5('missing'))) AS f FROM nation LEFT JOIN r ON k = n_regionkey),
 c AS (SELECT c_custkey AS k, c_custkey * 4 + 2 AS id, md5(c_mktsegment || '|' || coalesce(f, md5('missing'))) AS f FROM customer LEFT JOIN n ON k = c_nationkey),
 o AS (SELECT o_orderkey * 4 + 3 AS id, md5(o_orderstatus || '|' || coalesce(f, md5('missing'))) AS f FROM orders LEFT JOIN c ON k = o_custkey)
 SELECT id, f AS fingerprint FROM r UNION ALL SELECT id, f FROM n UNION ALL SELECT id, f FROM c UNION ALL SELECT id, f FROM o""")
def structure_digest(spark, sf_dir):
    """Digests of rows that refer to others that refer to others, four levels deep."""
    rows = _tree(spark, sf_dir)
    refs = F.when(F.col("parent").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("parent"))
    return graphs.fingerprints(rows.select("id", "own", refs.alias("refs")))


_PLACES = """WITH r AS (SELECT r_regionkey AS k, r_regionkey * 4 AS id, r_regionkey * 4 + 1.0 AS x, 2.0 AS y FROM region),
 n AS (SELECT n_nationkey AS k, n_nationkey * 4 + 1 AS id, x - 2.0 AS x, y + (n_nationkey * 4 + 2.0) AS y FROM nation JOIN r ON k = n_regionkey),
 c AS (SELECT c_custkey AS k, c_custkey * 4 + 2 AS id, x - (c_custkey * 4 + 3.0) AS x, y - 2.0 AS y FROM customer JOIN n ON k = c_nationkey),
 o AS (SELECT o_orderkey * 4 + 3 AS id, x + 2.0 AS x, y - (o_orderkey * 4 + 4.0) AS y FROM orders JOIN c ON k = o_custkey)"""


@query(_PLACES + " SELECT id, x::DOUBLE AS x, y::DOUBLE AS y FROM r UNION ALL SELECT id, x, y FROM n UNION ALL SELECT id, x, y FROM c UNION ALL SELECT id, x, y FROM o")
def placement_chain(spark, sf_dir):
    """Absolute positions of a tree of placements, each turned by a quarter against the one above."""
    turn = {"xx": 0.0, "yx": -1.0, "zx": 0.0, "xy": 1.0, "yy": 0.0, "zy": 0.0, "oy": 2.0, "xz": 0.0, "yz": 0.0, "zz": 1.0, "oz": 0.0}
    rows = _tree(spark, sf_dir).select("id", "parent", *[(F.col("id") + 1.0 if c == "ox" else F.lit(turn[c])).alias(c) for c in graphs.PLACE])
    return graphs.absolute(rows).select("id", (F.round("ox", 6) + 0.0).alias("x"), (F.round("oy", 6) + 0.0).alias("y"))


@query("""WITH RECURSIVE r(id, part) AS (SELECT o_orderkey, CAST(o_orderkey % 70 AS INT) FROM orders WHERE o_orderkey % 13 = 0 UNION SELECT o_orderkey // 2, part FROM r JOIN orders ON o_orderkey = id WHERE o_orderkey // 2 > 0) SELECT id, part FROM r""")
def model_parts(spark, sf_dir):
    """Everything that the roots of seventy parts need, in one pass; shared rows are in several."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    links = o.select(F.col("id").alias("source"), F.floor(F.col("id") / 2).cast("long").alias("target")).where("target > 0")
    return graphs.parts(links, o.where("id % 13 = 0").select("id", (F.col("id") % 70).cast("int").alias("part")))


@query("""WITH e AS (SELECT user_id AS session_id, event_type || CAST(event_id % 9 AS VARCHAR) AS event, min(ts) AS ts FROM events WHERE event_id % 11 > 1 GROUP BY 1, 2),
 r AS (SELECT user_id AS session_id, min(ts) AS ready FROM events WHERE event_id % 11 = 0 GROUP BY 1),
 f AS (SELECT user_id AS session_id, max(ts) AS failed FROM events JOIN r ON user_id = session_id AND ts <= ready WHERE event_id % 11 = 1 GROUP BY 1),
 h AS (SELECT e.*, ready, e.ts < ready AND (failed IS NULL OR e.ts >= failed) AS held FROM e JOIN r USING (session_id) LEFT JOIN f USING (session_id)),
 s AS (SELECT *, row_number() OVER (PARTITION BY session_id, held ORDER BY ts, event) AS i FROM h)
 SELECT session_id, event, ts, greatest(ts, ready) AS sent_at, CAST(row_number() OVER (PARTITION BY session_id ORDER BY greatest(ts, ready), ts, event) AS INT) AS seq FROM s WHERE ts >= ready OR (held AND i <= 4)""")
def events_delivered(spark, sf_dir):
    """Events that are held back until a session's sink is ready, four at most."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", (F.col("event_id") % 11).alias("k"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("event"))
    signals = e.where("k <= 1").select("session_id", "ts", F.when(F.col("k") == 0, "ready").otherwise("failed").alias("signal"))
    return events.delivered(e.where("k > 1").select("session_id", "ts", "event"), signals, 4)


@query("SELECT o_orderkey * 2 + 1 AS id, 'IFCWALL' AS entity, CAST(o_custkey * 2 AS VARCHAR) AS refs FROM orders UNION ALL SELECT c_custkey * 2, 'IFCBEAM', '' FROM customer")
def step_scan(spark, sf_dir):
    """Records written as STEP text by the tasks and read back in ranges of 64 KB."""
    from trussline.sources import step

    where = scratch_path(spark, "step")
    walls = _t(spark, sf_dir, "orders").select(F.concat(F.lit("#"), F.col("o_orderkey") * 2 + 1, F.lit("=IFCWALL('it''s; #1', /* ; ' */ #"), F.col("o_custkey") * 2, F.lit(",$);")).alias("value"))
    beams = _t(spark, sf_dir, "customer").select(F.concat(F.lit("#"), F.col("c_custkey") * 2, F.lit("= ifcbeam('"), "c_mktsegment", F.lit("');")).alias("value"))
    walls.unionByName(beams).write.mode("append").text(where)
    back = step.read_step(spark, where + "/part-*", 1 << 16)
    return back.select("id", "entity", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))
