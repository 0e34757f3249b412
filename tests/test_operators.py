import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.functions import geometry as G
from trussline.plans import ids
from trussline.operators import boxes, catalogue, clashes, events, matrix, quantities


def cube(at=(0, 0, 0), size=1.0):
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float) * size + np.array(at)
    f = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    return np.array([[v[i] for i in t] for t in f])


def test_quantities(spark):
    rows = [("A10", {"area": 1.0}), ("A2", {"area": float("nan")}), ("a1", {"area": 2.5, "length": 1.0}), ("", {}), (None, {"area": float("inf")})]
    df = spark.createDataFrame(rows, "group_key string, qty map<string,double>")
    out = quantities.aggregate(df, "group_key", {c: quantities.quantity(c) for c in quantities.STANDARD})
    assert quantities.used_columns(out, quantities.STANDARD) == ["length", "area"]
    got = {(r.key, r.is_total): (r.n, r.sum_area, r.have_area) for r in out.collect()}
    assert got == {("A10", False): (1, 1.0, 1), ("A2", False): (1, 0.0, 0), ("a1", False): (1, 2.5, 1), ("", False): (2, 0.0, 0), (None, True): (5, 3.5, 2)}
    lines = [r.line for r in quantities.csv_lines(out, ["length", "area"]).orderBy("line_no").collect()]
    assert lines == ["Gruppo;N;length;area", "a1;1;1;2,5", "A2;1;;", "A10;1;;1", "(no value);2;;", "TOTAL;5;1;3,5"]


_ROW = {"ifc_type": "IFCWALL", "predefined_type": "SOLID", "name": "w", "global_id": "g"}
_SCHEMA = """ifc_type string, predefined_type string, name string, global_id string, attributes map<string,string>, psets map<string,map<string,struct<value:string,dataType:string>>>,
 classifications array<struct<system:string,value:string>>, materials array<string>, part_of array<struct<relation:string,wholeType:string,wholePredefinedType:string>>"""
_VALUE = "<value><simpleValue>A</simpleValue></value>"
_SUBJECT = {
    "attribute": "<name><simpleValue>Tag</simpleValue></name>" + _VALUE, "property": "<propertySet><simpleValue>P</simpleValue></propertySet><baseName><simpleValue>x</simpleValue></baseName>" + _VALUE,
    "classification": "<system><simpleValue>U</simpleValue></system>" + _VALUE, "material": _VALUE, "partOf": "<entity><name><simpleValue>IFCSITE</simpleValue></name></entity>",
}
_HOLDS = {
    "attribute": lambda v: {"attributes": {"Tag": v}}, "property": lambda v: {"psets": {"P": {"x": (v, "IfcLabel")}}}, "classification": lambda v: {"classifications": [("U", v)]},
    "material": lambda v: {"materials": [v]}, "partOf": lambda v: {"part_of": [("IFCRELAGGREGATES", "IFCSITE" if v == "A" else v, None)]},
}


def _rule(kind, inner, cardinality="required"):
    return f"<ids><specifications><specification name='s'><applicability><entity><name><simpleValue>IFCWALL</simpleValue></name></entity></applicability><requirements><{kind} cardinality='{cardinality}'>{inner}</{kind}></requirements></specification></specifications></ids>"


def test_rule_cardinalities(spark):
    """Facets x required, optional, prohibited x absent, empty, wrong, right: the code of the reason, '' for a pass."""
    want = {"required": ("missing", "badValue", "badValue", ""), "optional": ("", "badValue", "badValue", ""), "prohibited": ("", "", "", "prohibited")}
    for kind, inner in _SUBJECT.items():
        rows = [{**_ROW, "global_id": str(i), **(_HOLDS[kind](v) if v is not None else {})} for i, v in enumerate((None, "", "B", "A"))]
        views = spark.createDataFrame(rows, _SCHEMA)
        for cardinality, codes in want.items():
            specs = ids.parse_ids(_rule(kind, inner, cardinality)).specs
            got = {r.global_id: r.reasons[0].code if r.reasons else "" for r in ids.evaluate(views, specs).collect()}
            assert tuple(got[str(i)] for i in range(4)) == codes, (kind, cardinality)


def test_rule_values(spark):
    """Numbers without a decimal comma, exact keys, patterns as the engine that runs them takes them, and lengths in UTF-16 units."""
    simple, restriction = "<value><simpleValue>{}</simpleValue></value>".format, "<value><restriction>{}</restriction></value>".format
    cases = [
        (simple("0.3"), "0.30", True), (simple("1.5"), "1,5", False), (simple("1e2"), " 100\t", True), (simple("0"), " ", True), (simple("a"), "A", False), (restriction("<minInclusive value='1'/>"), "1,5", False),
        (restriction("<minInclusive value='1'/>"), "x", False), (restriction("<minExclusive value='1'/><maxInclusive value='2'/>"), "2.0", True), (restriction("<pattern value='abc'/>"), "abc\n", False),
        (restriction("<pattern value='\\p{N}+'/>"), "abc", False), (restriction("<pattern value='\\p{N}+'/>"), "12", True), (restriction("<pattern value='(?P&lt;x&gt;a)'/>"), "zzz", True), (restriction("<pattern value='('/>"), "zzz", True),
        (restriction("<enumeration value='5'/><enumeration value='b'/>"), "5.0", True), (restriction("<length value='2'/>"), "😀", True), (restriction("<maxLength value='1'/>"), "😀", False),
    ]
    for inner, value, ok in cases:
        views = spark.createDataFrame([{**_ROW, "attributes": {"Tag": value}}], _SCHEMA)
        (got,) = ids.evaluate(views, ids.parse_ids(_rule("attribute", "<name><simpleValue>Tag</simpleValue></name>" + inner)).specs).collect()
        assert got.passed == ok, (inner, value)
    views = spark.createDataFrame([{**_ROW, "attributes": {"01": "v"}, "psets": {"1.0": {"2": ("", "x"), "3": ("w", "x")}}}], _SCHEMA)
    name = lambda tag, v: f"<{tag}><simpleValue>{v}</simpleValue></{tag}>"
    listed = lambda tag, v: f"<{tag}><restriction><enumeration value='{v}'/></restriction></{tag}>"
    for kind, inner, ok in [("attribute", name("name", "1"), False), ("attribute", listed("name", "1"), True), ("property", name("propertySet", "1") + name("baseName", "3"), False), ("property", name("propertySet", "1.0") + name("baseName", "3"), True)]:
        assert ids.evaluate(views, ids.parse_ids(_rule(kind, inner)).specs).first().passed == ok, inner
    (r,) = ids.evaluate(views, ids.parse_ids(_rule("property", name("propertySet", "1.0") + "<baseName><restriction><pattern value='[0-9]'/></restriction></baseName>" + restriction("<minLength value='2'/><maxExclusive value='1.5'/>"))).specs).first().reasons
    assert (r.label, r.expected, r.got) == ("1.0.pattern: [0-9]", "minLength=2, <1.5", "w")


def test_matrix(spark):
    m = matrix.parse_matrix(spark, ";Walls;Pipes\r\nWalls;H;50\r\nPipes;H:5;-\r\n")
    rules = {(r.a_name, r.b_name): (r.type, r.tol_mm, r.tol) for r in matrix.matrix_rules(m.cells).collect()}
    assert rules == {("Walls", "Walls"): ("hard", 1.0, 0.001), ("Pipes", "Walls"): ("hard", 5.0, 0.005)}
    grid = {r.row_name: (r.Walls, r.Pipes) for r in matrix.matrix_grid(m.cells, m.cols).collect()}
    assert grid == {"Walls": ("H", "50"), "Pipes": ("H:5", None)}
    bad = matrix.parse_matrix(spark, ";A\nB;0\nC;-5\nD;H:-1\nE;foo\n;7\nF;x : 2")
    assert sorted(r.line for r in bad.errors.collect()) == [2, 3, 4, 5, 6]
    assert [(r.row_name, r.tol_mm) for r in bad.cells.collect()] == [("F", 2.0)]
    assert [r.line for r in matrix.parse_matrix(spark, "").errors.collect()] == [0]


def brute_boxes(a, b, grow):
    hit = lambda p, q: all(p[i] <= q[i + 3] + grow and q[i] - grow <= p[i + 3] for i in range(3))
    return sorted((x[0], y[0]) for x in a for y in b if x[0] != y[0] and hit(x[1:], y[1:]))


@pytest.mark.parametrize("grow", [0.0, 0.3])
def test_boxes(spark, grow):
    rng = random.Random(3)

    def some(n, tag):
        out = []
        for i in range(n):
            at, size = [rng.randrange(-40, 40) / 4 for _ in range(3)], rng.choice([0.0, 0.25, 1, 30, 200])
            out.append((f"{tag}{i}", *map(float, at), *(float(x + size) for x in at)))
        return out

    a, b = some(60, "a"), [*some(60, "b"), ("a1", *map(float, (0, 0, 0, 1, 1, 1)))]
    schema = "key string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    broken = ("n", float("nan"), *[0.0] * 5)
    got = boxes.box_join(spark.createDataFrame([*a, broken], schema), spark.createDataFrame(b, schema), inflate=grow)
    assert sorted((r.key_a, r.key_b) for r in got.collect()) == brute_boxes(a, b, grow)


def test_kernels():
    hard = G.hard_pair(cube(), cube((0.9, 0.3, 0.3)))
    assert hard["pen"] == pytest.approx(0.3) and hard["overlap"] == pytest.approx(0.1)
    assert G.hard_pair(cube((1, 1, 1)), cube(size=3)) is None
    assert G.clearance_pair(cube((1, 1, 1)), cube(size=3), 2)["dist"] == pytest.approx(1)
    assert G.clearance_pair(cube(), cube((1.25, 0, 0)), 0.5)["dist"] == pytest.approx(0.25)
    assert G.clearance_pair(cube(), cube((1.25, 0, 0)), 0.25) is None
    assert G.penetration_pair(cube(), cube((0.9, 0.3, 0.3)))["pen"] == pytest.approx(0.1)
    assert G.point_in_mesh((0.5, 0.5, 0.5), cube()) and not G.point_in_mesh((1.5, 0.5, 0.5), cube())
    assert G.point_in_mesh((0.5, 0.5, 0.5), np.concatenate([cube(), cube()]))
    t = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]], float)
    assert G.intersect(t, t + [0.1, 0.1, 0])[0][0] == 2 and G.intersect(t, t + [0, 0, 1])[0][0] == 0
    assert G.intersect(t, np.zeros((1, 3, 3)))[0][0] == 0


def test_distances_against_samples():
    rng = np.random.default_rng(5)
    a, b = rng.random((40, 3, 3)), rng.random((40, 3, 3)) + [0.5, 0, 0.2]
    d, pa, pb = G.distance(a, b)
    w = rng.dirichlet(np.ones(3), 3000)
    for k in range(40):
        p, q = w @ a[k], w[::-1] @ b[k]
        least = G.closest_on_triangle(p, np.repeat(b[k][None], len(p), 0))
        assert d[k] <= np.linalg.norm(least - p, axis=1).min() + 1e-9
        assert np.linalg.norm(pa[k] - pb[k]) == pytest.approx(d[k], abs=1e-9)
        assert G.closest_on_triangle(q[:1], a[k][None]).shape == (1, 3)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    pts, tri = rng.random((60, 3)) * 3, rng.random((50, 3, 3)) * 0.4 + rng.random((50, 1, 3)) * 3
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    tris = spark.createDataFrame([(i, *map(float, t.ravel())) for i, t in enumerate(tri)], "tri long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz"))
    d, k, _ = G.point_mesh(pts, tri)
    got = {r.id: (r.tri, r.dist) for r in clashes.nearest_surface(points, tris, 0.3).collect()}
    assert set(got) == {i for i in range(60) if d[i] <= 0.3}
    assert all(got[i][0] == k[i] and got[i][1] == pytest.approx(d[i]) for i in got)


def test_clash_pairs(spark):
    meshes = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in (("a", cube()), ("b", cube((0.9, 0.3, 0.3))), ("c", cube((5, 5, 5))))], "key string, tris array<double>")
    hits = clashes.hard_meshes(meshes, meshes).collect()
    assert {(r.key_a, r.key_b) for r in hits} == {("a", "b"), ("b", "a")}


def test_catalogue(spark):
    rules = [("P-1*", None, "pier", None, None), ("*TRV*", None, "beam", 20.0, None), ("P-12", "primaria", "special", 5.0, None), (None, "primaria", "pier", None, None), ("/^Q[0-9]+$/", "secondaria", "other", None, None)]
    codes = spark.createDataFrame([("P-12",), ("P-13.TRV",), ("X.TRV-2",), ("Q7",), ("zzz",), (None,)], "code string")
    got = {r.code: (r.tipologia, r.tol_mm) for r in catalogue.lookup(codes, spark.createDataFrame(rules, catalogue.COLUMNS)).collect()}
    assert got == {"P-12": ("special", 5.0), "P-13.TRV": ("pier", 70.0), "X.TRV-2": ("beam", 20.0), "Q7": ("other", 100.0), "zzz": (None, None), None: (None, None)}


def test_events(spark):
    e = spark.createDataFrame([("s", 2, "btnWalk"), ("s", 1, "btnWalk"), ("s", 3, "nope")], "session_id string, ts long, element_id string")
    f = spark.createDataFrame([("s", 4, "a.IFC", None), ("s", 5, "m.csv", "fileClashMtx"), ("s", 6, "m.csv", None)], "session_id string, ts long, file_name string, element_id string")
    got = {(r.event, r.ts) for r in events.first_of_session(events.session_events(e, f)).collect()}
    assert got == {("walk", 1), ("ifc-open", 4), ("clash-matrix-load", 5)}


def test_stream_once(spark, tmp_path):
    from trussline.streaming.events import once_per_session

    src = spark.createDataFrame([("s", "2024-01-01 00:00:00", "walk"), ("s", "2024-01-01 00:01:00", "walk"), ("t", "2024-01-01 00:00:00", "walk")], "session_id string, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = once_per_session(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("once").count() == 2


@pytest.mark.parametrize(("sep", "decimal"), [(";", None), (",", None), (";", ".")])
def test_matrix_text_round_trip(spark, sep, decimal):
    """Fractions, names with separators and quotes, and empty cells come back as they were."""
    cells = [("Walls", "Pipes", "hard", 2.5, 0, 0), ("Walls", "Ducts; \"A\"", "clearance", 50.0, 0, 1), ("B, C", "Pipes", "hard", None, 1, 0)]
    df = spark.createDataFrame(cells, "row_name string, col_name string, type string, tol_mm double, r int, c int")
    lines = [r.line for r in matrix.matrix_lines(df, ["Pipes", "Ducts; \"A\""], sep, decimal).orderBy("line_no").collect()]
    assert len(lines) == 3
    if decimal is None:
        assert ("2,5" in lines[1]) == (sep == ";")
    back = matrix.parse_matrix(spark, "\r\n".join(lines) + "\r\n")
    assert back.errors.count() == 0
    assert {tuple(r)[:4] for r in back.cells.collect()} == {c[:4] for c in cells}


def test_boxes_alike_meet_as_one(spark):
    """Copies of a box go through the grid as lists of keys, are paired in full, and no cells are broadcast."""
    rows = [(f"k{i:04}", float(i % 2) * 10) for i in range(600)]
    b = spark.createDataFrame(rows, "key string, x0 double").select("key", "x0", *[F.lit(0.0).alias(c) for c in ("y0", "z0")], (F.col("x0") + 1).alias("x1"), *[F.lit(1.0).alias(c) for c in ("y1", "z1")])
    assert sorted(len(r.key) for r in boxes.packed(b, "key").collect()) == [44, 44, 256, 256]
    for got, n in ((boxes.box_join(b, b, alike=True), 2 * 300 * 299), (boxes.self_join(b), 300 * 299)):
        pairs = got.select("key_a", "key_b").collect()
        assert len(pairs) == len(set(pairs)) == n
        assert all(int(p.key_a[1:]) % 2 == int(p.key_b[1:]) % 2 and p.key_a != p.key_b for p in pairs)
    plan = boxes.box_join(b, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 2


@pytest.mark.parametrize("name", ["box_join", "box_join_inflated", "box_self_join", "overlap_depth"])
def test_box_queries_pack(spark, name):
    from trussline.plans import catalogue as plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(key_a" in plan and "collect_list(key_b" in plan and plan.count("rightHint=(strategy=merge)") >= 2


def test_meshes_alike_are_one_shape(spark):
    """Hundreds of copies of two crossing cubes and one apart: checked as three shapes, given out to all pairs."""
    kinds = [cube().ravel().tolist(), cube((0.5, 0.25, 0.125)).ravel().tolist(), cube((1.75, 0.25, 0.125)).ravel().tolist()]
    left = spark.createDataFrame([(f"a{i:03}", kinds[0]) for i in range(300)], "key string, tris array<double>")
    right = spark.createDataFrame([(f"b{i:03}", kinds[1 + i % 2]) for i in range(300)], "key string, tris array<double>")
    shapes, _ = clashes.shaped(left, right)
    assert [s.count() for s in shapes] == [1, 2]
    hard = clashes.hard_meshes(left, right).collect()
    assert {(r.key_a, r.key_b) for r in hard} == {(f"a{i:03}", f"b{k:03}") for i in range(300) for k in range(0, 300, 2)} and len(hard) == 300 * 150
    assert {r.overlap for r in hard} == {0.5}
    near = clashes.near_meshes(left, right, 0.8).collect()
    assert len(near) == 300 * 300 and {r.dist for r in near if int(r.key_b[1:]) % 2} == {0.75}
    # A mesh has nothing with itself, but its copies have with each other.
    own = spark.createDataFrame([("s0", kinds[0]), ("s1", kinds[0]), ("s2", kinds[1])], "key string, tris array<double>")
    assert {(r.key_a, r.key_b) for r in clashes.near_meshes(own, own, 0.1).collect()} == {(f"s{i}", f"s{k}") for i in range(3) for k in range(3) if i != k}


def test_clash_counts(spark):
    """Counts by the product of names' rows equal a count of all pairs: repeated names and keys, nulls, and names that hold the separator."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, None]), rng.choice(["a", "b", "a|b", "b|c", "c", "", None]), rng.choice([1, 2, 3, 4, 5, None])) for _ in range(120)]
    want = {}
    for r, x, k in rows:
        for r2, y, k2 in rows:
            if r is not None and r == r2 and None not in (k, k2) and k != k2:
                both = [v for v in (x, y) if v is not None]
                name = "|".join([*([min(both), max(both)] if both else []), f"r{r}"])
                want[name] = want.get(name, 0) + 1
    got = matrix.clash_counts(spark.createDataFrame(rows, "rule int, name string, key long")).collect()
    assert {r.clash: r.n for r in got} == want and len(got) == len(want)
    plan = matrix.clash_counts(spark.createDataFrame([(1, f"n{i}", i) for i in range(9)], "rule int, name string, key long"))
    assert plan.count() == 36


def test_nearest_starts_small(spark, monkeypatch):
    """A radius that holds thousands of triangles a point starts smaller, copies of a triangle go as one, and the nearest ones are those of brute force."""
    rng = np.random.default_rng(3)
    p, t = rng.normal(size=(3000, 3)), np.repeat(rng.normal(size=(1500, 3)), 2, 0)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    solid = spark.createDataFrame([(i, *map(float, [*x, *x, *x])) for i, x in enumerate(t)], "tri long, " + ", ".join(f"{c} double" for c in clashes._CORNERS))
    radii, within = [], clashes._within
    monkeypatch.setattr(clashes, "FEW", 0)
    monkeypatch.setattr(clashes, "PAIRS", 4)
    monkeypatch.setattr(clashes, "_within", lambda a, b, r, by: radii.append((r, b.count())) or within(a, b, r, by))
    far = np.linalg.norm(p[:, None] - t[None], axis=2)
    for most in (0.5, 0.0):
        got = {r.id: (r.tri, r.dist) for r in clashes.nearest_surface(points, solid, most).collect()}
        assert set(got) == {i for i in range(3000) if not most or far[i].min() <= most}
        assert all(got[i][0] == far[i].argmin() and abs(got[i][1] - far[i].min()) < 1e-12 for i in got)
    assert all(n == 1500 for _, n in radii) and radii[0][0] < 0.5 and len(radii) > 2
