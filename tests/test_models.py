import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.functions import geometry as G
from trussline.operators import boxes, clashes, models, solids


def test_extract_of_gaps_and_types(spark):
    elements = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11)], "element long, type_key long")
    props = spark.createDataFrame([(1, "P", "x", "a"), (1, "P", "x", "b"), (2, "P", "x", ""), (4, "Q", "x", "no"), (None, "P", "x", "z"), (3, "P", "y", None)], "owner long, pset string, name string, value string")
    types = spark.createDataFrame([(10, "P", "x", "t"), (11, "P", "y", "u")], "owner long, pset string, name string, value string")
    wanted = [("x", "P", "x"), ("y", "P", "y")]
    got = {r.element: (r.x, r.y) for r in models.extract(elements, props, wanted, types).collect()}
    assert got == {1: ("a", None), 2: ("t", None), 3: (None, None), 4: (None, "u")}
    assert models.extract(elements, props, wanted[:1], complete=True).count() == 1
    assert {r.column: (r.filled, r.rows) for r in models.coverage(models.extract(elements, props, wanted), ["x", "y"]).collect()} == {"x": (1, 4), "y": (0, 4)}
    assert models.extract(elements.limit(0), props, wanted, types).count() == 0


def test_chainage(spark):
    df = spark.createDataFrame([(1234.56,), (0.0,), (-0.004,), (-1234.5,), (999.995,), (float("nan"),), (None,), (1234567.8,)], "m double")
    text = [r[0] for r in df.select(models.chainage_text(F.col("m"))).collect()]
    assert text == ["1+234,56", "0+000,00", "0+000,00", "-1+234,50", "1+000,00", None, None, "1234+567,80"]
    df = spark.createDataFrame([("1+234,56",), (" -1+234.5 ",), ("7+000",), ("1+23,4",), ("12",), (None,)], "t string")
    assert [r[0] for r in df.select(models.chainage_metres(F.col("t"))).collect()] == [1234.56, -1234.5, 7000.0, None, None, None]


def test_edits_in_order_with_conflicts(spark):
    rows = spark.createDataFrame([(1, "", "w"), (2, "B", "w"), (3, None, "x"), (4, "A", "w"), (5, "C", None)], "id int, fire string, kind string")
    wall = F.col("kind") == "w"
    done, log = models.edit(rows, [models.Edit(wall & (F.col("id") > 1), "fire", F.lit("A"), True), models.Edit(wall, "fire", F.lit("E")), models.Edit(F.col("kind") == "x", "fire", F.lit("F"))])
    assert {r.id: r.fire for r in done.collect()} == {1: "E", 2: "A", 3: "F", 4: "A", 5: "C"}
    assert sorted((r.id, r.rule, r.old, r.new, r.action) for r in log.collect()) == [(1, 1, "", "E", "set"), (2, 0, "B", "A", "overwritten"), (3, 2, None, "F", "set")]
    _, log = models.edit(rows, [models.Edit(wall, "fire", F.lit("Z"))])
    assert {(r.id, r.action) for r in log.collect()} == {(1, "set"), (2, "kept"), (4, "kept")}


def test_patch_checks_merge_and_closure(spark):
    e = spark.createDataFrame([("a", "IFCPROXY", "X"), ("b", "IFCPROXY", "Y"), (None, "IFCPROXY", "Z")], "code_of string, ifc_class string, predefined_type string")
    m = spark.createDataFrame([("a", "IfcKerb", "K"), ("a", "IfcWall", "W"), (None, "IfcBad", "B")], "code string, new_class string, new_type string")
    assert sorted((str(r.code_of), r.ifc_class, r.predefined_type, r.patched) for r in models.class_patch(e, m, "code_of").collect()) == [("None", "IFCPROXY", "Z", False), ("a", "IFCKERB", "K", True), ("b", "IFCPROXY", "Y", False)]
    result = models.health_check(e, [models.Check("no code", F.col("code_of").isNull(), "blocking"), models.Check("proxy", F.col("ifc_class") == "IFCPROXY", "note", F.col("predefined_type"))])
    assert {r.check: (r.problems, r.elements) for r in result.collect()} == {"no code": (1, 1), "proxy": (3, 3)} and not models.gate(result).first().deliverable
    assert models.gate(models.health_check(e.limit(0), [models.Check("x", F.lit(True), "blocking")])).first().deliverable
    one = spark.createDataFrame([(1, "g", [2]), (2, "h", None)], "id long, guid string, refs array<bigint>")
    both = models.merge([one, one, one.limit(0)]).orderBy("id").collect()
    assert [(r.model, r.id, r.refs) for r in both] == [(0, 1, [2]), (0, 2, None), (1, 3, [4]), (1, 4, None)] and len({r.guid for r in both}) == 4 and both[0].guid == "g"
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (3, None)], "source long, target long")
    assert {r.id for r in models.closure(links, spark.createDataFrame([(1,), (None,)], "id long")).collect()} == {1, 2, 3}


def test_georeference(spark):
    rows = [("a", 1.0, 0.0, 359.999, 0.0, 5.0, 5.0, 5.0, 5.5), ("b", 0.0, 0.0, 10.0, 20.0, 0.0, 0.0, 9.0, 0.0), ("c", *[None] * 8)]
    got = dict(models.georeference(spark.createDataFrame(rows, "site string, xa double, xo double, rotation double, true_north double, east double, north double, ref_east double, ref_north double")).collect())
    assert got == {"a": "", "b": "degenerate,rotation,origin", "c": "missing"}


def test_samples_are_small_and_alike(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    one, two = ({(r.g, r.id) for r in models.sampled(d, "g", "id", 32).collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 96


def test_orphans_are_matched_again(spark):
    schema = "key string, class string, geometry string, name string, x double, y double, z double, w double"
    old = [("a", "W", "g", "n", 0.0, 0.0, 0.0, 1.0), ("b", "W", "g", "m", 50.0, 0.0, 0.0, 1.0), ("c", "W", "h", "c", 3.0, 0.0, 0.0, 1.0), ("d", "W", "i", "d", 3.0, 0.0, 0.0, 123456.4), ("e", "W", "k", "e", 7.0, 0.0, 0.0, None)]
    new = [("a2", "W", "g", "n", 0.01, 0.0, 0.0, 1.0), ("b2", "W", "g", "other", 50.5, 0.0, 0.0, 1.0), ("d", "W", "i", "d", 3.0005, 0.0, 0.0, 123456.1), ("e", "W", "k", "e", 7.2, 0.0, 0.0, 1.0), ("f", "Q", "h", "c", 3.0, 0.0, 0.0, 1.0)]
    got = {(r.key, r.new_key): (r.change, r.fields) for r in models.matched_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["w"]).collect()}
    assert got == {("a", "a2"): ("recreated", ""), ("b", "b2"): ("proposed", ""), ("c", None): ("removed", ""), ("d", "d"): ("same", ""), ("e", "e"): ("modified", "w,position"), (None, "f"): ("added", "")}


def test_alike_orphans_meet_one_to_one(spark):
    """1,500 identical bolts in one cell under new keys: unmoved, on one spot, and moved by 5 cm; and what is over stays removed."""
    schema = "key string, class string, geometry string, name string, x double, y double, z double"
    at = lambda i: (0.001 + (i % 40) * 0.02, 0.001 + (i // 40) * 0.02, 0.0)
    old = [(f"a{i:04}", "BOLT", "m", "bolt", *at(i)) for i in range(1500)] + [(f"b{i:04}", "BOLT", "m", "bolt", 20.5, 0.0, 0.0) for i in range(1500)] + [(f"c{i:04}", "BOLT", "m", "bolt", 40.0 + at(i)[0], *at(i)[1:]) for i in range(1500)]
    new = [("n" + k, *r, x + (0.05 if k[0] == "c" else 0.0), y, z) for k, *r, x, y, z in old if k not in ("a0007", "b0100")]
    got = models.matched_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), []).collect()
    assert len(got) == 4500 and len({r.key for r in got}) == 4500 and len({r.new_key for r in got}) == 4499
    assert {r.change for r in got if r.new_key and r.key[0] in "ab"} == {"recreated"} and sorted(r.key[0] for r in got if not r.new_key) == ["a", "b"]
    assert all(r.new_key == "n" + r.key for r in got if r.key[0] == "a" and r.new_key)
    # Moved ones meet what is nearest; those at the far end are proposed with what is left at the near one.
    assert sum(r.change == "recreated" for r in got if r.key[0] == "c") > 1300


def test_pairs_of_crowded_cells_grow_with_the_rows(spark):
    """Pairs that two crowded cells form, and the numbers by which alike rows meet."""
    from trussline.operators import assignment

    side = lambda s, n: spark.range(n).select((F.col("id") if s == "o" else F.col("id") + 10**6).alias(f"{s}_key"), F.lit("k").alias(f"{s}_class"), (F.col("id") / n).alias(f"{s}_x"), F.lit(0.5).alias(f"{s}_y"), F.lit(0.5).alias(f"{s}_z"))
    for n in (400, 1600):
        pairs = assignment.neighbours(side("o", n), side("n", n), ["class"], 1.0, 16)
        assert n < pairs.count() <= 3 * 16 * n
        assert {r.n_key - r.o_key for r in assignment.mutual_best(pairs.select("o_key", "n_key", F.lit(0.5).alias("confidence"), "apart")).collect()} == {10**6}
    rows = spark.range(3000).select((F.col("id") % 5 == 0).alias("g"), (-F.col("id")).alias("v"))
    got = assignment.numbered(rows, ["g"], ["v"], "at").collect()
    for g in (True, False):
        ordered = sorted((r.v, r["at"]) for r in got if r.g is g)
        assert [k for _, k in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("radius", [0.0, 0.7])
def test_nearest_surface_of_large_and_small_triangles(spark, radius):
    rng = np.random.default_rng(2)
    t = rng.uniform(-3, 3, (40, 1, 3)) + rng.normal(size=(40, 3, 3)) * np.array([0.05, 40.0])[rng.integers(0, 2, 40)][:, None, None]
    p = rng.uniform(-4, 4, (60, 3))
    p[0] = [500.0, 0, 0]
    names = [f"{v}{x}" for v in "abc" for x in "xyz"]
    tri = spark.createDataFrame([(i, *map(float, r.ravel())) for i, r in enumerate(t)], "tri long, " + ", ".join(f"{n} double" for n in names))
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    got = {r.id: (r.dist, r.tri) for r in clashes.nearest_surface(pts, tri, radius).collect()}
    for i, one in enumerate(p):
        d = np.linalg.norm(G.closest_on_triangle(np.repeat(one[None], 40, 0), t) - one, axis=1)
        if radius and d.min() > radius:
            assert i not in got
        else:
            assert got[i][0] == pytest.approx(d.min()) and d[got[i][1]] == pytest.approx(d.min())
    assert clashes.nearest_surface(pts.limit(0), tri, radius).count() == 0


def test_bounds_and_caps(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan")), (3.0, None, 4.0)], "x double, y double, z double")
    assert tuple(boxes.bounds(df).first()) == (1.0, 2.0, 4.0, 3.0, 2.0, 4.0)
    box = spark.range(20).select(F.col("id").cast("string").alias("key"), *[F.lit(v).alias(f"{a}{i}") for i, v in ((0, 0.0), (1, 1.0)) for a in "xyz"])
    pairs, cut = boxes.capped(boxes.self_join(box), 50)
    assert cut and pairs.count() == 50 and boxes.self_join(box).count() == 190


def test_meshes_by_single_triangles(spark):
    """Crossings and clearances from triangles that meet equal those of whole pairs of meshes."""
    rng = np.random.default_rng(9)
    meshes = {f"m{k}": (rng.uniform(-2, 2, (1, 1, 3)) + rng.normal(size=(6, 3, 3)) * 0.6) for k in range(12)}
    df = spark.createDataFrame([(k, [float(x) for x in t.ravel()]) for k, t in meshes.items()] + [("none", []), ("null", None)], "key string, tris array<double>")
    hard = {(r.key_a, r.key_b): r for r in clashes.hard_meshes(df, df).collect()}
    near = {(r.key_a, r.key_b): r for r in clashes.near_meshes(df, df, 0.4).collect()}
    for a, ta in meshes.items():
        for b, tb in meshes.items():
            want, gap = G.hard_pair(ta, tb), G.clearance_pair(ta, tb, 0.4)
            if a == b or want is None:
                assert (a, b) not in hard
            else:
                r = hard[a, b]
                assert (r.pen, r.overlap, r.n_pairs) == pytest.approx((want["pen"], want["overlap"], want["n_pairs"]))
                np.testing.assert_allclose(r.point, want["point"], atol=1e-9)
                assert r.extent == pytest.approx(want["extent"])
            if a == b or gap is None:
                assert (a, b) not in near
            else:
                assert near[a, b].dist == pytest.approx(gap["dist"], abs=1e-9)
    assert len(hard) > 10 and len(near) > len(hard)


def box(lo, hi):
    """A closed box as twelve triangles."""
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    corner = lambda v: [(hi if v >> (2 - k) & 1 else lo)[k] for k in range(3)]
    return np.array([[corner(v) for v in f] for f in faces], float)


def ball(centre, radius, rng):
    """A closed, bumpy ball."""
    n = 8
    at = lambda i, j: np.array([np.sin(np.pi * i / n) * np.cos(2 * np.pi * j / n), np.sin(np.pi * i / n) * np.sin(2 * np.pi * j / n), np.cos(np.pi * i / n)])
    grid = {(i, j % n): at(i, j) * radius * (rng.uniform(0.8, 1.0) if 0 < i < n else 1) + centre for i in range(n + 1) for j in range(n)}
    grid |= {(i, j): grid[i, 0] for i in (0, n) for j in range(n)}
    tri = [t for i in range(n) for j in range(n) for t in ((grid[i, j], grid[i + 1, j], grid[i + 1, (j + 1) % n]), (grid[i, j], grid[i + 1, (j + 1) % n], grid[i, (j + 1) % n]))]
    return np.array([t for t in tri if np.linalg.norm(np.cross(t[1] - t[0], t[2] - t[0])) > 1e-12])


MESHES = "key string, tris array<double>"


def test_points_inside_by_joins(spark):
    """Points in closed, open and doubled meshes, on faces and corners, as the kernel for one mesh says."""
    rng = np.random.default_rng(12)
    one = box((0, 0, 0), (1, 1, 1))
    solids_ = {"cube": one, "doubled": np.concatenate([one, one]), "no z face": one[4:], "ball": ball(np.array([0.5, 0.5, 0.5]), 0.7, rng), "far": box((50, 0, 0), (9000, 3000, 2))}
    spots = np.concatenate([rng.uniform(-0.5, 1.5, (60, 3)), [[0.5, 0.5, 0.5], [0, 0, 0], [0.5, 0.5, 0], [1, 0.5, 0.5], [0.5, 0.5, -3]], rng.uniform(0, 1, (20, 3)) * [9000, 3000, 4]])
    triangles = spark.createDataFrame([(k, i, *map(float, r.ravel())) for k, t in solids_.items() for i, r in enumerate(t)], "mesh string, tri long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz"))
    points = spark.createDataFrame([(f"{k}:{i}", k, *map(float, p)) for k in [*solids_, "none"] for i, p in enumerate(spots)], "id string, mesh string, x double, y double, z double")
    got = {r.id for r in solids.inside(points, triangles).collect()}
    want = {f"{k}:{i}" for k, t in solids_.items() for i, on in enumerate(G.points_in_mesh(spots, t)) if on}
    assert got == want and len(want) > 20 and solids.inside(points.limit(0), triangles).count() == 0


def test_penetration_by_joins(spark):
    """Crossing and nested meshes, as the kernel for whole pairs says; no mesh travels as a whole."""
    rng = np.random.default_rng(13)
    meshes = {f"b{k}": ball(rng.uniform(0, 3, 3), rng.uniform(0.4, 1.2), rng) for k in range(6)} | {"cube": box((0.3, 0.3, 0.3), (2.7, 2.6, 2.5)), "small": box((1.0, 1.1, 1.2), (1.3, 1.5, 1.6)), "away": box((90, 90, 90), (91, 91, 91))}
    df = spark.createDataFrame([(k, [float(x) for x in t.ravel()]) for k, t in meshes.items()], MESHES)
    got = {(r.key_a, r.key_b): r for r in solids.penetration_meshes(df, df).collect()}
    for (a, b), r in got.items():
        want = G.penetration_pair(meshes[a], meshes[b])
        assert r.measured == want["measured"] and r.pen == pytest.approx(want["pen"], abs=1e-9)
    assert len(got) >= 20 and sum(r.measured for r in got.values()) >= 10 and got["cube", "small"].measured
    assert not any("away" in k for k in got)
    plan = solids.inside(spark.createDataFrame([], "id long, mesh string, x double, y double, z double"), spark.createDataFrame([], "mesh string, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")))
    assert plan.count() == 0


def test_clash_run_with_depth(spark):
    """The depth of hard clashes, and rules whose reach is no other's."""
    meshes = {"a": ("IfcWall", box((0, 0, 0), (4, 0.5, 3))), "b": ("IfcPipe", box((1, -1, 1), (1.25, 0.25, 1.25))), "c": ("IfcDuct", box((1, 3.0, 1), (2, 4, 2))), "d": ("IfcBeam", box((0, 0.75, 0), (4, 1, 1)))}
    elements = spark.createDataFrame([(k, c, [float(x) for x in t.ravel()]) for k, (c, t) in meshes.items()], "key string, ifc_class string, tris array<double>")
    sets = spark.createDataFrame([("IFCWALL",), ("IFCPIPE",), ("IFCDUCT",), ("IFCBEAM",)], "name string")
    rules = spark.createDataFrame([("IFCPIPE", "IFCWALL", "hard", 0.0), ("IFCDUCT", "IFCWALL", "clearance", 5.0), ("IFCBEAM", "IFCWALL", "clearance", 0.2), ("IFCDUCT", "IFCDUCT", "hard", 0.0)], "a_name string, b_name string, type string, tol double")
    got = {(r.key_a, r.key_b): r for r in clashes.clash_run(elements, sets, rules, depth=True).collect()}
    assert set(got) == {("b", "a"), ("c", "a")}
    assert got["c", "a"].value == pytest.approx(2.5) and got["c", "a"].pen is None
    want = G.penetration_pair(meshes["b"][1], meshes["a"][1])
    assert got["b", "a"].measured and got["b", "a"].pen == pytest.approx(want["pen"]) and want["pen"] == pytest.approx(0.25, abs=0.01)


def test_boxes_of_any_size(spark):
    """A box of 1,000 km at a cell of 2 cm goes to a few cells; boxes of very different sizes still meet."""
    from trussline.operators import boxes as B

    big = spark.createDataFrame([("big", *[-500e3] * 3, *[500e3] * 3)], "key string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    cells = B._dealt(B._cells(big, 0.02, F.lit(0.0), "a", (), "xyz"), "a", 0.02, "xyz", None, True)
    assert cells.count() <= 8
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", *map(float, lo), *map(float, lo + size)) for i, (lo, size) in enumerate(zip(rng.uniform(-50, 50, (150, 3)), 10.0 ** rng.uniform(-3, 5, (150, 3)), strict=True))]
    df = spark.createDataFrame(rows, big.schema)
    got = {tuple(sorted((r.key_a, r.key_b))) for r in B.self_join(df, cell=0.02).select("key_a", "key_b").collect()}
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(rows) for b in rows[:i] if all(a[1 + k] <= b[4 + k] and b[1 + k] <= a[4 + k] for k in range(3))}
    assert got == want and len(want) > 500


def test_pieces_follow_a_large_triangle(spark):
    """The boxes of a tilted large triangle hold all of it, and far fewer points than its own box."""
    t = np.array([[0, 0, 0], [800, 0, 700], [0, 800, 650]], float)
    one = spark.createDataFrame([(0, *map(float, t.ravel()))], "tri long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz"))
    parts = [tuple(r) for r in clashes.surface_boxes(one, 1.0, ["tri"]).select(*[f"{x}{i}" for i in "01" for x in "xyz"]).collect()]
    assert 8 < len(parts) <= 36
    rng = np.random.default_rng(3)
    w = rng.dirichlet([1, 1, 1], 500)
    held = lambda p: any(all(q[k] <= p[k] <= q[3 + k] for k in range(3)) for q in parts)
    assert all(map(held, w @ t))
    assert sum(map(held, rng.uniform(0, 1, (1000, 3)) * [800, 800, 700])) < 200
    far = spark.createDataFrame([("x", 100.0, 100.0, 400.0), ("y", *map(float, t.mean(0) + [0, 0, 0.004]))], "id string, x double, y double, z double")
    assert [r.id for r in clashes.nearest_surface(far, one, 0.005).collect()] == ["y"]
