import struct

import numpy as np
import pytest

from trussline.sources import pointclouds as P


def las(path, fmt=3, n=10, shift=0, cut=0, compressed=False):
    size = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}[fmt]
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", bytes([1, 4])
    struct.pack_into("<HI", head, 94, 375, 375)
    head[104] = fmt | (0x80 if compressed else 0)
    struct.pack_into("<HI", head, 105, size, n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, 1.5e6, 0, 0)
    struct.pack_into("<Q", head, 247, n)
    body = bytearray(size * n)
    for i in range(n):
        struct.pack_into("<3i", body, size * i, i, 2 * i, 3 * i)
        if fmt in P.RGB_OFFSET:
            struct.pack_into("<3H", body, size * i + P.RGB_OFFSET[fmt], (i + 1) << shift, 2 << shift, 3 << shift)
    path.write_bytes(bytes(head + body)[: len(head) + len(body) - cut])
    return str(path)


@pytest.mark.parametrize("fmt", [0, 1, 2, 3, 6, 7, 8])
@pytest.mark.parametrize("shift", [0, 8])
def test_las(spark, tmp_path, fmt, shift):
    P.register(spark)
    path = las(tmp_path / "a.las", fmt, shift=shift)
    rows = spark.read.format("las").option("path", path).option("origin", "1500000,0,0").load().orderBy("idx").collect()
    assert len(rows) == 10
    i = 7
    assert (rows[i].x, rows[i].y, rows[i].z) == pytest.approx((0.007, 0.021, -0.014), abs=1e-6)
    assert rows[i].r == (i + 1 if fmt in P.RGB_OFFSET else P.GREY)


def test_las_edges(spark, tmp_path):
    P.register(spark)
    some = spark.read.format("las").option("path", las(tmp_path / "s.las")).option("max_points", 4).load()
    assert sorted(r.idx for r in some.collect()) == [0, 3, 6, 9]
    assert spark.read.format("las").option("path", las(tmp_path / "c.las", cut=34 + 30)).load().count() == 8
    with pytest.raises(ValueError, match="decompressed"):
        P.LasReader({"path": las(tmp_path / "z.las", compressed=True)})
    with pytest.raises(ValueError, match="not a LAS"):
        P.las_header(b"nope" * 100)


def bits(values, width):
    v = np.array(values, np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
    return np.packbits(v.ravel().astype(np.uint8), bitorder="little").tobytes()


def e57(path, page=1024):
    """Two scans with poses; x float32, y float64, z scaled 11-bit, a constant field; streams cut at unlike records."""
    own = page - 4
    logical = bytearray(48)
    physical = lambda at: at // own * page + at % own
    xml, scans = "", []
    for s, n in enumerate((7, 5)):
        x, y, z = np.arange(n, dtype="<f4") + s * 100, np.arange(n, dtype="<f8") * 2, [(i * 37) % 2000 for i in range(n)]
        streams = [x.tobytes(), y.tobytes(), bits(z, 11), b""]
        section = len(logical)
        packets = b""
        for part in (0, 1):
            cuts = [(b[:8], b[8:])[part] if k != 2 else (b[:3], b[3:])[part] for k, b in enumerate(streams)]
            body = struct.pack("<4H", *map(len, cuts)) + b"".join(cuts)
            body += b"\0" * (-(len(body) + 6) % 4)
            packets += struct.pack("<BBHH", 1, 0, len(body) + 5, 4) + body
        packets = struct.pack("<BBHH", 2, 0, 15, 0) + bytes(10) + packets
        logical += struct.pack("<B7xQQQ", 1, 32 + len(packets), physical(section + 32), 0) + packets
        pose = "<pose><rotation><w>0.7071067811865476</w><z>0.7071067811865476</z></rotation><translation><x>10</x></translation></pose>" if s else ""
        xml += f'<vectorChild type="Structure">{pose}<points type="CompressedVector" fileOffset="{physical(section)}" recordCount="{n}"><prototype><cartesianX type="Float" precision="single"/><cartesianY type="Float"/><cartesianZ type="ScaledInteger" minimum="-1000" maximum="1000" scale="0.01" offset="1"/><k type="Integer" minimum="4" maximum="4"/></prototype></points></vectorChild>'
        want = np.stack([x, y, (np.array(z) - 1000) * 0.01 + 1], 1).astype(float)
        scans.append(want if not s else np.stack([-want[:, 1] + 10, want[:, 0], want[:, 2]], 1))
    text = f'<?xml version="1.0"?><e57Root xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><data3D>{xml}</data3D></e57Root>'.encode()
    at = len(logical)
    logical += text
    logical[:48] = b"ASTM-E57" + struct.pack("<IIQQQQ", 1, 0, 0, physical(at), len(text), page)
    logical += bytes(-len(logical) % own)
    path.write_bytes(b"".join(bytes(logical[i : i + own]) + b"CRC!" for i in range(0, len(logical), own)))
    return str(path), np.concatenate(scans)


@pytest.mark.parametrize("page", [64, 1024])
def test_e57(spark, tmp_path, page):
    P.register(spark)
    path, want = e57(tmp_path / "a.e57", page)
    assert P.e57_point_count(path) == 12
    rows = spark.read.format("e57").option("path", path).option("origin", "0,0,0").option("swizzle", "false").load().orderBy("idx").collect()
    np.testing.assert_allclose([(r.x, r.y, r.z) for r in rows], want, atol=1e-4)
    assert [r.idx for r in rows] == list(range(12)) and {r.r for r in rows} == {P.GREY}
    some = spark.read.format("e57").option("path", path).option("max_points", 6).load()
    assert sorted(r.idx for r in some.collect()) == [0, 2, 4, 6, 8, 10]
    auto = spark.read.format("e57").option("path", path).option("swizzle", "false").load().orderBy("idx").first()
    assert (auto.x, auto.y) == (0.0, 0.0) and auto.z == pytest.approx(0.0)


@pytest.mark.parametrize("part", [1, 3, 100])
def test_e57_ranges_of_records(tmp_path, monkeypatch, part):
    """A scan is split inside packets and bytes; every range gives its own records."""
    monkeypatch.setattr(P, "PART", part)
    path, want = e57(tmp_path / "a.e57")
    reader = P.E57Reader({"path": path, "origin": "0,0,0", "swizzle": "false"})
    parts = reader.partitions()
    assert len(parts) == -(-7 // part) + -(-5 // part)
    assert not hasattr(reader, "index")
    got = np.concatenate([np.stack([b.column(i).to_numpy() for i in range(4)], 1) for p in parts for b in reader.read(p)])
    np.testing.assert_allclose(got[np.argsort(got[:, 0]), 1:], want, atol=1e-4)
    assert sorted(got[:, 0]) == list(range(12))


def test_las_files_of_a_folder(spark, tmp_path):
    P.register(spark)
    las(tmp_path / "b.las", 2, n=4)
    las(tmp_path / "a.las", 3, n=3)
    (tmp_path / "notes.txt").write_text("no points")
    for path in (str(tmp_path), tmp_path.as_uri(), f"{tmp_path}/*.las", f"{tmp_path}/[ab].las"):
        rows = spark.read.format("las").option("path", path).option("origin", "1500000,0,0").load().orderBy("idx").collect()
        assert [r.idx for r in rows] == list(range(7)) and [round(r.x * 1000) for r in rows] == [0, 1, 2, 0, 1, 2, 3]
    assert spark.read.format("las").option("path", f"{tmp_path}/none*.las").load().count() == 0


def test_las_round_trip(spark, tmp_path):
    P.register(spark)
    rng = np.random.default_rng(1)
    points = [(float(x), float(y), float(z), int(r), 0, 65280) for x, y, z, r in zip(*rng.uniform(-500, 500, (3, 300)), rng.integers(0, 200, 300) << 8, strict=True)]
    df = spark.createDataFrame([*points, (float("nan"), 0.0, 0.0, 0, 0, 0), (None, 0.0, 0.0, 0, 0, 0)], "x double, y double, z double, r int, g int, b int").repartition(3)
    for _ in range(2):
        df.write.format("las").mode("append").save(f"{tmp_path}/out")
    back = spark.read.format("las").option("path", f"{tmp_path}/out").option("swizzle", "false").load().collect()
    assert len(back) == 600  # the second write leaves the first one's files
    df.where("x < 0").write.format("las").mode("overwrite").save(f"{tmp_path}/out")
    back = spark.read.format("las").option("path", f"{tmp_path}/out").option("swizzle", "false").load().collect()
    assert len(back) == sum(p[0] < 0 for p in points)
    df.where("x >= 0").write.format("las").mode("append").save(f"{tmp_path}/out")
    back = spark.read.format("las").option("path", f"{tmp_path}/out").option("swizzle", "false").load().collect()
    assert len(back) == 300
    near = lambda rows: sorted((round(a, 2), round(b, 2), round(c, 2)) for a, b, c in rows)
    np.testing.assert_allclose(near((r.x, r.y, r.z) for r in back), near(p[:3] for p in points), atol=0.02)
    assert {r.b for r in back} == {255} and {r.r for r in back} == {p[3] >> 8 for p in points}


def test_las_commit_knows_its_own_files(tmp_path):
    """What failed tasks of a write have left goes; files of other writes and other kinds stay."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("x double, y double, z double")
    first, second = (P.LasWriter({"path": str(tmp_path)}, schema) for _ in range(2))
    for w, names in ((first, ["a", "b"]), (second, ["c", "d"])):
        for n in names:
            (tmp_path / f"{w.mark}{n}.las").write_bytes(b"")
    (tmp_path / "part-notes.txt").write_text("")
    second.commit([P.Written([f"{second.mark}c.las"]), None])
    left = {p.name for p in tmp_path.iterdir()}
    assert left == {f"{first.mark}a.las", f"{first.mark}b.las", f"{second.mark}c.las", "part-notes.txt"}
    first.abort([None])
    assert {p.name for p in tmp_path.iterdir()} == {f"{second.mark}c.las", "part-notes.txt"}
    third = P.LasWriter({"path": str(tmp_path)}, schema, overwrite=True)
    third.commit([])
    assert {p.name for p in tmp_path.iterdir()} == {"part-notes.txt"}


def test_filters_leave_out_ranges_and_files(spark, tmp_path, monkeypatch):
    """Filters on idx and on coordinates decide which partitions there are; the rows are those of a filter after the scan."""
    P.register(spark)
    for k in range(3):
        xyz = np.stack([np.arange(50) * 0.01 + 100 * k, np.full(50, 5.0), np.arange(50) * 0.1], 1)
        (tmp_path / f"{k}.las").write_bytes(P.las_bytes(xyz, np.zeros((50, 3)), 0.001))
    read = lambda: spark.read.format("las").option("path", str(tmp_path)).load()
    everything = read().collect()
    for text in ("idx >= 60 and idx < 70", "idx = 149", "idx in (3, 5)", "x > 150", "x between 99 and 101", "z < -100", "y > 4.85 and x < 50", "idx > 1000"):
        frame = read().where(text)
        want = spark.createDataFrame(everything, frame.schema).where(text).collect()
        assert sorted(frame.collect()) == sorted(want)
    monkeypatch.setattr(P, "PART", 20)

    def parts(*filters):
        reader = P.LasReader({"path": str(tmp_path)})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [(p.file, p.first, p.end) for p in reader.partitions()]

    assert len(parts()) == 9
    assert parts(P.GreaterThanOrEqual(("idx",), 60), P.LessThan(("idx",), 70)) == [(1, 10, 21)]
    assert [p[0] for p in parts(P.GreaterThan(("x",), 150.0))] == [2, 2, 2]
    assert parts(P.LessThan(("z",), -100.0)) == [(0, 0, 0)] == parts(P.EqualTo(("idx",), 5000))


def test_info_reads_headers_only(spark, tmp_path):
    """Points and boxes of files without their records: also of files that end after the header."""
    P.register(spark)
    las(tmp_path / "a.las", 2, n=10, cut=260)
    las(tmp_path / "b.las", 2, n=7)
    rows = spark.read.format("las").option("path", str(tmp_path)).option("info", "true").load().orderBy("file").collect()
    assert [(r.file.rpartition("/")[2], r.points) for r in rows] == [("a.las", 10), ("b.las", 7)]
    e57(tmp_path / "c.e57")
    rows = spark.read.format("e57").option("path", str(tmp_path)).option("info", "true").load().collect()
    assert sorted((r.part, r.points) for r in rows) == [(0, 7), (1, 5)]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_e57_in_two_stages(spark, tmp_path, size):
    """Ranges found by one walk over the packets, decoded from where they start, across files and scans."""
    (tmp_path / "in").mkdir()
    _, want = e57(tmp_path / "in" / "a.e57")
    e57(tmp_path / "in" / "b.e57", 64)
    got = P.read_e57(spark, str(tmp_path / "in"), origin=(0.0, 0.0, 0.0), swizzle=False, size=size).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(24))
    np.testing.assert_allclose([(r.x, r.y, r.z) for r in got], np.concatenate([want, want]), atol=1e-4)
    some = P.read_e57(spark, str(tmp_path / "in"), max_points=6, size=size)
    whole = spark.read.format("e57").option("path", str(tmp_path / "in")).option("max_points", 6).load()
    assert sorted(some.collect()) == sorted(whole.collect()) and some.count() == 6
    with P._open(str(tmp_path / "in" / "a.e57")) as f:
        ranges = list(P.chunks(f, 1024, P.e57_scans(f)[0], size))
    assert [r[:2] for r in ranges] == [(i, min(i + size, 7)) for i in range(0, 7, size)] and (size > 3 or len({r[2].at for r in ranges}) > 1)


def test_e57_round_trip(spark, tmp_path):
    """What is written is read back, by both readers; pages end in their CRC-32C."""
    P.register(spark)
    rng = np.random.default_rng(7)
    points = [(float(x), float(y), float(z), int(r), 7, 255) for x, y, z, r in zip(*rng.uniform(-500, 500, (3, 6000)), rng.integers(0, 256, 6000), strict=True)]
    df = spark.createDataFrame(points, "x double, y double, z double, r int, g int, b int").coalesce(1)
    for _ in range(2):
        df.write.format("e57").mode("append").save(f"{tmp_path}/out")
    want = sorted((np.float32(p[0]), *p[3:]) for p in points * 2)
    back = spark.read.format("e57").option("path", f"{tmp_path}/out").option("origin", "0,0,0").load()
    again = P.read_e57(spark, f"{tmp_path}/out", origin=(0.0, 0.0, 0.0), size=1000)
    for frame in (back, again):
        assert sorted((np.float32(r.x), r.r, r.g, r.b) for r in frame.collect()) == want
    assert spark.read.format("e57").option("path", f"{tmp_path}/out").option("origin", "0,0,0").load().where("idx between 5990 and 6009").count() == 20
    # The check value of the public definition.
    assert P._checksums(np.frombuffer(b"123456789", np.uint8)[None]).tobytes().hex() == "e3069283"
