import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.operators import events, graphs
from trussline.sources import step
from trussline.streaming import events as streams

MODEL = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION(('a; b #9=IFCWALL();','it''s'),'2;1');
ENDSEC;
DATA;
#1=IFCPERSON('O''Neil; #7',$,.T.);
/* a comment; with 'quotes and #8=IFCDOOR(); */
#2= IFCWALL('g2',#1,(#3,#1),'/* no comment */');
#3=IFCPOINT((1.5,-2.E-3))/**/;  #4 = ifcdoor ( 'x/*y' , #2/* in
 between ; */,#3 ) ;
#5=(IFCLENGTH()IFCNAMED(*)SI(.MILLI.));
#6=IFCEMPTY();
ENDSEC;
END-ISO-10303-21;
"""
WANT = [(1, "IFCPERSON", []), (2, "IFCWALL", [1, 3, 1]), (3, "IFCPOINT", []), (4, "IFCDOOR", [2, 3]), (5, "", []), (6, "IFCEMPTY", [])]


def test_any_split_gives_the_same_records(tmp_path):
    """Borders inside strings, comments, doubled quotes and the two bytes that begin or end a comment."""
    path = tmp_path / "m.ifc"
    path.write_text(MODEL)
    n = len(MODEL.encode())
    for size in [*range(1, 40), 97, n, 10 * n]:
        got, state = [], step.PLAIN
        with open(path, "rb") as f:
            for first in range(0, n, size):
                end = min(first + size, n)
                got += [(i, e, r) for i, e, _, r in step.records(f, first, end, state)]
                f.seek(first)
                state = step.walk(f.read(end - first), state)
        assert got == WANT, size


def test_states_compose():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"'/*;a#") for _ in range(rng.randrange(0, 30)))
        cut = rng.randrange(0, len(data) + 1)
        for s in range(5):
            slow = s
            for byte in data:
                slow = step._STEPS[slow].get(byte, step._AFTER[slow])
            assert step.walk(data, s) == slow == step.walk(data[cut:], step.walk(data[:cut], s)) == step.ends(data, s)[1]


def test_a_range_reads_little_beyond_its_end():
    """A range of 64 KB in a large file takes its own bytes and the end of one record, not a MB."""
    import io

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    f = Counted(b"".join(b"#%d=IFCWALL('it''s; #1', /* ; ' */ #%d,$);\n" % (i, i + 1) for i in range(1, 100_000)))
    rows = list(step.records(f, 0, 1 << 16, step.PLAIN))
    assert len(rows) > 1000 and f.taken < (1 << 16) + (1 << 14)


def test_ranges_are_dealt_to_several_tasks(spark, tmp_path):
    (tmp_path / "b.ifc").write_text("".join(f"#{i}=IFCX('{i};',#{i - 1});\n" for i in range(1, 20_000)))
    found = step.read_step(spark, str(tmp_path), 1 << 12)
    assert found.select(F.spark_partition_id()).distinct().count() > 1 and found.count() == 19_999


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_read_step(spark, tmp_path, monkeypatch, size):
    (tmp_path / "a.ifc").write_text(MODEL)
    (tmp_path / "b.ifc").write_text("".join(f"#{i}=IFCX('{i};',#{i - 1});\n" for i in range(1, 200)))
    (tmp_path / "c.ifc").write_text("")
    got = sorted((r.file[-5:], r.id, r.entity, r.refs) for r in step.read_step(spark, str(tmp_path), size).collect())
    assert got == sorted([("a.ifc", *w) for w in WANT] + [("b.ifc", i, "IFCX", [i - 1]) for i in range(1, 200)])


def test_absolute_positions(spark):
    """A chain of 70 turned placements, a tree below one root, a ring, and a parent that is not there."""
    rng = np.random.default_rng(1)

    def turned():
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        return np.concatenate([q, rng.normal(size=(3, 1))], 1)

    own = {i: turned() for i in range(300)}
    parent = {i: i - 1 if 0 < i < 70 else None if i == 0 else 0 for i in range(300)} | {70: None}
    rows = [(i, parent[i], *map(float, own[i].ravel())) for i in own] + [(900, 901, *map(float, own[0].ravel())), (901, 900, *map(float, own[0].ravel())), (902, 999, *map(float, own[0].ravel()))]
    df = spark.createDataFrame(rows, "id long, parent long, " + ", ".join(f"{c} double" for c in graphs.PLACE))
    got = {r.id: np.array(r[1:]).reshape(3, 4) for r in graphs.absolute(df).collect()}
    assert sorted(got) == list(range(300))
    want = {}
    for i in range(300):
        if parent[i] is None:
            want[i] = own[i]
        else:
            up = want[parent[i]]
            want[i] = np.concatenate([up[:, :3] @ own[i][:, :3], up[:, :3] @ own[i][:, 3:] + up[:, 3:]], 1)
        np.testing.assert_allclose(got[i], want[i], atol=1e-9)


def test_fingerprints(spark):
    """Renumbered rows have equal digests; another number, order or missing reference changes those above it; a ring has none."""
    one = [(1, "POINT 0", []), (2, "POINT 1", []), (3, "LINE", [1, 2]), (4, "LINE", [2, 1]), (5, "SHAPE", [3, 4, 3]), (6, "SHAPE", [3, 77]), (7, "RING", [8]), (8, "RING", [7, 1]), (9, None, None), (10, "ABOVE", [7])]
    move = lambda i: 1000 - 3 * i
    two = [(move(i), own, [move(r) if r != 77 else 5 for r in refs] if refs is not None else None) for i, own, refs in one]
    got = [{r.id: r.fingerprint for r in graphs.fingerprints(spark.createDataFrame(rows, "id long, own string, refs array<long>")).collect()} for rows in (one, two)]
    assert len(got[0]) == 10 and {move(i): f for i, f in got[0].items()} == got[1]
    assert [i for i, f in got[0].items() if f is None] and {i for i, f in got[0].items() if f is None} == {7, 8, 10}
    assert len({got[0][i] for i in (1, 2, 3, 4, 5, 6, 9)}) == 7
    changed = [(i, "POINT 2" if i == 2 else own, refs) for i, own, refs in one]
    after = {r.id: r.fingerprint for r in graphs.fingerprints(spark.createDataFrame(changed, "id long, own string, refs array<long>")).collect()}
    assert {i for i in after if after[i] != got[0][i]} == {2, 3, 4, 5, 6}
    texts = [r[0] for r in spark.createDataFrame([(0.1 + 0.2,), (0.3,), (0.0,), (1234567.0,)], "v double").select(graphs.number_text(F.col("v"))).collect()]
    assert texts[0] == texts[1] != texts[2] == "0" and texts[3] == "1.23457e+06"


def test_parts(spark):
    """Each part equals its own closure, also beyond one bitmap, with shared rows and rings."""
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(None, 3), (5, None)] + [(500 + i, 501 + i) for i in range(40)]
    roots = [(rng.randrange(120), p) for p in range(70)] + [(500, 3), (None, 1)]
    got = {(r.id, r.part) for r in graphs.parts(spark.createDataFrame(links, "source long, target long"), spark.createDataFrame(roots, "id long, part int")).collect()}
    want = set()
    for root, p in roots:
        todo = [root] if root is not None else []
        while todo:
            i = todo.pop()
            if (i, p) not in want:
                want.add((i, p))
                todo += [t for s, t in links if s == i and t is not None]
    assert got == want


def _usage():
    rng = random.Random(4)
    rows = []
    for s in range(12):
        for k in range(60):
            rows.append((f"s{s}", 1000 + rng.randrange(400), f"e{rng.randrange(40)}", None))
        if s % 4:
            rows.append((f"s{s}", 1000 + rng.randrange(100, 300), None, "ready"))
        if s % 3 == 0:
            rows.append((f"s{s}", 1000 + rng.randrange(100, 300), None, "failed"))
    return rows + [("s1", 1200, "tie", None), ("s1", 1200, None, "ready")]


def _expected(rows, most):
    out = set()
    for s in {r[0] for r in rows}:
        ready, queue, seen, seq = False, [], set(), 0
        for t, kind, what in sorted((t, 0 if sig else 1, sig or e) for x, t, e, sig in rows if x == s):
            if kind == 0:
                if what == "ready" and not ready:
                    ready = True
                    for at, e in queue:
                        seq += 1
                        out.add((s, e, at, t, seq))
                queue = []
            elif what not in seen:
                seen.add(what)
                if ready:
                    seq += 1
                    out.add((s, what, t, t, seq))
                elif len(queue) < most:
                    queue.append((t, what))
    return out


@pytest.mark.parametrize("most", [3, 20])
def test_held_back_until_the_sink_is_ready(spark, tmp_path, most):
    """Batch and stream give the same rows, also when they come out of order within the delay."""
    rows = _usage()
    want = _expected(rows, most)
    df = spark.createDataFrame(rows, "session_id string, s long, event string, signal string").select("session_id", F.timestamp_seconds("s").alias("ts"), "event", "signal")
    plain = lambda rs: {(r.session_id, r.event, int(r.ts.timestamp()), int(r.sent_at.timestamp()), r.seq) for r in rs}
    got = events.delivered(df.where("event is not null").select("session_id", "ts", "event"), df.where("signal is not null").select("session_id", "ts", "signal"), most)
    assert plain(got.collect()) == want and len(want) > 50
    rng = random.Random(5)
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(30))
    for i in range(4):
        part = late[i * len(late) // 4 : (i + 1) * len(late) // 4] + ([("end", 10**6, "end", None)] if i == 3 else [])
        spark.createDataFrame(part, "session_id string, s long, event string, signal string").select("session_id", F.timestamp_seconds("s").alias("ts"), "event", "signal").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("session_id string, ts timestamp, event string, signal string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.delivered(source, "1 minute", most).writeStream.format("memory").queryName(f"sent{most}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert plain(spark.table(f"sent{most}").where("session_id <> 'end'").collect()) == want
