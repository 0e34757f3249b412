"""Vector codes, the conversation trie and the n-gram join against brute force, with their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trussline.llm import codes, common, minhash, ngram_join, queries, trie

SF = "/root/testdata/sf0.001"


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda f: collections.Counter(tuple(None if pd.isna(v) else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    got = queries.QUERIES[name](spark, SF)
    whole = got.select(*[F.col(c).cast("string") for c in got.columns]).toPandas()
    want = con.sql(f"SELECT COLUMNS(*)::VARCHAR FROM ({queries.ORACLES[name]})").df()
    assert sorted(got.columns) == sorted(want.columns) and plain(whole) == plain(want)


# Vector codes


def coded(rows, parts, entries, rounds=4):
    """Brute force: rows of (id, label, vector), sound ones."""
    x = [np.floor(np.array(v, float) * 1024).astype(int) for _, _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][2])))
    d = len(x[0]) // parts
    books = [[x[i][p * d : (p + 1) * d].copy() for i in order[:entries]] for p in range(parts)]

    def nearest(p, i):
        return min((int(((x[i][p * d : (p + 1) * d] - c) ** 2).sum()), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for i in range(len(x)):
                of[nearest(p, i)[1]].append(x[i][p * d : (p + 1) * d])
            for k, vs in of.items():
                books[p][k] = sum(vs) // len(vs)
    best = [[nearest(p, i) for p in range(parts)] for i in range(len(x))]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [sum(e for e, _ in b) for b in best]
    by_label = collections.Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    return collections.Counter((r[0], "".join(f"{k:02x}" for _, k in b), e, by_label[r[1]], digest) for r, b, e in zip(rows, best, errors, strict=True))


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 70)
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3) if i % 7 else None, [float(v) for v in rng.normal(size=8) * rng.choice([0.01, 1, 3])]) for i in range(400)]
    rows += [(400 + i, 5, rows[i % 4][2]) for i in range(60)]  # copies
    rows += [(3, 1, rows[9][2]), (3, 1, rows[3][2]), (None, None, rows[5][2]), (None, 2, [0.0] * 8), (-4, 1, [-0.0001] * 8)]
    bad = [(900, 1, None), (901, 1, [float("nan")] * 8), (902, 1, [None] + [0.0] * 7), (903, 1, [float("inf")] * 8), (904, 1, []), (905, 1, [1.0] * 4), (906, 1, [1.0] * 9)]
    far = [(907, 8, [1e30] + [0.0] * 7)]
    frame = spark.createDataFrame(rows + bad + far, "vec_id long, label int, embedding array<double>").select("*", F.lit(1).alias("id"), F.lit("k").alias("key"), F.lit(0).alias("error")).repartition(3)
    got = collections.Counter(tuple(r) for r in codes.vector_codes(frame, entries=32).collect())
    want = coded(rows, 4, 32)
    assert {r[:4] for r in got if r[0] == 907} == {(907, None, None, None)}
    assert collections.Counter({r: n for r, n in got.items() if r[0] != 907}) == want
    few = spark.createDataFrame(rows[:3], "vec_id long, label int, embedding array<double>")
    assert collections.Counter(tuple(r) for r in codes.vector_codes(few).collect()) == coded(rows[:3], 4, 256)
    assert codes.vector_codes(frame.limit(0)).count() == 0 and codes.vector_codes(spark.createDataFrame(bad[:4], "vec_id long, label int, embedding array<double>")).count() == 0


def test_filtering_is_exact_and_eliminates():
    """Trees give what comparing all gives, ties included, and whole subtrees go at once where parts are clustered."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 6))
    x = (centres[rng.integers(0, 20, 900)] + rng.integers(-9, 9, (900, 6))).astype(np.int64)
    book = np.concatenate([centres, centres[:5], rng.integers(-4000, 4000, (15, 6))]).astype(float)
    order, lo, hi, sums = codes.build(x)
    code, whole, total = np.full(900, -1), [0], np.zeros((40, 6), np.int64)

    def take(entry, first, end, node):
        assert (code[order[first:end]] == -1).all()
        code[order[first:end]] = entry
        if node >= 0:
            whole[0] += end - first
            total[entry] += sums[node]
            assert (sums[node] == x[order[first:end]].sum(0)).all()

    codes.assign(x, order, lo, hi, book, take)
    want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all() and whole[0] > 400


# Conversation trie


def nodes_of(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    leaves = {k: sum(k == m[: len(k)] for m in members if not any(len(o) == len(m) + 1 and o[:-1] == m for o in members)) for k in members}
    saved = {k: sum((len(v) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0) for m, v in members.items() if m[: len(k)] == k) for k in members}
    out = collections.Counter()
    for k, v in members.items():
        kids = sum(len(o) == len(k) + 1 and o[:-1] == k for o in members)
        ends = ",".join(str(c) for c in sorted(v) if built[c] == k)
        out[min(v), len(k), min(members[k[:-1]]) if k else None, len(v), kids, leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    pool = [(rng.choice(["user", "assistant"]), words(rng.randrange(0, 9), rng)) for _ in range(6)]
    rows = []
    for c in [*range(0, 50), *range(65, 90), *range(110, 125), -3, -20, -41]:
        rows += [(c, t, *rng.choice(pool[: 2 + t // 2])) for t in range(rng.randrange(1, 7))]
    rows += [(40, t, *rng.choice(pool)) for t in range(10, 60)] + [(47, t, *rng.choice(pool)) for t in range(20, 90)]
    rows += [(7, None, "user", "first"), (8, 2, None, None), (8, 2, "user", "tied"), (8, 2, "user", "tied"), (9, 1, "a", "Two\tWords"), (None, 1, "user", "nobody"), (300, 0, "u", "alone"), (301, 0, "u", "alone"), (321, 5, "x", "y")]
    return rows


@pytest.mark.parametrize("long", [4096, 5])
def test_conversation_trie(spark, turns, long):
    """Also with conversations of more than five turns dealt by ranges."""
    frame = spark.createDataFrame(turns, TURNS).select("*", F.lit(1).alias("depth"), F.lit("x").alias("conv"), F.lit(2).alias("n")).repartition(5)
    got = collections.Counter(tuple(r) for r in trie.conversation_trie(frame, long).collect())
    assert got == nodes_of(turns)
    assert trie.conversation_trie(frame.limit(0), long).count() == 0


def test_trie_of_nested_chains(spark):
    """Each conversation is the one before with a turn more, so chains hang from chains from chains."""
    rows = [(20 * i, t, "user", f"turn {t}") for i in range(40) for t in range(i + 1)]
    assert collections.Counter(tuple(r) for r in trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()) == nodes_of(rows)


def test_running_over_many_partitions(spark):
    """Sums of a key that spans partitions are carried from one to the next."""
    rows = spark.range(5000).select(F.floor(F.col("id") % 7 / 6).alias("k"), "id", (F.col("id") % 5).alias("v"))
    dealt = rows.repartitionByRange(9, "k", "id").sortWithinPartitions("k", "id").withColumn("one", F.lit(1).cast("long"))
    want, sums = {}, collections.Counter()
    for i in range(5000):
        k = i % 7 // 6
        sums[k, 0] += 1
        sums[k, 1] += i % 5
        want[i] = (sums[k, 0], sums[k, 1])
    assert {r.id: (r.one_to, r.v_to) for r in trie.running(dealt, "k", ["one", "v"], "sums").collect()} == want


# N-gram join


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def classes(rows, size, percent):
    def shingles(t):
        w = tokens(t)
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = collections.defaultdict(set)
    for d, t in rows:
        if d is not None:
            sets[d].add(shingles(t))
    ids = sorted(sets)
    low = {d: d for d in ids}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return collections.Counter((d, len(shingles(t)), root(d) if d is not None else None) for d, t in rows)


@pytest.mark.parametrize(("size", "percent", "small"), [(3, 90, 32), (3, 90, 2), (2, 70, 3)])
def test_ngram_join(spark, monkeypatch, size, percent, small):
    """Copies, near-copies by the dozen (more groups than a bucket's pairs may have), common lines, and edge cases."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = random.Random(6)
    line = words(12, rng)
    rows = [(i, words(rng.randrange(1, 60), rng)) for i in range(60)]
    for k in range(4):
        base = words(80, rng).split()
        for i in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = words(1, rng)
            rows.append((100 * (k + 1) + i, " ".join(w)))
    rows += [(600 + i, f"{line} {words(rng.randrange(0, 3), rng)}") for i in range(40)]
    rows += [(700 + i, rows[i][1]) for i in range(9)]
    rows += [(800, None), (801, ""), (802, " \n"), (803, "one"), (804, "ONE"), (805, "one two"), (806, "One\ttwo"), (807, words(3000, rng)), (None, rows[3][1]), (None, None), (5, rows[6][1]), (5, rows[5][1]), (808, " ".join(["a"] * 500))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("id"), F.lit("g").alias("g"), F.lit(0).alias("n")).repartition(3)
    got = collections.Counter(tuple(r) for r in ngram_join.similar(frame, size, percent).collect())
    assert got == classes(rows, size, percent)
    assert ngram_join.similar(frame.limit(0), size, percent).count() == 0


def test_prefix_order():
    """Frequent shingles stand last, the most frequent at the very end."""
    order = ngram_join.Order(np.array([3, 8, 20], np.uint64), np.array([2, 3, 1]))
    s = np.array([1, 3, 7, 8, 20, 30], np.uint64)
    assert order.prefix(s, 6).tolist() == [1, 7, 30, 20, 3, 8] and order.prefix(s, 2).tolist() == [1, 7]


def test_ngram_join_makes_few_pairs_of_near_copies(spark, monkeypatch):
    """A hundred near-copies that one of them links make no pairs of all of them."""
    rng = random.Random(7)
    base = words(400, rng).split()
    rows = [(i, words(30, rng)) for i in range(20)]
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = words(1, rng)
        rows.append((100 + i, " ".join(w)))
    pairs, write = [], ngram_join.written

    def counted(df, name):
        out = write(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collections.Counter(tuple(r) for r in ngram_join.similar(frame).collect()) == classes(rows, 3, 90)
    assert sum(pairs) < 10 * len(rows)


def test_linked_nodes_far_from_their_lead_make_few_pairs(spark):
    """Eighty nodes that are linked with each other, but not with the lead of their star, are joined without all their pairs."""
    rng = random.Random(8)
    base = list(range(200))

    def changed(k):
        out = list(base)
        for i in rng.sample(range(200), k):
            out[i] = rng.randrange(1000, 10**9)
        return out

    sets = [(i, changed(6)) for i in range(80)] + [(i, changed(60)) for i in range(80, 90)] + [(90, changed(60))]
    frame = spark.createDataFrame(sets, "id long, s array<long>").repartition(3)
    buckets = frame.select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rep"), F.size("s").cast("long").alias("n"))
    links, comps = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, component long")
    pairs = minhash._across(buckets, links, comps, frame, 80)  # without links the largest rep, 90, leads
    found = minhash._confirmed(pairs, frame, 80)
    whole = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}
    assert len(whole) == 80 * 79 // 2 and {tuple(r) for r in found.collect()} <= whole
    assert {tuple(r) for r in minhash.components(found).collect()} == {(i, 0) for i in range(80)}
    assert pairs.count() < 5 * len(sets)


def test_components_end_without_a_step_that_changes_nothing(spark, monkeypatch):
    """Random graphs against brute force, on top of known components too; a star of the right centre takes the links and one step."""
    tables, real = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: tables.append(name) or real(df, name))

    def brute(edges):
        of = {x: x for e in edges for x in e}
        while any(of[a] != of[b] for a, b in edges):
            for a, b in edges:
                of[a] = of[b] = min(of[a], of[b])
        return of

    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    rng = random.Random(5)
    for n in (12, 40):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(100 + i, 101 + i) for i in range(9)]
        edges = [(a, b) for a, b in edges if a != b]
        want = brute(edges)
        assert sorted(tuple(r) for r in common.components(frame(edges)).collect()) == sorted(want.items())
        both = common.stars(frame(edges[n // 2 :]), common.stars(frame(edges[: n // 2])))
        assert sorted(tuple(r) for r in both.collect()) == sorted((k, v) for k, v in want.items() if k != v)
    assert common.components(frame([])).count() == 0
    tables.clear()
    assert {tuple(r) for r in common.components(frame([(i, 0) for i in range(1, 9)])).collect()} == {(i, 0) for i in range(9)}
    assert len(tables) == 2
