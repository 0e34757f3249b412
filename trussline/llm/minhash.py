"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles. Two permutations make all
signature coordinates: the first, sigma, sends a shingle to a place in a
universe of 2**20; the second, pi, is a table of ranks, and coordinate k is the
least rank at sigma(x) + k, that is pi shifted k places round. Shingles that
share a place only make more candidates; every link is confirmed on the full
sets.

Equal sets are collapsed by a 128-bit digest first, so thousands of copies are
one node from then on. Nodes meet in buckets (a band's coordinates). Nothing
emits all pairs of a bucket: its first node, the lead of a star, is compared
with every other, and links are joined into components. What is left are nodes of
one star in different components. They are described by their difference from
the lead, which is small for near-copies, and an exact prefix filter on the
differences finds the pairs that can still be linked; see ``_steps``. So the
result is the same as that of all pairs of every bucket.

With 32 bands of 5 coordinates a pair at a similarity of 0.8 meets with
probability 1 - 3e-6, above it still more likely.

Edge cases: texts without words, or null, have an empty set and no link; with
fewer words than a shingle has, the whole sequence is one shingle; rows that
share an id are one document; a null id takes no part, keeps its shingle count
and has a null component (kept is true); no rows give no rows; other columns
are ignored here, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, mapped, mix64, passing, stars, words, written  # noqa: F401 (components is for callers)

#: Bands, coordinates in a band, and bits of the universe.
BANDS, ROWS, UNIVERSE = 32, 5, 20
#: One of so many nodes is sampled for the order of elements; an element is frequent if at least one of so many sampled nodes has it (so a star has OFTEN times a node's elements at most).
SAMPLE, OFTEN = 8, 40
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@lru_cache(2)
def _shifts(k: int) -> np.ndarray:
    """Row x: the ranks pi gives to the k places from x on, round the universe."""
    pi = np.random.default_rng(20).permutation(1 << UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a document's word hashes."""
    if not len(h):
        return h
    k = min(size, len(h))
    x = h[: len(h) - k + 1] * _A + np.uint64(k)
    for i in range(1, k):
        x = mix64(x) * _B + h[i : len(h) - k + 1 + i]
    return np.unique(mix64(x))


def signature(s: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The k circulant coordinates of a set."""
    place = (s * _B) >> np.uint64(64 - UNIVERSE)
    table = _shifts(k)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 2048):
        np.minimum(out, table[place[i : i + 2048]].min(0), out=out)
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, n, d1, d2 (digest of the full set), bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _A
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in chunks(b):
                h, at = words(data, offs)
                n, digest, bands = [], [], []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    s = shingles(h[i:j], size)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        x = salt.copy()
                        for c in signature(s).reshape(BANDS, ROWS).T:
                            x = mix64(x ^ c.astype(np.uint64))
                        bands.append(x.view(np.int64))
                    else:
                        bands.append(np.zeros(0, np.int64))
                d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["id", "n", "d1", "d2", "bands"])

    return mapped(docs, sketch, "id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """id and its full set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in chunks(b):
                h, at = words(data, offs)
                all_sets = [shingles(h[i:j], size).view(np.int64) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in all_sets])]).astype(np.int32), pa.array(np.concatenate(all_sets)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], ["id", "s"])

    return mapped(docs, sets, "id long, s array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    a, b = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id column, n_shingles, component_id (the smallest id reachable over links, its own included) and kept, for every row."""
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketch = written(_sketches(base, shingle), "sketches")
    nodes = sketch.where("id is not null and n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    held = nodes.select("rep", "n", F.explode("bands").alias("key"))
    # A bucket's first node: the least of hashes that a quarter of the buckets share, so that one ill-placed node does not lead them all.
    order = F.struct(F.xxhash64("rep", F.pmod("key", F.lit(4))).alias("h"), "rep", "n")
    lead = held.groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("size")).where("size > 1")
    buckets = written(held.join(lead, "key").select("key", "rep", "n", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("nl")), "buckets")
    spokes = buckets.where("rep <> lead").select("lead", "nl", "rep", "n").distinct()
    wanted = spokes.select("rep").union(spokes.select("lead")).distinct()
    sets = written(_sets(passing(base, "id", wanted, "rep"), shingle).join(wanted, F.col("id") == F.col("rep"), "leftsemi").where("size(s) > 0").distinct(), "sets")
    near = (100 + percent) * F.least("n", "nl") >= percent * (F.col("n") + F.col("nl"))  # else their sizes alone keep them apart
    # Rows that share an id are one document, though their texts differ: their nodes are linked.
    texts = sketch.where("id is not null and n > 0").select("id", "d1", "d2").distinct()
    several = texts.join(texts.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1"), "id").join(nodes.select("d1", "d2", "rep"), ["d1", "d2"])
    same = several.join(several.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a <> rep").select("a", F.col("rep").alias("b"))
    links = written(_confirmed(spokes.where(near).select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct(), sets, percent).unionByName(same).distinct(), "links")
    comps = _joined(buckets.select("key", "rep", "n"), links, stars(links), sets, percent)
    reps = nodes.select("d1", "d2", "rep").join(comps, F.col("rep") == F.col("node"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("component", "rep").alias("component"))
    out = sketch.join(reps, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(buckets: DataFrame, links: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """comps, a table of stars(), after the links that nodes of one bucket in different components still have."""
    _, now, pairs = _steps(buckets, links, comps, sets, percent)
    more = written(_confirmed(pairs, sets, percent), "links")
    return now if more.isEmpty() else stars(more, now)


def _across(buckets: DataFrame, links: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket that may be linked, though the links so far leave them in different components."""
    found, _, pairs = _steps(buckets, links, comps, sets, percent)
    return pairs.unionByName(found).distinct()


def _steps(buckets: DataFrame, links: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links found in a first step, components with them, pairs (a, b) that may still be linked) of nodes of one bucket in different components.

    A bucket of several components is a star around its node of most links, the
    lead L. With R the shingles of L that a node lacks, and A those that it has
    besides, two nodes have |L| - |R u R'| + |A n A'| in common. So they are
    linked exactly if R and R' together with A and A' share at least
    need = f (n + n') - |L| + |R| + |R'| elements, f = percent / (100 + percent).
    Where need is not above 0 the node of least f n + |R| is linked to both.
    Else, in any common order, at least need elements of either stand from the
    first shared one on: a node outside the star's largest component meets those
    of its others with which it shares such an element: first one node of
    each element, then, as far as links found so leave them in different
    components, all.
    """
    whole = 100 + percent
    degrees = links.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("degree"))
    rows = buckets.join(comps, F.col("rep") == F.col("node"), "left").join(degrees, F.col("rep") == F.col("of"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"), F.coalesce("degree", F.lit(0)).alias("degree"))
    leads = rows.groupBy("key").agg(F.max(F.struct("degree", "rep")).alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", F.col("lead.rep").alias("lead"))
    rows = rows.join(leads, "key").select("lead", "rep", "n", "c").distinct()
    own, first = sets.select(F.col("id").alias("rep"), F.col("s")), sets.select(F.col("id").alias("lead"), F.col("s").alias("sl"))
    q = percent * F.col("n") + whole * F.size("r")
    rows = written(
        rows.join(_largest(rows), "lead").join(own, "rep").join(first, "lead").select("lead", "rep", "n", "c", (F.col("c") != F.col("main")).alias("apart"), F.size("sl").alias("nl"), F.array_sort(F.array_except("s", "sl")).alias("a"), F.array_sort(F.array_except("sl", "s")).alias("r"))
        .select("lead", "rep", "c", "apart", (whole * F.col("nl")).alias("l"), F.concat("a", "r").alias("d"), q.cast("long").alias("q")),
        "apart",
    )
    # Any common order is right; the one that ends with a star's frequent elements leaves the fewest pairs, and a sample of its nodes shows them.
    sampled = rows.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0)
    nodes = sampled.groupBy("lead").agg(F.count("*").alias("nodes"))
    often = sampled.select("lead", F.explode("d").alias("e")).groupBy("lead", "e").agg(F.count("*").alias("k")).where("k > 1").join(nodes, "lead").where(F.col("k") * OFTEN >= F.col("nodes"))
    often = often.groupBy("lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("often"))
    none = F.array().cast("array<bigint>")
    rows = rows.join(often, "lead", "left").withColumn("d", F.concat(F.array_except("d", F.coalesce("often", none)), F.array_intersect(F.coalesce("often", none), "d"))).drop("often")
    least = rows.groupBy("lead").agg(F.min(F.struct("q", "rep")).alias("low"), F.min(F.when(F.col("apart"), F.col("q"))).alias("low_apart"))
    rows = written(rows.join(least, "lead"), "ordered")
    sure = rows.where((F.col("q") + F.col("low.q") <= F.col("l")) & (F.col("rep") != F.col("low.rep"))).select(F.least("rep", "low.rep").alias("a"), F.greatest("rep", "low.rep").alias("b"))

    def prefix(other: Column) -> Column:
        need = F.greatest(F.lit(1), F.ceil((F.col("q") + other - F.col("l")) / whole))
        return F.posexplode(F.slice("d", F.lit(1), F.greatest(F.lit(0), F.size("d") - need + 1).cast("int")))

    def ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A row for each element of the prefix: of nodes outside the largest component, and of all."""
        kept = ["lead", "rep", "c", "q", F.size("d").alias("nd")]
        return rows.where("apart").select(*kept, "l", prefix(F.col("low.q")).alias("at", "e")), _second(rows.select(*kept, prefix(F.col("low_apart")).alias("at", "e")))

    def linkable(both: DataFrame) -> DataFrame:
        met = both.where((F.col("rep") != F.col("rep2")) & (F.col("c") != F.col("c2")) & (whole * F.least(F.col("nd") - F.col("at"), F.col("nd2") - F.col("at2")) >= F.col("q") + F.col("q2") - F.col("l")))
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))

    # Many that are linked with each other, but not with the lead, would make all their pairs: so an element's node of least q, and that of the apart ones, meet its others first.
    left, right = ends(rows)
    held = [c for c in right.columns if c not in ("lead", "e")]
    firsts = [x.groupBy("lead", "e").agg(F.min(F.struct("q2", *[c for c in held if c != "q2"])).alias("first")) for x in (right, _second(left.drop("l")))]
    firsts = firsts[0].unionByName(firsts[1]).distinct().select("lead", "e", *[F.col(f"first.{c}").alias(c) for c in held])
    found = written(_confirmed(linkable(left.join(firsts, ["lead", "e"])).unionByName(sure).distinct(), sets, percent), "links")
    if found.isEmpty():
        return found, comps, linkable(left.join(right, ["lead", "e"])).distinct()
    now = stars(found, comps)
    rows = rows.drop("c", "apart").join(now, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    rows = written(rows.join(_largest(rows), "lead").withColumn("apart", F.col("c") != F.col("main")), "ordered")
    left, right = ends(rows)
    return found, now, linkable(left.join(right, ["lead", "e"])).distinct()


def _second(rows: DataFrame) -> DataFrame:
    """The columns under the names that they have for the second node of a pair."""
    return rows.withColumnsRenamed({c: f"{c}2" for c in ("rep", "c", "q", "nd", "at")})


def _largest(rows: DataFrame) -> DataFrame:
    """lead and main, the component of most of its rows."""
    sizes = rows.groupBy("lead", "c").agg(F.count("*").alias("size"))
    return sizes.groupBy("lead").agg(F.max(F.struct("size", "c")).alias("most")).select("lead", F.col("most.c").alias("main"))


def sql(shingle: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of documents in SQL: all sets, pairs counted by shared shingles, and components by reachability."""
    one = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(shingle))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {shingle} + 2), lambda i: {one}) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE {100 + percent} * least(x.n, y.n) >= {percent} * (x.n + y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING {100 + percent} * count(*) >= {percent} * (x.n + y.n)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


#: Near-duplicates by two-word shingles in SQL.
SQL = f"SELECT *, doc_id = component_id AS kept FROM ({sql(2, 80)})"
