"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about SHARD rows by a hash of their id. A shard's
graph is built by insertion: the nodes of a batch search the graph so far (from
where a greedy walk down the layers above ends) for their candidates, which are
thinned by the usual diversity rule; reverse links are added and thinned by the
same rule where a node has too many. The largest inner product is turned into
nearness on a sphere by one more component for building. A graph is one row of
flat arrays: vectors, ids, and for each layer the neighbours of its nodes.

Queries go in blocks to every shard; a block descends the layers greedily and
then runs one beam of width EF for all its queries at once, which looks at a
number of nodes that hardly grows with the shard. Scores are inner products of
the original vectors in double precision, and the shards' best are merged by
(score, id).

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null id, take no part; vectors of different lengths
are never compared; equal vectors of a shard are one node that carries all its
ids; repeated rows count once; a query is not its own neighbour; with fewer
candidates than k all are returned; no rows give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard, links of a node (twice as many in the lowest layer), candidates when linking, beam width, nodes of a beam expanded at once, queries in a block, blocks that one task searches for.
SHARD, LINKS, EF_BUILD, EF, WIDE, BLOCK, BLOCKS = 1 << 15, 16, 64, 224, 8, 256, 64
#: Nodes of the first batch.
FIRST = 512
GRAPH = "dim int, shard long, ids binary, owners binary, vectors binary, layers array<struct<nodes: int, links: binary>>"


def _thinned(v: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each node, of its candidates (a row, nearest first, -1 beyond) those nearer to it than to any candidate already kept, filled up with the others; -1 beyond."""
    out = np.full((len(nodes), most), -1, np.int32)
    for lo in range(0, len(nodes), 128):
        c = near[lo : lo + 128]
        there = c >= 0
        own = v[np.maximum(c, 0)]
        to_node = np.einsum("bkd,bd->bk", own, v[nodes[lo : lo + 128]])
        between = np.matmul(own, own.transpose(0, 2, 1))
        closest = np.full(c.shape, -np.inf, v.dtype)
        kept, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        for i in range(c.shape[1]):
            ok = np.flatnonzero(there[:, i] & (closest[:, i] < to_node[:, i]) & (count < most))
            kept[ok, i] = True
            count[ok] += 1
            closest[ok] = np.maximum(closest[ok], between[ok, i])
        first = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        out[lo : lo + 128, : first.shape[1]] = np.take_along_axis(c, first, 1)
    return out


def _best(v: np.ndarray, queries: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """The distinct candidates of each row, nearest first, -1 beyond."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    s = np.where(near >= 0, np.einsum("bkd,bd->bk", v[np.maximum(near, 0)], queries), -np.inf)
    top = np.argsort(-s, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, top, 1)


def _link_back(v: np.ndarray, links: np.ndarray, lo: int, hi: int, most: int) -> None:
    """Gives the nodes that lo to hi link to a link back, thinned where they have too many."""
    source, target = np.repeat(np.arange(lo, hi), links.shape[1]), links[lo:hi].ravel()
    on = target >= 0
    source, target = source[on], target[on]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, n = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(nodes), 1024):
        own = nodes[at : at + 1024]
        wide = int(n[at : at + 1024].max())
        back = np.full((len(own), wide), -1, np.int64)
        row = np.repeat(np.arange(len(own)), n[at : at + 1024])
        begin, count = first[at], int(n[at : at + 1024].sum())
        back[row, np.arange(count) - np.repeat(first[at : at + 1024] - begin, n[at : at + 1024])] = source[begin : begin + count]
        near = _best(v, v[own], np.concatenate([links[own].astype(np.int64), back], 1), most + LINKS)
        links[own] = _thinned(v, own, near, most)


def _layer(v: np.ndarray, most: int, start: np.ndarray) -> np.ndarray:
    """Neighbours of each row of v, -1 where there are fewer than most.

    Nodes are inserted in order, in batches that grow with the graph: a batch's
    candidates are what a search of the graph so far finds for it, and its own
    members. start: for each node one of the graph above, to search from as soon as it is in this one.
    """
    n = len(v)
    links = np.full((n, most), -1, np.int32)
    lo = 0
    while lo < n:
        hi = min(n, max(FIRST, lo + lo // 4))
        for a in range(lo, hi, BLOCK):
            b = min(a + BLOCK, hi)
            inside = v[a:b] @ v[lo:hi].T
            inside[np.arange(b - a), np.arange(a, b) - lo] = -np.inf
            k = min(EF_BUILD, hi - lo)
            top = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            near = np.where(np.take_along_axis(inside, top, 1) > -np.inf, top + lo, -1)
            if lo:
                near = np.concatenate([near, beam(v, links, v[a:b], np.where(start[a:b] < lo, start[a:b], 0), EF_BUILD, lo)], 1)
            near = _best(v, v[a:b], near, EF_BUILD)
            half = max(1, most // 2)
            links[a:b, :half] = _thinned(v, np.arange(a, b), near, half)
        _link_back(v, links, lo, hi, most)
        lo = hi
    return links


def build_graph(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Flat arrays of a shard's graph; the first layer is the highest one, and a layer's nodes are the first ones of the next."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    unique, owner = np.unique(vectors, axis=0, return_inverse=True)
    # A node's height is geometric; nodes stand in order of height, in a seeded order among equals, and are inserted so.
    rng = np.random.default_rng(len(unique))
    height = np.minimum((-np.log(1 - rng.random(len(unique))) / np.log(LINKS)).astype(int), 8)
    by_height = np.argsort(-height, kind="stable")
    place = np.empty(len(unique), np.int64)
    place[by_height] = np.arange(len(unique))
    unique, owner, height = unique[by_height], place[owner.ravel()], height[by_height]
    square = (unique.astype(np.float64) ** 2).sum(1)
    v = np.ascontiguousarray(np.concatenate([unique, np.sqrt(np.maximum(square.max() - square, 0))[:, None].astype(np.float32)], 1))
    layers: list[np.ndarray] = []
    for h in range(int(height.max()), -1, -1):
        own = v[: int((height >= h).sum())]
        layers.append(_layer(own, LINKS if h else 2 * LINKS, descend(v, layers, own)))
    return {"ids": ids.astype(np.int64).tobytes(), "owners": owner.astype(np.int32).tobytes(), "vectors": unique.astype(np.float32).tobytes(), "layers": [{"nodes": len(x), "links": x.tobytes()} for x in layers]}


def descend(v: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """For each query the node at which a greedy walk down the layers ends."""
    at = np.zeros(len(queries), np.int64)
    for lo in range(0, len(queries), 4096):
        q_all = queries[lo : lo + 4096]
        own = at[lo : lo + 4096]
        here = np.einsum("qd,qd->q", q_all, v[own])
        for links in layers:
            active = np.arange(len(q_all))
            while len(active):
                near = links[own[active]]
                s = np.where(near >= 0, np.einsum("qkd,qd->qk", v[np.maximum(near, 0)], q_all[active]), -np.inf)
                k = s.argmax(1)
                top = s[np.arange(len(active)), k]
                up = top > here[active]
                own[active[up]], here[active[up]] = near[np.arange(len(active)), k][up], top[up]
                active = active[up]
    return at


def beam(v: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int, n: int | None = None, visited: list | None = None) -> np.ndarray:
    """For each query the nodes of its final beam, best first, -1 where there are fewer; n: how many nodes the graph has so far."""
    nq, n = len(queries), len(v) if n is None else n
    ef, wide = min(ef, n), min(WIDE, ef, n)
    nodes = np.full((nq, ef), -1, np.int64)
    score = np.full((nq, ef), -np.inf, np.float32)
    done = np.ones((nq, ef), bool)
    seen = np.zeros((nq, n + 1), bool)
    nodes[:, 0], score[:, 0], done[:, 0] = start, np.einsum("qd,qd->q", queries, v[start]), False
    seen[np.arange(nq), start] = True
    q = np.arange(nq)
    while len(q):
        # The best few of each beam that have not been expanded.
        rank = np.where(done[q], -np.inf, score[q])
        pick = np.argpartition(-rank, wide - 1, axis=1)[:, :wide]
        live = np.take_along_axis(rank, pick, 1) > -np.inf
        d = done[q]
        np.put_along_axis(d, pick, True, 1)
        near = np.where(live[:, :, None], links[np.where(live, nodes[q[:, None], pick], 0)], -1).reshape(len(q), -1).astype(np.int64)
        fresh = (near >= 0) & ~seen[q[:, None], near]
        # Only what is new is looked at: flat lists of (query, node).
        i, j = np.nonzero(fresh)
        key = np.unique(i * (n + 1) + near[i, j])
        i, node = key // (n + 1), key % (n + 1)
        seen[q[i], node] = True
        if visited is not None:
            visited.append(len(node))
        s = np.einsum("kd,kd->k", v[node], queries[q[i]])
        good = s > score[q].min(1)[i]
        i, node, s = i[good], node[good], s[good]
        count = np.bincount(i, minlength=len(q))
        width = int(count.max()) if len(i) else 0
        if width:
            col = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            new_s, new_n = np.full((len(q), width), -np.inf, np.float32), np.full((len(q), width), -1, np.int64)
            new_s[i, col], new_n[i, col] = s, node
            all_s, all_n = np.concatenate([score[q], new_s], 1), np.concatenate([nodes[q], new_n], 1)
            all_d = np.concatenate([d, new_n < 0], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            score[q], nodes[q], d = (np.take_along_axis(x, top, 1) for x in (all_s, all_n, all_d))
        done[q] = d
        q = q[~d.all(1)]
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id column, score: the k nearest found of each query row."""
    vec = F.col(vector_column)
    sound = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0) & F.col(id_column).isNotNull()
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), vec.cast("array<double>").alias("v"), is_query.alias("q")).withColumn("dim", F.size("v"))
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-nq // BLOCK))
    groups = -(-blocks // BLOCKS)

    def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.concatenate([np.asarray(c.flatten()) for c in col.chunks] or [np.zeros(0)]).reshape(-1, dim)

    def build(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids, v = t.column("id").to_numpy(), matrix(t.column("v"), dim)
        whole = np.ascontiguousarray(np.concatenate([ids[:, None], v.view(np.int64)], 1))
        _, once = np.unique(whole.view(f"V{8 * (dim + 1)}").ravel(), return_index=True)
        once = once[np.argsort(ids[once], kind="stable")]
        ids, v = ids[once], v[once]
        return pa.Table.from_pylist([{"dim": dim, "shard": key[1].as_py(), **build_graph(ids, v.astype(np.float32)), "exact": v.tobytes()}], _graph)

    _graph = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("owners", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.struct([("nodes", pa.int32()), ("links", pa.binary())]))), ("exact", pa.binary())])
    dealt = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v")
    # So many partitions that no task need build two graphs.
    dealt = dealt.repartition(min(4 * shards, 10_000), "dim", "shard")
    graphs = written(dealt.groupBy("dim", "shard").applyInArrow(build, GRAPH + ", exact binary"), "graphs")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "queries": pa.array([matrix(t.column("v"), dim).tobytes()], pa.binary())})

    asked = rows.where("q").select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v").dropDuplicates(["id", "v"]).groupBy("dim", "block").applyInArrow(pack, "dim int, block long, ids binary, queries binary")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod("block", F.lit(groups)).alias("part"), "ids", "queries")
    copies = graphs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))

    def search(key: tuple, graph: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        dim = key[0].as_py()
        for g in graph.to_pylist():
            v = np.frombuffer(g["vectors"], np.float32).reshape(-1, dim)
            layers = [np.frombuffer(x["links"], np.int32).reshape(x["nodes"], -1) for x in g["layers"]]
            ids, owner, exact = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["owners"], np.int32), np.frombuffer(g["exact"], np.float64).reshape(-1, dim)
            by_node = np.argsort(owner, kind="stable")  # ids of a node stay ascending
            first = np.searchsorted(owner[by_node], np.arange(len(v) + 1))
            for i in range(queries.num_rows):
                qid = np.frombuffer(queries.column("ids")[i].as_py(), np.int64)
                q = np.frombuffer(queries.column("queries")[i].as_py(), np.float64).reshape(-1, dim)
                single = q.astype(np.float32)
                beams = beam(v, layers[-1], single, descend(v, layers[:-1], single), max(EF, 2 * k))
                for a, one, found_ in zip(qid.tolist(), q, beams, strict=True):
                    found_ = found_[found_ >= 0]
                    rows_ = np.concatenate([by_node[first[x] : first[x + 1]][: k + 1] for x in found_.tolist()])
                    rows_ = rows_[ids[rows_] != a]
                    s = (exact[rows_] * one).sum(1)
                    top = np.lexsort((ids[rows_], -s))[:k]
                    out.append((np.full(len(top), a, np.int64), ids[rows_][top], s[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "id": cols[1], "score": cols[2]})

    by = ["dim", "shard", "part"]
    found = copies.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
