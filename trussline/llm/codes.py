"""Vector codes: product quantisation learned by filtering Lloyd rounds over integers.

Components become integers floor(scale * x), and a vector is cut into equal
consecutive parts. Each part position has a codebook, which starts with that
part of the vectors of smallest id. Every round assigns all parts to their
nearest entries and moves the entries to their parts' floored means.

Every task builds, once, kd-trees over the parts of its blocks of rows, one for
each position, whose nodes hold a bounding box and the cached sum and count of
their parts; the blocks with their trees are a table. A round walks the trees
from the root with all entries as candidates. At a node the entry nearest to the
box's middle stays, and each other one is eliminated whose distance is larger at
that corner of the box which suits it best (then it is so in all of the box, and
it loses ties to a lower index). Where one candidate is left, the subtree's sum
and count go to it at once; at the leaves the parts are compared with what is
left. All of this is exact, in integers below 2**53. Sums by entry are added up
by Spark, and only the codebook (entries * dimensions numbers, whatever the
input) passes the driver.

Edge cases: a vector that is null, or has null or non-finite components, is
dropped, and so is one whose length is not the table's most frequent one that
can be cut into equal parts; one with a component too large for exact distances
(LIMIT, 16384 * 1024 at 16 dimensions a part) keeps its row, takes no part and
has null code and error; equal and null ids are rows of their own (null ids
last in the codebook's order, equal ones by vector); with fewer rows than entries
the codebooks are as small; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.functions.lookup import looked_up

from .common import mapped, written

#: Rows of a block (its trees are built in memory), and parts in a leaf at most.
BLOCK, LEAF = 4096, 16


def limit(dims: int) -> int:
    """The largest power of two below which components give exact squared distances in double precision."""
    return 1 << ((52 - max(dims - 1, 0).bit_length()) // 2)


def _starts(n: int) -> list[np.ndarray]:
    """First parts of the nodes of each level, and n: halves down to LEAF."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        a = levels[-1]
        out = np.empty(2 * len(a) - 1, np.int64)
        out[::2], out[1::2] = a, (a[:-1] + a[1:]) // 2
        levels.append(out)
    return levels


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of parts, lowest and highest corners, sums) of a kd-tree's nodes, level by level from the root."""
    n = len(x)
    order, boxes = np.arange(n), []
    levels = _starts(n)
    for depth, starts in enumerate(levels):
        at = starts[:-1]
        xs = x[order]
        lo, hi = np.minimum.reduceat(xs, at, 0), np.maximum.reduceat(xs, at, 0)
        boxes.append((lo, hi, np.add.reduceat(xs.astype(np.int64), at, 0)))
        if depth + 1 < len(levels):
            node = np.repeat(np.arange(len(at)), np.diff(starts))
            wide = (hi - lo).argmax(1)
            order = order[np.lexsort((xs[np.arange(n), wide[node]], node))]
    return order, *(np.concatenate(b) for b in zip(*boxes, strict=True))


def assign(x: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, book: np.ndarray, take) -> None:
    """Calls take(entry, first and end place in order, node or -1) for runs of parts that have been assigned to an entry (or an array of entries).

    book: entries as doubles. Nodes are numbered level by level.
    """
    levels = _starts(len(x))
    node, cand = np.zeros(len(book), np.int64), np.arange(len(book))
    base = 0
    square = (book * book).sum(1)
    for depth, starts in enumerate(levels):
        # node: of this level, ascending; cand: ascending within a node.
        l, h = lo[base + node].astype(float), hi[base + node].astype(float)  # noqa: E741
        twice = 2 * book[cand] - (l + h)
        d = (twice * twice).sum(1)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        near = np.flatnonzero(d == np.minimum.reduceat(d, first)[of])
        near = near[np.append(True, of[near][1:] != of[near][:-1])]  # the lowest index of equals
        best = cand[near][of]
        u = book[cand] - book[best]
        corner = np.where(u > 0, h, l)
        # Squared distance to the candidate less that to the best, where it is least in the box.
        more = square[cand] - square[best] - 2 * (u * corner).sum(1)
        keep = (more < 0) | ((more == 0) & (cand <= best)) | (cand == best)
        node, cand, of = node[keep], cand[keep], of[keep]
        left = np.bincount(of, minlength=len(first))
        sole = left[of] == 1
        for k, c in zip(node[sole].tolist(), cand[sole].tolist(), strict=True):
            take(c, starts[k], starts[k + 1], base + k)
        node, cand = node[~sole], cand[~sole]
        if not len(node):
            return
        if depth + 1 == len(levels):
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
                k, c = node[a], cand[a:b]
                at = slice(starts[k], starts[k + 1])
                d = square[c] - 2 * (x[order[at]].astype(float) @ book[c].T)
                take(c[d.argmin(1)], at.start, at.stop, -1)
            return
        base += len(starts) - 1
        # Both halves of a node get its candidates.
        first = np.append(True, node[1:] != node[:-1])
        of = np.cumsum(first) - 1
        size = np.bincount(of)
        begin = np.cumsum(size) - size
        each = np.repeat(size, 2)
        src = np.repeat(np.repeat(begin, 2), each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        half = np.tile([0, 1], len(size))
        node, cand = 2 * node[src] + np.repeat(half, each), cand[src]


_BLOCK = ["ids", "labels", "x", "order", "lo", "hi", "sums"]


def _blocks(rows: DataFrame, width: int, parts: int, scale: int, label: str) -> DataFrame:
    """Blocks of rows with the trees of all positions, as flat arrays; rows out of range stand in blocks without parts."""
    dims = width // parts
    most = limit(dims)

    def pack(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        trees = [build(x[:, i * dims : (i + 1) * dims]) for i in range(parts)] if len(x) else []
        flat = [x.ravel().astype(np.int32), *(np.concatenate([t[k].ravel() for t in trees]).astype(kind) if trees else np.zeros(0, kind) for k, kind in enumerate((np.int32, np.int32, np.int32, np.int64)))]
        values = [ids, labels, *map(pa.array, flat)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, labels = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            x = np.concatenate([h[2] for h in held])
            held.clear()
            for lo in range(0, len(x), BLOCK):
                yield pack(ids.slice(lo, BLOCK), labels.slice(lo, BLOCK), x[lo : lo + BLOCK])

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(2)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            x = np.floor(x * scale)
            far = (np.abs(x) >= most).any(1)
            if far.any():
                yield pack(b.column(0).filter(pa.array(far)), b.column(1).filter(pa.array(far)), np.zeros((0, width)))
            near = pa.array(~far)
            held.append((b.column(0).filter(near), b.column(1).filter(near), x[~far].astype(np.int64)))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return mapped(rows, run, f"ids array<long>, labels array<{label}>, x array<int>, order array<int>, lo array<int>, hi array<int>, sums array<long>")


def _trees(b: pa.RecordBatch, i: int, width: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, order, lo, hi, sums) of each position of a block."""
    x, order, lo, hi, sums = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 7))
    dims = width // parts
    x = x.reshape(-1, width)
    n, nodes = len(x), len(lo) // (dims * parts)
    for p in range(parts):
        box = slice(p * nodes * dims, (p + 1) * nodes * dims)
        yield x[:, p * dims : (p + 1) * dims], order[p * n : (p + 1) * n], *(v[box].reshape(nodes, dims) for v in (lo, hi, sums))


def _round(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round; books: (position, entry, component), integers."""
    parts, entries, dims = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value.astype(float)
        total, count = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                if not len(b.column(2)[i].values):
                    continue
                for p, (x, order, lo, hi, sums) in enumerate(_trees(b, i, width, parts)):

                    def take(entry, first, end, node, p=p, x=x, order=order, sums=sums) -> None:
                        if node >= 0:
                            total[p, entry] += sums[node]
                            count[p, entry] += end - first
                        else:
                            np.add.at(total[p], entry, x[order[first:end]])
                            np.add.at(count[p], entry, 1)

                    assign(x, order, lo, hi, book[p], take)
        p, e = np.nonzero(count)
        cols = [p, e, count[p, e], *total[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names)

    names = ["p", "e", "n", *(f"s{k}" for k in range(dims))]
    rows = mapped(blocks, run, ", ".join(f"{c} long" for c in names)).groupBy("p", "e").agg(*[F.sum(c).alias(c) for c in names[2:]])
    t = rows.select(*names).toArrow()
    p, e, n, *s = (c.to_numpy() for c in t.columns)
    out = books.copy()
    if len(p):
        out[p, e] = np.stack(s, 1) // n[:, None]
    return out


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id column, code, error, label_error and codebooks_sha256 of every row with a sound vector."""
    v = F.col(vector_column)
    length = F.size(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.where(v.isNotNull() & (length > 0) & (length % parts == 0) & ~F.coalesce(bad, F.lit(True)))
    sound = sound.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), v.alias("v"))
    usual = sound.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    label = vectors.schema[label_column].dataType.simpleString()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_column}` long, code string, error long, label_error long, codebooks_sha256 string")
    width = usual["width"]
    dims = width // parts
    rows = sound.where(F.size("v") == width)
    near = rows.where(~F.exists("v", lambda x: F.abs(F.floor(x.cast("double") * scale)) >= limit(dims)))
    first = near.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column(0)
    start = np.floor(np.array([x.values.to_numpy(zero_copy_only=False) for x in first], float).reshape(-1, width) * scale).astype(np.int64)
    books = start.reshape(-1, parts, dims).transpose(1, 0, 2).copy()
    blocks = written(_blocks(rows.select("id", "label", "v"), width, parts, scale, label), "trees")
    if len(start):
        for _ in range(rounds):
            books = _round(blocks, books, width)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column(0)[i].values, b.column(1)[i].values
                if not len(b.column(2)[i].values):
                    none = pa.nulls(len(ids))
                    yield pa.RecordBatch.from_arrays([ids, none.cast(pa.string()), none.cast(pa.int64()), labels], ["id", "code", "error", "label"])
                    continue
                code = np.empty((len(ids), parts), np.int64)
                error = np.zeros(len(ids), np.int64)
                for p, (x, order, lo, hi, _) in enumerate(_trees(b, i, width, parts)):

                    def take(entry, begin, end, node, p=p, order=order) -> None:
                        code[order[begin:end], p] = entry

                    assign(x, order, lo, hi, book[p].astype(float), take)
                    apart = x - book[p][code[:, p]]
                    error += (apart * apart).sum(1)
                digits = max(2, len(f"{max(len(start) - 1, 0):x}"))
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(text, pa.string()), pa.array(error), labels], ["id", "code", "error", "label"])

    coded = written(mapped(blocks, last, f"id long, code string, error long, label {label}").select("*", F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")), "codes")
    sums = written(coded.groupBy("unlabelled", "key").agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return looked_up(coded, sums, ["unlabelled", "key"]).select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same result in SQL, with every part compared to every entry."""
    floored = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [
        f"k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, e, (i // (len(embedding) // {parts}))::BIGINT AS p, (i % (len(embedding) // {parts}))::BIGINT AS j, floor({scale} * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM k))",
        f"b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM x WHERE e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, p, b.e AS z, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{r} b USING (p, j) GROUP BY vec_id, p, b.e)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := d, z := z)) AS m FROM d{r} GROUP BY vec_id, p)")
        if r < rounds:
            steps.append(f"n{r} AS (SELECT p, a.m.z AS e, j, {floored} AS c FROM x JOIN a{r} a USING (vec_id, p) GROUP BY p, a.m.z, j)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(n.c, b.c)::BIGINT AS c FROM b{r} b LEFT JOIN n{r} n USING (p, e, j))")
    steps.append(f"o AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.z)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS s FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.s AS codebooks_sha256 FROM o JOIN k USING (vec_id), h"

