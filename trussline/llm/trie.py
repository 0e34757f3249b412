"""Prefix trie of conversations, built family by family and then merged.

A family is the conversations of one base id (c - c % 20). Every conversation c
is rebuilt: its first h turns (h = crc32 of its decimal id, mod 4) are those of
the base's conversation, the others its own. A node is a distinct sequence of
first turns; it is known by its depth and a 128-bit hash, the sum of the turns'
hashes times powers of a constant, so the hash of a longer sequence follows from
that of a shorter one.

1. Family first. Turns meet by base id in one shuffle, a cogroup of the
   families' own turns with the first turns of their bases that is read as a
   stream of whole families; each family's conversations are rebuilt and its
   trie is made in memory. Only its combined nodes (members, least member, and
   the members that end there) go on.
2. Long conversations (more than LONG turns) would make a family large, so they
   take another way to the same nodes: their turns are dealt by ranges of
   (conversation, turn), and running counts and hashes are carried from range to
   range. A conversation with a third of all turns is spread over many tasks.
3. Global merging. Family nodes are summed by node. The nodes whose least member
   is one conversation are a chain, the last part of its path; a chain hangs from
   a node of a chain of a smaller id. Sums over subtrees are therefore sums over
   the rest of a chain, by ranges again, plus whole chains hanging from it, whose
   totals come from pointer doubling over the chains: log2 of their nesting steps,
   not one for each level of the trie.

A node's members are never listed but where they end. SHA-256 is sequential, so
the ids that end at one node are put into ready-made text by ranges and one task
reads that text as a stream.

Edge cases: null roles and texts are empty; a null turn comes first; rows of one
turn stand in the order of role and text, repeated rows are turns of their own;
a row without conv_id belongs to no conversation; a conversation whose base is
absent has no first turns but those beyond h (it may have none: then it ends at
the root); no conversations give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.lookup import looked_up

from .common import _P, _PI, _powers, brief_shuffles, mapped, mix64, written

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations to a family, first turns taken from the base below this, turns from which on a conversation is dealt by ranges, rows that are made into tries at once, bytes of ready-made id text.
FAMILY, HEAD, LONG, ROWS, TEXT = 20, 4, 4096, 1 << 16, 1 << 16
_M = (1 << 64) - 1


def _turn_columns() -> list[Column]:
    """Two hashes of a turn (role and text), and its words."""
    return [F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)] + [F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")]


def _terms(h: np.ndarray, power: np.ndarray) -> np.ndarray:
    return mix64(h.view(np.uint64).copy()) * _powers(int(power.max(initial=0)) + 1)[0][power]


def _within(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] times, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, words long, n long, conv long, ends array<long>"


def _family_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of families from rows (base, conv, own, h, h1, h2, words), families together, conversations together in them, in order of turns; a row that is not own is a first turn of a base that is not here."""
    names = [x.split()[0] for x in _NODE.split(", ")]

    def solve(base, conv, own, h, h1, h2, words) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (base[1:] != base[:-1])))
        size = np.diff(np.append(first, len(conv)))
        cb, cc, co, ch = base[first], conv[first], own[first], h[first]
        # Each conversation's base in the same family, if it is there.
        head = cc == cb
        at = np.searchsorted(cb[head], cb)
        at = np.minimum(at, max(head.sum() - 1, 0))
        found = (cb[head][at] == cb) if head.any() else np.zeros(len(cb), bool)
        b_first = np.where(found, first[head][at], 0) if head.any() else np.zeros(len(cb), np.int64)
        b_size = np.where(found, size[head][at], 0) if head.any() else np.zeros(len(cb), np.int64)
        mine = np.flatnonzero(co)
        cb, cc, first, size, ch, b_first, b_size = (v[mine] for v in (cb, cc, first, size, ch, b_first, b_size))
        m, rest = np.minimum(ch, b_size), np.maximum(size - ch, 0)
        n = np.stack([m, rest], 1).ravel()
        src = _within(np.stack([b_first, first + ch], 1).ravel(), n)
        length = m + rest
        of = np.repeat(np.arange(len(cc)), length)
        depth = _within(np.zeros(len(cc), np.int64), length)  # from 0
        begin = np.cumsum(length) - length
        keys = []
        for v in (h1, h2):
            s = np.append(np.uint64(0), np.cumsum(_terms(v[src], depth), dtype=np.uint64))
            keys.append((s[1:] - s[begin[of]], s[begin + length] - s[begin]))
        (k1, e1), (k2, e2) = keys
        p1, p2 = (np.where(depth > 0, np.append(np.uint64(0), k[:-1]), np.uint64(0)) for k in (k1, k2))
        # A root for each conversation too; ends are the keys of whole conversations.
        zero = np.zeros(len(cc), np.uint64)
        fam = np.concatenate([cb, cb[of]])
        d = np.concatenate([np.zeros(len(cc), np.int64), depth + 1])
        k1, k2, p1, p2 = (np.concatenate([zero, v]) for v in (k1, k2, p1, p2))
        w = np.concatenate([np.zeros(len(cc), np.int64), words[src]])
        c = np.concatenate([cc, cc[of]])
        is_end = np.concatenate([length == 0, depth + 1 == length[of]])
        order = np.lexsort((c, k2, k1, d, fam))
        fam, d, k1, k2, p1, p2, w, c, is_end = (v[order] for v in (fam, d, k1, k2, p1, p2, w, c, is_end))
        new = np.append(True, (fam[1:] != fam[:-1]) | (d[1:] != d[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) if len(c) else np.zeros(0, bool)
        g = np.flatnonzero(new)
        n = np.diff(np.append(g, len(c)))
        ends = np.append(0, np.cumsum(np.add.reduceat(is_end.astype(np.int64), g))) if len(g) else np.zeros(1, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(c[is_end]))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[g], *(k[g].view(np.int64) for k in (k1, k2, p1, p2)), w[g], n, c[g])] + [lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def columns(t: pa.Table) -> list[np.ndarray]:
            return [c.to_numpy() if k != 2 else c.to_numpy().astype(bool) for k, c in enumerate(t.columns)]

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                base = t.column(0).to_numpy()
                cut = int(np.flatnonzero(base == base[-1])[0])  # the last family may go on
                if cut:
                    yield solve(*columns(t.slice(0, cut)))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if held:
            yield solve(*columns(pa.Table.from_batches(held).combine_chunks()))

    return mapped(rows.select("base", "conv", "own", "h", "h1", "h2", "words"), run, _NODE)


def running(rows: DataFrame, key: str, values: list[str], name: str, hashes: bool = False) -> DataFrame:
    """rows with the running sum of each value (v_to) by key, in the order in which they come: by key, in ranges.

    hashes: the first value counts, and the others are hashes of turns, of
    which the running hash of the sequence is formed. A key may span any
    number of partitions: what each has is summed by Spark, and what has come
    before a partition's first key is at most one row a partition.
    """
    names, sums = list(rows.columns), [f"{v}_to" for v in values]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, [0] * len(values)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            before = carry if last == k[0] else [0] * len(values)
            cols, out = [b.column(v).to_numpy(zero_copy_only=False) for v in values], []
            for i, v in enumerate(cols):
                if hashes and i:
                    v = _terms(v, out[0].view(np.int64) - 1)
                s = np.cumsum(v.astype(np.int64).view(np.uint64) if v.dtype != np.uint64 else v, dtype=np.uint64)
                shift = np.append(np.uint64(0), s)[first]
                shift[0] -= np.uint64(before[i] & _M)
                out.append(s - shift[of])
            last, carry = k[-1], [int(v[-1]) for v in out]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v.view(np.int64)) for v in out), pa.array(np.full(len(k), part, np.int32))], [*b.schema.names, *sums, "part"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    stored = written(mapped(rows, local, kinds + "".join(f", {s} long" for s in sums) + ", part int"), name)
    span = [(r["part"], r["lo"], r["hi"]) for r in stored.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("part").collect()]
    split = {hi for (_, _, hi), (_, lo, _) in zip(span, span[1:], strict=False) if hi == lo}
    before: dict[tuple[int, int], list[int]] = {}
    if split:
        # The last row of a key in a partition has what the partition holds of it.
        upto = stored.where(F.col(key).isin([int(k) for k in split])).groupBy(key, "part").agg(F.max_by(F.struct(*sums), f"{values[0]}_to").alias("s"))
        total: dict[int, list[int]] = {}
        for r in sorted(upto.collect(), key=lambda r: (r[0], r[1])):
            own = [int(x) & _M for x in r["s"]]
            old = total.get(r[0], [0] * len(values))
            before[r[1], r[0]] = old
            power = pow(_P, old[0], 1 << 64) if hashes else 1
            total[r[0]] = [(o + (x * power if i else x)) & _M for i, (o, x) in enumerate(zip(old, own, strict=True))]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, part = (b.column(c).to_numpy(zero_copy_only=False) for c in (key, "part"))
            cols = [b.column(s).to_numpy(zero_copy_only=False).view(np.uint64).copy() for s in sums]
            for (p, of), old in before.items():
                at = (part == p) & (k == of)
                if at.any():
                    power = np.uint64(pow(_P, old[0], 1 << 64)) if hashes else np.uint64(1)
                    for i, c in enumerate(cols):
                        c[at] = (c[at] * power if i else c[at]) + np.uint64(old[i])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c.view(np.int64)) for c in cols)], [*names, *sums])

    return mapped(stored, added, kinds + "".join(f", {s} long" for s in sums))


def _power(k: np.ndarray) -> np.ndarray:
    """The constant to the power k (64 bits), by squaring, for places that no table reaches; below 0, powers of its inverse."""
    out = np.ones(len(k), np.uint64)
    for base, left in ((_P, np.maximum(k, 0)), (_PI, np.maximum(-k, 0))):
        left = left.copy()
        while left.any():
            out = np.where(left & 1, out * np.uint64(base), out)
            base, left = base * base & _M, left >> 1
    return out


def _unsigned(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names]


def _long_nodes(heads: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of long conversations, those of the base's turns and those of their own.

    numbered: (conv, h, idx, h1, h2, words, r1, r2), r: hash of the turns up to
    this one; heads: (conv, idx, h1, h2, words), first turns of their bases.
    """
    names = [x.split()[0] for x in _NODE.split(", ")]
    convs = numbered.groupBy("conv", "h").agg(F.max("idx").alias("most"), *[F.coalesce(F.max(F.when(F.col("idx") == F.col("h") - 1, F.col(f"r{k}"))), F.lit(0)).cast("long").alias(f"s{k}") for k in (1, 2)])
    first = heads.select(F.col("conv").alias("base"), "idx", "h1", "h2", "words")
    lead = convs.join(first, (F.col("conv") - F.col("conv") % FAMILY == F.col("base")) & (F.col("idx") < F.col("h")), "left")
    lead = lead.groupBy("conv", "h", "most", "s1", "s2").agg(F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "h1", "h2", "words")))).alias("lead"))
    lead = written(lead, "lead")

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The root and the nodes of the base's turns."""
        for b in batches:
            out: list[tuple] = []
            for conv, h, most, s1, s2, turns in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                keys = [(0, 0)]
                for i, x in enumerate(turns):
                    term = _terms(np.array([x["h1"], x["h2"]]), np.array([i, i]))
                    keys.append(tuple((keys[-1][k] + int(term[k])) & _M for k in (0, 1)))
                for i, (k1, k2) in enumerate(keys):
                    out.append((i, k1, k2, *keys[max(i - 1, 0)], turns[i - 1]["words"] if i else 0, 1, conv, [conv] if most < h and i == len(turns) else []))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) if 0 < k < 5 else pa.array(c, pa.list_(pa.int64()) if k == 8 else pa.int64()) for k, c in enumerate(cols)], names)

    top = written(mapped(lead, above, _NODE), "long-nodes")
    last = top.groupBy(F.col("conv").alias("of")).agg(F.max(F.struct("depth", "k1", "k2")).alias("m"))
    plan = written(lead.join(last, F.col("conv") == F.col("of")).select("conv", "most", "s1", "s2", F.col("m.depth").alias("m"), F.col("m.k1").alias("a1"), F.col("m.k2").alias("a2")), "plan")
    rows = looked_up(written(numbered.where("idx >= h"), "own"), plan, ["conv"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, h, idx, m, most, words = (b.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "h", "idx", "m", "most", "words"))
            shift, own = _power(m - h), _power(idx)
            keys, parents = [], []
            for turn, r, s, a in (_unsigned(b, [f"{c}{k}" for c in "hrsa"]) for k in (1, 2)):
                keys.append(a + (r - s) * shift)
                parents.append(a + (r - mix64(turn.copy()) * own - s) * shift)
            is_end = idx == most
            ends = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(is_end)).astype(np.int32)), pa.array(conv[is_end]))
            yield pa.RecordBatch.from_arrays([pa.array(m + idx - h + 1), *(pa.array(k.view(np.int64)) for k in (*keys, *parents)), pa.array(words), pa.array(np.ones(len(conv), np.int64)), pa.array(conv), ends], names)

    return top, mapped(rows, below, _NODE)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from (depth, k1, k2, conv)."""
    node = ["depth", "k1", "k2"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ready-made text of ids that follow each other at one node."""
        for b in batches:
            rows: list[tuple] = []
            for *k, conv in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and rows[-1][0] == k and len(rows[-1][2]) < TEXT:
                    rows[-1][2].extend(f",{conv}".encode())
                else:
                    rows.append((k, conv, bytearray(str(conv).encode())))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.int64()), pa.array([bytes(r[2]) for r in rows], pa.binary())], [*node, "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, hashlib.sha256()
        for b in batches:
            rows = []
            for *k, _, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k == last:
                    sha.update(b"," + ids)
                else:
                    if last is not None:
                        rows.append((*last, sha.hexdigest()))
                    last, sha = k, hashlib.sha256(ids)
            yield batch(rows)
        if last is not None:
            yield batch([(*last, sha.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        d, k1, k2, s = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (d, k1, k2)), pa.array(s, pa.string())], [*node, "ends_sha256"])

    ready = mapped(ends.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").select(*node, "conv"), texts, "depth long, k1 long, k2 long, conv long, ids binary")
    return mapped(ready.repartition(*node).sortWithinPartitions(*node, "conv"), digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _chain_totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """(chain, totals) of every chain with all that hangs from it, from (chain, parent, values), by pointer doubling."""
    now = written(chains.select("chain", F.col("parent").alias("up"), *values), "chains")
    while True:
        up = now.where("up is not null")
        if up.isEmpty():
            return now.select("chain", *values)
        more = up.groupBy(F.col("up").alias("chain")).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        far = looked_up(now, written(now.select(F.col("chain").alias("up"), F.col("up").alias("next")), "ups"), ["up"])
        now = written(far.join(more, "chain", "left").select("chain", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]), "chains")


def conversation_trie(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node; see the module."""
    with brief_shuffles(conversations.sparkSession):  # those of a step go when its table is written
        return _trie(conversations, long)


def _trie(conversations: DataFrame, long: int) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD)).cast("long").alias("h")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *text, h)
    base = F.col("conv") - F.col("conv") % FAMILY
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    large = written(turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv"), "long")
    some = not large.isEmpty()
    short = turns.join(large, "conv", "leftanti") if some else turns
    known = [F.lit(None).cast("long").alias(c) for c in ("g1", "g2", "gw")]
    rows = short.select(base.alias("base"), "conv", F.lit(True).alias("own"), "h", "turn", "role", "text", *known)
    if some:
        dealt = turns.join(large, "conv", "leftsemi").repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).select("conv", "h", F.lit(1).cast("long").alias("idx"), *_turn_columns())
        numbered = running(dealt.select("*", F.col("h1").alias("r1"), F.col("h2").alias("r2")), "conv", ["idx", "r1", "r2"], "long", hashes=True)
        numbered = written(numbered.select("conv", "h", (F.col("idx_to") - 1).alias("idx"), "h1", "h2", "words", F.col("r1_to").alias("r1"), F.col("r2_to").alias("r2")), "numbered")
        heads = numbered.where((F.col("idx") < HEAD - 1) & (F.col("conv") % FAMILY == 0)).select("conv", "idx", "h1", "h2", "words")
        # First turns of long bases for the short members of their families, and of all bases for the long ones.
        turn = turns.schema["turn"].dataType
        rows = rows.unionByName(heads.select(F.col("conv").alias("base"), "conv", F.lit(False).alias("own"), F.lit(0).cast("long").alias("h"), F.col("idx").cast(turn).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("gw")))
        wanted = large.select(base.alias("conv")).distinct()
        few = short.join(wanted, "conv", "leftsemi").groupBy("conv").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("late"), "turn", "role", "text"))), 1, HEAD - 1).alias("t"))
        few = few.select("conv", F.posexplode("t").alias("idx", "x")).select("conv", F.col("idx").cast("long").alias("idx"), "x.role", "x.text").select("conv", "idx", *_turn_columns())
        heads = written(heads.unionByName(few), "heads")
    h1, h2, words = _turn_columns()
    dealt = rows.repartition("base").sortWithinPartitions("base", "conv", *order).select("base", "conv", "own", "h", F.coalesce("g1", h1).alias("h1"), F.coalesce("g2", h2).alias("h2"), F.coalesce("gw", words).alias("words"))
    nodes = written(_family_nodes(dealt), "family-nodes")
    if some:
        for more in _long_nodes(heads, numbered):
            nodes = nodes.unionByName(more)
    return _merged(nodes)


def _merged(nodes: DataFrame) -> DataFrame:
    key = ["depth", "k1", "k2"]
    merged = written(nodes.groupBy(*key).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("p1", "p2", "words")]), "nodes")
    ends = _digests(nodes.where("size(ends) > 0").select(*key, F.explode("ends").alias("conv")))
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    merged = written(
        merged.join(children, key, "left").join(ends, key, "left")
        .select(*key, "conv", "n", "p1", "p2", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
        .withColumn("leaves", (F.col("children") == 0).cast("long")),
        "nodes",
    )
    # Chains: the nodes of one least member; where each begins, and the node that it hangs from.
    chains = merged.groupBy(F.col("conv").alias("chain")).agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = written(chains.select("chain", F.col("top.depth").alias("top"), (F.col("top.depth") - 1).alias("depth"), F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2"), "saved", "leaves"), "chains")
    chains = written(looked_up(chains, merged.select(*key, F.col("conv").alias("parent")), key).select("chain", "top", "parent", "saved", "leaves"), "chains")
    totals = _chain_totals(chains, ["saved", "leaves"])
    hung = chains.select("chain", "top", "parent").where("parent is not null").join(totals, "chain").groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("saved").alias("saved_more"), F.sum("leaves").alias("leaves_more"))
    tops = chains.select(F.col("chain").alias("conv"), F.col("top").alias("depth"), "parent", F.lit(True).alias("is_top"))
    rows = merged.join(hung, ["conv", "depth"], "left").join(tops, ["conv", "depth"], "left")
    rows = rows.select("conv", "depth", F.when(F.col("is_top").isNull(), F.col("conv")).otherwise(F.col("parent")).alias("parent"), "n", "children", "ends_sha256", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in ("saved", "leaves")])
    # From the deepest node of a chain upwards.
    dealt = rows.repartitionByRange("conv", F.desc("depth")).sortWithinPartitions("conv", F.desc("depth")).withColumn("step", F.lit(1).cast("long"))
    out = running(dealt, "conv", ["step", "saved", "leaves"], "rows")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"), F.col("leaves_to").alias("n_leaves"), F.col("saved_to").alias("saved_tokens"), "ends_sha256")


#: The same result in SQL.
SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(fold, 4294967295) % 4 AS h FROM (
    SELECT c, list_reduce([4294967295::BIGINT] || list_transform(range(length(c::VARCHAR)::BIGINT), lambda i: ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS fold
    FROM (SELECT DISTINCT c FROM t))),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS own FROM t GROUP BY c),
b AS (
  SELECT o.c, list_concat(coalesce(list_slice(p.own, 1, crc.h), []), list_slice(o.own, crc.h + 1, len(o.own))) AS s
  FROM o JOIN crc USING (c) LEFT JOIN o p ON p.c = o.c - o.c % 20),
m AS (SELECT c, d, list_slice(s, 1, d)::VARCHAR AS k, list_slice(s, 1, d - 1)::VARCHAR AS pk, len(s) AS n, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM b)),
g AS (SELECT d, k, min(CASE WHEN d > 0 THEN pk END) AS pk, min(c) AS conv, count(*) AS n, max(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY d, pk),
v AS (SELECT g.*, coalesce(kids.n, 0) AS kids FROM g LEFT JOIN kids USING (d, k)),
sub AS (SELECT a.d, a.k, sum((v.kids = 0)::BIGINT) AS leaves, sum((v.n - 1) * v.w) AS saved FROM v JOIN m a ON a.c = v.conv AND a.d <= v.d GROUP BY a.d, a.k)
SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN sub USING (d, k) LEFT JOIN v p ON p.d = v.d - 1 AND p.k = v.pk
"""
