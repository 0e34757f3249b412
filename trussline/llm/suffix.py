"""Removal of byte strings that repeat in a corpus, by external induced sorting with common-prefix values.

A window is a string of WIDTH bytes inside one document. The windows that occur
again are found by sorting suffixes, without a suffix array of everything:

1. Sampling. A gram has HALF = WIDTH / 2 bytes; a window's anchor is its gram
   of least hash, the leftmost of equals. Equal windows have their anchors at
   equal places, and about one position in HALF is an anchor: these are the
   sampled suffixes, named by their gram's hash. Each window belongs to one.
2. Discarding. A name that occurs once can't be part of a repeat, and occurrences
   of a name that agree in all bytes of all their windows need no order between
   them: their windows repeat. Names meet in Spark's shuffle, whose sort and
   aggregation spill to disk; these are the external queues that carry the
   tuples (name, digest of the span, document, place).
3. Induction. What is left are names with several different contexts. They are
   dealt to shards by name with the bytes about them; in a shard the sampled
   suffixes are sorted by their right context, with the common-prefix value of
   neighbours, and the order of the suffixes one byte further left is induced
   from theirs by one stable counting sort on that byte, common prefixes carried
   along by a range minimum, HALF times. A window repeats exactly if its common
   prefix with the suffix before or after it in that order reaches WIDTH. There
   are no pairs: a name with thousands of contexts costs their number, not its
   square. A shard reads its tuples in name order as a stream and holds a block
   of them and one batch more, so shards can be far larger than memory. Names of
   more than BLOCK contexts are not dealt by name: each of their windows (HALF + 1
   a context at most) becomes a tuple (digest, document, place), occurrences are
   counted by digest with partial sums, and the repeated digests are joined back,
   so that no task holds such a name.

Repeats are judged on the input, in the same document too; matches never cross
documents; names (64-bit hashes) only gather candidates of step 3, whose bytes
are compared; step 2 compares spans, and step 3 windows of names of more than
BLOCK contexts, by a digest of 128 bits.

Texts are known by their id and a hash of id and text, so rows with one id and
several texts, or without an id, are documents of their own.

Passages of more than a number of words (``shared_passages``) are found by the
same sampling over words: of each so many words in a row the gram of half as many
with the least hash is an anchor, so a passage of that many words that occurs
again has an anchor in common with its copy.

Edge cases: null and empty texts, and those shorter than a window, have nothing
removed; a null id takes part like any other; repeated rows are occurrences of
their own, and what is removed is removed from each; empty input gives no rows;
other columns are ignored here, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief_shuffles, chunks, discard, flagged, mapped, mix64, passing, prefix_hash, span_hash, sums, words, written

WIDTH = 400
#: Parts that the occurrences of one span are gathered in.
SLICES = 256
#: Bits of a segment's positions; longer documents are sampled in segments that overlap by a window. Contexts sorted in one block.
PLACE_BITS, BLOCK = 23, 20_000
SEGMENT = (1 << PLACE_BITS) - 1
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = np.full(-len(v) % w, np.iinfo(v.dtype).max, v.dtype)
    x = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor in it, bytes from its first and from its last window to it, name, two digests of its span) of all anchors."""
    half = width // 2
    s = prefix_hash(data)
    # A second, independent digest over the reversed byte values.
    s2 = prefix_hash(data ^ np.uint8(0xA5))
    n = len(data)
    out: list[tuple[np.ndarray, ...]] = []
    if n >= width:
        for lo in range(0, n - width + 1, SEGMENT - width):
            hi = min(n, lo + SEGMENT)
            at = np.arange(lo, hi - half + 1)
            v = mix64(span_hash(s, at, at + half) + _C)
            key = (v >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | (at - lo).astype(np.uint64)
            least = _sliding_min(key, width - half + 1)
            place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + lo
            start = np.arange(lo, lo + len(place))
            own = SEGMENT - width
            if hi < n:
                start, place = start[:own], place[:own]
            doc = np.searchsorted(offs, start, "right") - 1
            good = start + width <= offs[doc + 1]
            start, place, doc = start[good], place[good], doc[good]
            if not len(start):
                continue
            cut = np.flatnonzero((place[1:] != place[:-1]) | (doc[1:] != doc[:-1])) + 1
            a, b = np.append(0, cut), np.append(cut, len(start)) - 1
            first, last, p = start[a], start[b], place[a]
            end = last + width
            out.append((doc[a], p - offs[doc[a]], p - first, p - last, span_hash(s, p, p + half), span_hash(s, first, end), span_hash(s2, first, end)))
            if hi == n:
                break
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_anchors(data: np.ndarray, offs: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of the anchors of all windows of so many words."""
    h, at = words(data, offs)
    half = count // 2
    s = sums(h)
    i = np.arange(max(len(h) - half + 1, 0))
    v = span_hash(s, i, i + half)
    # The place within the words settles ties: the leftmost of equals.
    least = _sliding_argmin(v, count - half + 1)
    start = np.arange(len(least))
    doc = np.searchsorted(at, start, "right") - 1
    good = start + count <= at[doc + 1]
    place, doc = least[good], doc[good]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], v[place[new]]


def _sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w values in a row, the leftmost of equals."""
    rank = np.empty(len(v), np.int64)
    rank[np.argsort(v, kind="stable")] = np.arange(len(v))
    return np.argsort(rank)[_sliding_min(rank, w)] if len(v) >= w else np.zeros(0, np.int64)


def shared_passages(base: DataFrame, count: int) -> DataFrame:
    """(sid, sh, shared): how many anchors of windows of count words occur in other rows too, of the texts that have any; from (id, h, text)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, offs in chunks(b):
                doc, name = word_anchors(data, offs, count)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[lo + doc], pa.int64()), pa.array(hashes[lo + doc], pa.int64())], ["name", "id", "h"])

    rows = written(mapped(base, sample, "name long, id long, h long").groupBy("name", "id", "h").agg(F.count("*").alias("n")), "passages")
    again = rows.groupBy("name").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("name").alias("again"))
    return rows.join(again, F.col("name") == F.col("again"), "leftsemi").groupBy(F.col("id").alias("sid"), F.col("h").alias("sh")).agg(F.sum("n").alias("shared"))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows of bytes."""
    diff = a != b
    at = diff.argmax(1)
    return np.where(diff.any(1), at, a.shape[1])


def induced_repeats(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, bytes left of the anchor) of every window that another row of its group repeats.

    group: numbers, ascending. left, right: matrices of the bytes before each
    anchor, nearest first, and from it on. low, high: which windows a row has
    (bytes from their start to the anchor); bytes beyond them are zero and not
    compared.
    """
    n, depth, rows, lefts = len(group), left.shape[1], [], []
    # Sampled suffixes in order of group and right context; zeros beyond the text sort as bytes, and lengths keep them apart.
    keys = np.ascontiguousarray(right).view(f"S{right.shape[1] * right.itemsize}").ravel()
    order = np.lexsort((np.argsort(np.argsort(keys, kind="stable"), kind="stable"), group))
    r, g = right[order], group[order]
    lcp = np.zeros(n, np.int32)  # with the suffix before
    lcp[1:] = np.where(g[1:] == g[:-1], _common(r[1:], r[:-1]), -1)
    lcp[:1] = -1
    for o in range(depth + 1):
        if o:
            # One byte further left: a stable sort on (group, byte) of the order so far, by bytes first within each group.
            c = left[order, o - 1].astype(np.int64) + group[order] * 512
            move = np.argsort(c, kind="stable")
            cs = c[move]
            same = np.flatnonzero(cs[1:] == cs[:-1]) + 1
            fresh = np.full(n, -1, np.int32)
            g = group[order][move]
            fresh[np.flatnonzero(g[1:] == g[:-1]) + 1] = 0
            if len(same):
                ends = np.stack([move[same - 1] + 1, move[same] + 1], 1).ravel()
                padded = np.append(lcp, 0)
                fresh[same] = np.minimum.reduceat(padded, ends)[::2] + 1
            order, lcp = order[move], fresh
        best = lcp.copy()
        best[:-1] = np.maximum(best[:-1], lcp[1:])
        hit = order[best >= width]
        hit = hit[(low[hit] <= o) & (o <= high[hit])]
        rows.append(hit)
        lefts.append(np.full(len(hit), o, np.int64))
    return np.concatenate(rows), np.concatenate(lefts)


def _runs(row: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of maximal runs of windows that start side by side."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    cut = np.flatnonzero((row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    a, b = np.append(0, cut), np.append(cut, len(row)) - 1
    return row[a], start[a], start[b] + width


def _touching(found: Column) -> Column:
    """Spans (id, h, first, end), in order, with those of one text that overlap or touch as one."""

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["id"].alias("id"), last["h"].alias("h"), last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (last["id"] == x["id"]) & (last["h"] == x["h"]) & (x["first"] <= last["end"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(found, F.array().cast("array<struct<id:bigint,h:bigint,first:bigint,end:bigint>>"), add)


def repeated_spans(base: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, h, first, end): spans of bytes that repeated windows cover, from (id, h, text); spans may overlap."""
    half = width // 2

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, offs in chunks(b):
                doc, at, high, low, name, x, y = anchors(data, offs, width)
                cols = [*(pa.array(v.view(np.int64)) for v in (name, x, y)), *(pa.array(v[lo + doc], pa.int64()) for v in (ids, hashes)), pa.array(at.astype(np.int32)), pa.array(high.astype(np.int16)), pa.array(low.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(cols, ["name", "x", "y", "id", "h", "at", "high", "low"])

    tuples = written(mapped(base, sample, "name long, x long, y long, id long, h long, at int, high smallint, low smallint"), "anchors")
    spans = ["name", "x", "y", "high", "low"]
    # One row per distinct span of a name: how often it occurs, and one occurrence that stands for all.
    every = written(tuples.groupBy(*spans).agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "at")).alias("one")), "spans")
    names = every.groupBy("name").agg(F.sum("n").alias("uses"), F.count("*").alias("kinds")).where("uses > 1")
    kinds = written(every.join(names, "name"), "kinds")
    discard(every)
    whole = kinds.where("n > 1").select(*spans)
    # Occurrences meet their span by the slice: a span with any number of them is SLICES rows at most, dealt to as
    # many tasks; those of one text that touch are one span of it.
    where = F.struct("id", "h", (F.col("at") - F.col("high")).cast("long").alias("first"), (F.col("at") - F.col("low") + width).cast("long").alias("end"))
    sliced = passing(tuples, "name", whole, "name").groupBy(*spans, F.pmod(F.col("h"), F.lit(SLICES)).alias("slice")).agg(_touching(F.array_sort(F.collect_list(where))).alias("found"))
    spread = sliced.join(whole, spans, "leftsemi").repartition("name", "slice").select(F.explode("found").alias("f")).select("f.*")
    block = BLOCK
    many = F.col("kinds") > block
    rest = kinds.where("kinds > 1").select("name", F.col("one.id").alias("id"), F.col("one.h").alias("h"), F.col("one.at").alias("at"), "high", "low", F.col("n").alias("n"), many.alias("many"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows: list[tuple] = []
                for doc, h, text, spots in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = (text or "").encode()
                    for s in spots:
                        at = s["at"]
                        end = at - s["low"] + width
                        if end <= len(raw):
                            rows.append((s["name"], doc, h, at, s["high"], s["low"], s["n"], raw[at - s["high"] : end]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)], ["name", "id", "h", "at", "high", "low", "n", "bytes"])

    def with_bytes(wanted: DataFrame) -> DataFrame:
        asked = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("name", "at", "high", "low", "n")).alias("spots"))
        there = passing(base, "h", wanted, "h").join(asked, ["id", "h"]).select("id", "h", "text", "spots")
        return mapped(there, contexts, "name long, id long, h long, at int, high smallint, low smallint, n long, bytes binary")

    shards = with_bytes(rest.where("not many")).repartition("name").sortWithinPartitions("name")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            name, ids, hashes, at, high, low, n = (t.column(i).to_numpy() for i in range(7))
            raw = t.column(7).to_pylist()
            group = np.cumsum(np.append(0, name[1:] != name[:-1]))
            high, low = high.astype(np.int64), low.astype(np.int64)
            # Zero stands for "beyond the row's windows"; where a text has zero bytes itself, all bytes move up by one.
            wide = any(b"\0" in x for x in raw)
            kind = np.dtype(">u2" if wide else "u1")
            left, right = np.zeros((len(raw), half), kind), np.zeros((len(raw), width), kind)
            for i, x in enumerate(raw):
                v = np.frombuffer(x, np.uint8).astype(kind) + wide
                h = high[i]
                left[i, :h] = v[:h][::-1]
                right[i, : len(v) - h] = v[h:]
            row, o = induced_repeats(group, left, right, low, high, width)
            keep = n[row] == 1  # the others are repeated as they are
            row, o = row[keep], o[keep]
            if len(row):
                row, first, end = _runs(row, at[row].astype(np.int64) - o, width)
            else:
                first = end = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(hashes[row], pa.int64()), pa.array(first), pa.array(end)], ["id", "h", "first", "end"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= block:
                t = pa.Table.from_batches(held).combine_chunks()
                name = t.column(0).to_numpy()
                cut = int(np.searchsorted(name, name[-1]))  # the last name may go on
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                ids, hashes, at, high, low, n = (b.column(i).slice(lo, 512).to_numpy(zero_copy_only=False) for i in range(1, 7))
                raw = b.column(7).slice(lo, 512).to_pylist()
                at, high, low = at.astype(np.int64), high.astype(np.int64), low.astype(np.int64)
                offs = np.append(0, np.cumsum([len(x) for x in raw]))
                of = high - low + 1
                row = np.repeat(np.arange(len(raw)), of)
                k = np.arange(len(row)) - (np.cumsum(of) - of)[row]
                data, place = np.frombuffer(b"".join(raw), np.uint8), offs[row] + k
                x, y = (span_hash(prefix_hash(v), place, place + width).view(np.int64) for v in (data, data ^ np.uint8(0xA5)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, ids[row], hashes[row], (at - high)[row] + k, n[row])], ["x", "y", "id", "h", "first", "n"])

    out = spread.unionByName(shards.mapInArrow(induce, "id long, h long, first long, end long"))
    large = rest.where("many")
    if large.isEmpty():
        return out
    parts = written(with_bytes(large).mapInArrow(windows, "x long, y long, id long, h long, first long, n long"), "windows")
    again = parts.groupBy("x", "y").agg(F.sum("n").alias("uses")).where("uses > 1").select("x", "y")
    # Those of contexts that occur again are repeated as they are.
    return out.unionByName(parts.where("n = 1").join(again, ["x", "y"]).select("id", "h", "first", (F.col("first") + width).alias("end")))


def _merged(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["first"], min(x["end"], n)) for x in spans):
        if s[0] >= s[1]:
            continue
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, carry: Sequence[str] = (), passages: int | None = None) -> DataFrame:
    """id column, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked for, kept_text, columns to carry, and shared_passages) of every row.

    kept_text is the remaining bytes as UTF-8; a character of which a part was
    removed goes with it. passages: shared_passages counts the anchors of windows
    of so many words that occur in other documents too.
    """
    with brief_shuffles(docs.sparkSession):  # those of a step go when its table is written
        return _dedup(docs, width, id_column, text_column, with_text, carry, passages)


def _dedup(docs: DataFrame, width: int, id_column: str, text_column: str, with_text: bool, carry: Sequence[str], passages: int | None) -> DataFrame:
    named = {f"c{i}": c for i, c in enumerate(carry)}
    own = F.col(id_column).cast("long")
    base = docs.select(F.coalesce(own, F.lit(-1)).alias("id"), F.xxhash64(own.isNull(), own, text_column).alias("h"), F.col(text_column).alias("text"), own.isNull().alias("nameless"), *[F.col(c).alias(k) for k, c in named.items()])
    texts = base.select("id", "h", "text").where("text <> ''")
    spans = repeated_spans(texts, width)
    by_doc = spans.groupBy(F.col("id").alias("sid"), F.col("h").alias("sh")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    if passages is None:
        by_doc = by_doc.withColumn("shared", F.lit(None).cast("long"))
    else:
        by_doc = by_doc.join(shared_passages(texts, passages), ["sid", "sh"], "fullouter")
    by_doc = written(by_doc, "spans")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for doc, text, found in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = (text or "").encode()
                    gone = _merged(found or [], len(raw))
                    kept, at = [], 0
                    for s, e in gone:
                        kept.append(raw[at:s])
                        at = e
                    left = b"".join([*kept, raw[at:]])
                    rows.append((doc, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *part.columns[3:]], names + part.schema.names[3:])

    text = F.coalesce("text", F.lit(""))
    plain = [F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), (text if with_text else F.lit(None).cast("string")).alias("kept_text")]
    # Texts move only where there is something to remove (or the filter can't tell); all others are done where they are read.
    more = [*named, "nameless"]
    touched = flagged(base, "h", by_doc, "sh")
    clean = touched.where("not _hit").select("id", *plain, *more, F.lit(None).cast("long").alias("shared"))
    moved = touched.where("_hit").join(by_doc, (F.col("id") == F.col("sid")) & (F.col("h") == F.col("sh")), "left").select("id", "text", "spans", *more, "shared")
    kinds = "".join(f", {k} {base.schema[k].dataType.simpleString()}" for k in more)
    out = clean.unionByName(mapped(moved, cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string" + kinds + ", shared long"))
    last = [F.coalesce("shared", F.lit(0).cast("long")).alias("shared_passages")] if passages is not None else []
    return out.select(F.when(~F.col("nameless"), F.col("id")).alias(id_column), *names[1 : 6 if with_text else 5], *[F.col(k).alias(c) for k, c in named.items()], *last)
