"""Best-fit packing of documents into training sequences, by hierarchical residual packing.

Every text is tokenized whole (in the executors), closed with an end id, and
cut into pieces only where it is longer than a sequence: the first piece takes
the remainder, all others fill a sequence of their own. The remainders are
packed in rounds. In each round every partition packs its items best-fit,
longest first, and emits the bins that are nearly full or that no remaining
item fits; the underfull bins go on as items of their own, in an eighth of the
partitions, until one small partition is left. Only (id, piece, length) moves;
a partition never holds more than ``PER_TASK`` items, and what a round keeps
has its lineage cut by a written table.

Edge cases: a null text counts as empty and packs as the end id alone; empty
input gives no rows; repeated rows and repeated ids are packed as rows of their
own; a null id stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: Most items that one task packs in one round, and tokens that a nearly full bin may lack.
PER_TASK, SLACK, FAN_IN = 100_000, 8, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
CACHE = 200_000

#: Characters for which Python's own character classes agree with the vocabulary's pattern; other texts take the tokenizer's own splitter.
_UNSAFE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e -©«-±´¶-¸»¿-ɏ‐-‧]")
#: The vocabulary's own pattern, in Python's classes.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class ByteBpe:
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer file (JSON) gives them without adding special tokens.

    A special token of the file that stands in a text is that token. The other
    pieces are merged by the same vocabulary as ranks, which is faster for the
    many short pieces; what it gave is kept in a bounded cache.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers as public
        import tiktoken

        with open(ranks or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=public.PATTERN, mergeable_ranks=pairs, special_tokens={})
        with open(vocabulary or public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not self.parts or not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(self.parts.split(text)))

    def _plain(self, text: str) -> bytes:
        known, one = self.known, self.enc.encode_ordinary
        if _UNSAFE.search(text):
            return np.array(one(text), "<u4").tobytes()
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in _SPLIT.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = array("I", one(w)).tobytes()
            out.append(ids)
        return b"".join(out)


@lru_cache(1)
def tokenizer(vocabulary: str | None) -> ByteBpe:
    return ByteBpe(vocabulary)


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, item (a number of its own) and, if asked for, the ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text or "") + end
                    n = len(ids) // 4
                    start, stop, k = 0, (n - 1) % size + 1, 0
                    while start < n:
                        own = ids[4 * start : 4 * stop]
                        for col, v in zip(out, (doc, k, start, stop - start, zlib.crc32(own), own if with_ids else None), strict=True):
                            col.append(v)
                        start, stop, k = stop, stop + size, k + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names if with_ids else names[:5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), cut, schema).withColumn("item", F.monotonically_increasing_id())


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each item, longest first into the fullest bin that it fits."""
    order = np.argsort(-lengths, kind="stable")
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # bins by room left
    rooms: list[int] = []  # those in use, ascending
    bins = np.empty(len(lengths), np.int64)
    made = 0
    for i in order:
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(k)
        else:
            room, b, made = size, made, made + 1
        bins[i] = b
        left = room - n
        if left:
            if not open_at[left]:
                bisect.insort(rooms, left)
            open_at[left].append(b)
    return bins


def _round(items: DataFrame, parts: int, size: int, least: int, last: bool) -> DataFrame:
    """(item, length, bin, used, done): what each partition packed; a bin's number is its first item's."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            item, length = (np.concatenate(x) for x in zip(*held, strict=True))
            bins = best_fit(length, size)
            used = np.bincount(bins, length).astype(np.int64)
            name = np.zeros(len(used), np.int64)
            name[bins[::-1]] = item[::-1]
            done = (used >= size - SLACK) | (size - used < least) if not last else np.ones(len(used), bool)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, length, name[bins], used[bins], done[bins])], ["item", "length", "bin", "used", "done"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in held) >= PER_TASK:
                    yield flush()
        if held:
            yield flush()

    dealt = items.select("item", "length")
    dealt = dealt.repartition(parts, F.xxhash64("item")) if parts > 1 else dealt.repartition(1)
    return dealt.mapInArrow(pack, "item long, length long, bin long, used long, done boolean")


def pack_lengths(items: DataFrame, size: int = 1024) -> DataFrame:
    """(item, sequence_id, offset) for items (item, length up to size), in as few sequences as the rounds find.

    Rounds merge in a tree: each has an eighth of the partitions before it, and
    at least as many as hold PER_TASK items each; the last one, of one partition
    or of as many as the round before, closes all bins.
    """
    n, least = items.agg(F.count("*"), F.min("length")).first()
    place, level = None, items.select("item", "length")
    parts = max(1, -(-n // PER_TASK))
    tree: list[DataFrame] = []
    while n:
        last = parts == 1
        tree.append(written(_round(level, parts, size, least, last), "pack"))
        if last:
            break
        level = tree[-1].where("not done").groupBy("bin").agg(F.first("used").alias("length")).withColumnRenamed("bin", "item")
        n, least = level.agg(F.count("*"), F.min("length")).first()
        fewer = max(-(-parts // FAN_IN), -(-n // PER_TASK), 1)
        if n and fewer >= parts:  # merging no longer shrinks what is left: these partitions close their bins
            tree.append(written(_round(level, fewer, size, least, True), "pack"))
            break
        parts = fewer
    if not tree:
        return items.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # From the last round back: an item's sequence is its bin's, and its place is its bin's place plus what lies before it.
    for packed in reversed(tree):
        before = F.sum("length").over(_within("bin")) - F.col("length")
        own = packed.select("item", "bin", before.alias("own"))
        if place is None:
            place = own.select("item", F.col("bin").alias("sequence_id"), F.col("own").alias("offset"))
        else:
            up = place.select(F.col("item").alias("bin"), F.col("sequence_id").alias("up_id"), F.col("offset").alias("up_off"))
            place = own.join(up, "bin", "left").select("item", F.coalesce("up_id", "bin").alias("sequence_id"), (F.coalesce("up_off", F.lit(0)) + F.col("own")).alias("offset"))
    return place


def _within(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def best_fit_packing(docs: DataFrame, size: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece of every document."""
    all_pieces = written(pieces(docs, size, end_id, vocabulary, with_ids), "pieces")
    full = all_pieces.where(F.col("length") == size).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = all_pieces.where(F.col("length") < size)
    placed = rest.join(pack_lengths(rest.select("item", "length"), size), "item")
    # Items and bins share one number space, so a full piece's own number is no other sequence's.
    return full.unionByName(placed).drop("item")
