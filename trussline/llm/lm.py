"""Scores of texts under a probabilistic suffix tree over words.

Training counts every token (case-folded words, then one end) of the training
rows, and after contexts of up to DEPTH tokens the symbols that follow. As in
the classical learner a context has to occur often enough, CONTEXT times, whatever its
length, and so has a symbol after it, SYMBOL times (absolute
numbers, so the tree grows with the input; nothing is capped or sampled). A context is retained if
count * KL(next symbols given it || given its longest retained suffix) passes
DIVERGENCE * ln(tokens), symbols below SYMBOL being one symbol in that sum. A
retained state gives a symbol its count's share of total + KAPPA, and hands what
is left (KAPPA and the counts below SYMBOL) on to the next shorter state; the
root is the smoothed unigram distribution of the base score. A token is scored
by the longest retained suffix of the words before it.

Grams are the key to all of this. A gram of k tokens has a 64-bit hash made of
those of the two grams of k - 1 tokens in it. The gram of d + 1 tokens is a
context of d with its symbol, the gram without its last token is the context,
and that without its first is the same symbol after the next shorter context. A
gram's count as a context is its count as a gram. So a level is counted by one
shuffle of flat arrays, dealt by context (frequent contexts are salted), and is tested and weighted by joins with the level below.

A text's score is then a sum of one number per gram in it, its entry: what a
state makes of its symbol against the next shorter state, and what it leaves to
that state where it has nothing to say. The entries of the most frequent grams
are broadcast (HOT at most, whatever the input); all others are asked
for by one join on distinct (row, gram), which has no hot keys then. Bitmaps of
fixed size keep back what no table can hold: they only save work.

Edge cases: a null text is empty and scores its end alone; a null id counts as
the text '' for the split and stays null; without training rows every token has
the same probability under the base; repeated rows are counted and scored as
rows of their own; no rows give no rows; other columns are ignored. Words and
grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import brief_shuffles, chunks, discard, mapped, mix64, words, written

#: Longest context; occurrences that a context, and a symbol after it, need; divergence needed; weight of the shorter state.
DEPTH, CONTEXT, SYMBOL, DIVERGENCE, KAPPA = 4, 32, 8, 1.0, 8.0
#: Entries that are broadcast at most, and occurrences they need (a rarer one saves too little); bits of a bitmap (16 MB); parts of a context with at least that share of all tokens; tokens to a slice of the counts.
HOT, HOT_COUNT, BITS, SALTS, SALTED_SHARE, PER_SLICE = 1 << 21, 32, 27, 32, 2.0**-10, 1 << 20
#: Tokens whose grams a task gathers before it passes counts on.
GATHER = 1 << 21
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
END = np.int64(0x5EED0E0D)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts, each text's with an end before and after it, and the first one of each text (one more at the end)."""
    h, at = words(data, offs)
    n = len(offs) - 1
    first = at + 2 * np.arange(n + 1)
    out = np.empty(len(h) + 2 * n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[first[:-1]] = True
    is_end[first[1:] - 1] = True
    out[is_end] = END.view(np.uint64)
    out[~is_end] = h
    return out, first


def longer(context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The hash of a gram from those of the grams without its last and without its first token."""
    return mix64(context * _A + lower * _B)


def grams(g: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From g, the grams of k - 1 tokens by last token: those of k tokens (first of a text on), and where there is one; place: a token's number in its text."""
    out = np.empty_like(g)
    out[1:] = longer(g[:-1], g[1:])
    out[:1] = 0
    return out, place >= k - 1


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a bitmap."""
    return keys >> np.uint64(64 - BITS), keys & np.uint64((1 << BITS) - 1)


@dataclass
class Bitmap:
    """Which keys may be in a set: those of which both bits are set."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = _places(keys)
        out = self._set(one)
        at = np.flatnonzero(out)
        out[at] = self._set(two[at])
        return out

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame, column: str) -> Broadcast:
    """A Bitmap of the column, broadcast: of BITS bits at any size of input."""
    place = F.explode(F.array(F.expr(f"shiftrightunsigned(`{column}`, {64 - BITS})"), F.expr(f"`{column}` & {(1 << BITS) - 1}L"))).alias("place")
    rows = keys.select(place).select(F.expr("shiftright(place, 6)").alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    at, bit = _columns(rows.groupBy("at").agg(F.bit_or("bit").alias("bit")))
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[at] = bit.view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(bits))


def _columns(df: DataFrame) -> list[np.ndarray]:
    t = df.toArrow()
    return [c.to_numpy() for c in t.columns]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and their places in their texts."""
    for b in batches:
        for _, _, data, offs in chunks(b):
            x, first = tokens(data, offs)
            yield x, np.arange(len(x)) - np.repeat(first[:-1], np.diff(first))


def _vocabulary(texts: DataFrame) -> DataFrame:
    """(k, n): the counts of all tokens, written."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return k[at], np.add.reduceat(n, at) if len(k) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x, place in _texts(batches):
            held.append(np.unique(x[place > 0], return_counts=True))
            size += len(held[-1][0])
            if size > GATHER:
                held = [merged(held)]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["k", "n"])
                    held, size = [], 0
        if held:
            k, n = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

    return written(mapped(texts, count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "words")


def _sorted_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, the first one first, and where each run of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(change)


def _counted(texts: DataFrame, emit, slices: int) -> DataFrame:
    """(d, c, g, k, n) of all grams that occur SYMBOL times, written: level, context, lower gram, gram, count.

    emit: (level, context, lower gram, salt) of the grams to count, from tokens
    and places. Contexts (parts of them, if salted) are dealt to slices; what a
    task has gathered for a slice is one row of flat arrays.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            d, c, g, s = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            of = (mix64(c + s.astype(np.uint64) * _B) % np.uint64(slices)).astype(np.int32)
            order, at = _sorted_runs(of, c, g)
            n = np.diff(np.append(at, len(order))).astype(np.int32)
            d, c, g, of = (x[order][at] for x in (d, c, g, of))
            rows = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            ends = pa.array(np.append(rows, len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (d, c.view(np.int64), g.view(np.int64), n)]
            return pa.RecordBatch.from_arrays([pa.array(of[rows]), *lists], ["slice", "d", "c", "g", "n"])

        size = 0
        for x, place in _texts(batches):
            for part in emit(x, place):
                held.append(part)
                size += len(part[0])
            if size >= GATHER:
                yield flush()
                size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        current = None

        def solve() -> pa.RecordBatch:
            d, c, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, at = _sorted_runs(c, g)
            n = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else n.astype(np.int64)
            often = n >= SYMBOL
            rows = order[at][often]
            key = longer(c[rows].view(np.uint64), g[rows].view(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[rows], c[rows], g[rows], key, n[often])], ["d", "c", "g", "k", "n"])

        for b in batches:
            for i, of in enumerate(b.column(0).to_pylist()):
                if held and of != current:
                    yield solve()
                current = of
                held.append([b.column(k)[i].values.to_numpy() for k in range(1, 5)])
        if held:
            yield solve()

    rows = mapped(texts, collect, "slice int, d array<byte>, c array<long>, g array<long>, n array<int>")
    return written(mapped(rows.repartition("slice").sortWithinPartitions("slice"), merge, "d byte, c long, g long, k long, n long"), "grams")


def _pairs(texts: DataFrame, vocabulary: DataFrame, tokens_: int) -> DataFrame:
    """Grams of two tokens: a context of one and its symbol."""
    spark = texts.sparkSession
    contexts, symbols = bitmap(vocabulary.where(F.col("n") >= CONTEXT), "k"), bitmap(vocabulary.where(F.col("n") >= SYMBOL), "k")
    salted = spark.sparkContext.broadcast(np.sort(_columns(vocabulary.where(F.col("n") >= max(CONTEXT, tokens_ * SALTED_SHARE)).select("k"))[0].view(np.uint64)))

    def emit(x: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        may, is_symbol = contexts.value.has(x), symbols.value.has(x)
        on = np.flatnonzero((place[1:] > 0) & may[:-1] & is_symbol[1:]) + 1
        c, g = x[on - 1], x[on]
        hot = salted.value
        i = np.minimum(np.searchsorted(hot, c), max(len(hot) - 1, 0))
        s = np.where(hot[i] == c, (g >> np.uint64(17)) % np.uint64(SALTS), np.uint64(0)) if len(hot) else np.zeros(len(c))
        yield np.ones(len(c), np.int8), c, g, s.astype(np.int8)

    return _counted(texts, emit, -(-tokens_ // PER_SLICE) or 1)


def _contexts(texts: DataFrame, pairs: DataFrame, depth: int, tokens_: int) -> DataFrame:
    """Grams of three to depth + 1 tokens.

    A context that occurs CONTEXT times consists of pairs that do, and its symbol
    occurs SYMBOL times after the context's last word.
    """
    contexts, symbols = bitmap(pairs.where(F.col("n") >= CONTEXT), "k"), bitmap(pairs, "k")

    def emit(x: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        g, there = grams(x, place, 2)
        symbol = there & symbols.value.has(g)
        linked = there & contexts.value.has(g)
        live = linked.copy()
        for d in range(2, depth + 1):
            # g: grams of d tokens; live: those that may be contexts of d.
            on = np.flatnonzero(live[:-1] & symbol[1:] & (place[1:] >= d)) + 1
            if not len(on):
                return
            yield np.full(len(on), d, np.int8), g[on - 1], g[on], np.zeros(len(on), np.int8)
            # A symbol after a longer context has been one after this context.
            keep = np.zeros(len(x), bool)
            keep[on] = True
            symbol = keep
            g, there = grams(g, place, d + 1)
            live[1:] = live[:-1] & linked[1:] & there[1:]
            live[0] = False

    return _counted(texts, emit, -(-tokens_ // PER_SLICE) or 1)


def grown(texts: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """(entries, training tokens, distinct tokens). entries, written: key, n, base (of words only), value (what a gram adds to a score)."""
    vocabulary = _vocabulary(texts)
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = _pairs(texts, vocabulary, total)
    levels = pairs.unionByName(_contexts(texts, pairs, depth, total)) if depth > 1 else pairs
    p0 = (F.col("n") + 0.1) / (total + 0.1 * (distinct + 1))
    # Of the level below: keys, counts, and probabilities under the longest retained state.
    below = vocabulary.select("k", "n", p0.alias("p"))
    roots = vocabulary.select("k", "n", F.log10(p0).alias("base"))
    bonus, rests = [], []
    for d in range(1, depth + 1):
        low = below.where(F.col("n") >= SYMBOL).select(F.col("k").alias("g"), F.col("p").alias("q"))
        of = below.where(F.col("n") >= CONTEXT).select(F.col("k").alias("c"), F.col("n").alias("total"))
        rows = written(levels.where(F.col("d") == d).join(low, "g").join(of, "c"), "level")
        sums = rows.groupBy("c", "total").agg(F.sum("n").alias("kept"), F.sum("q").alias("mass"), F.sum(F.col("n") * F.ln(F.col("n") / F.col("total") / F.col("q"))).alias("gain"))
        other = F.col("total") - F.col("kept")
        gain = F.col("gain") + F.when(other > 0, other * F.ln(other / F.col("total") / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
        rest = (KAPPA + other) / (F.col("total") + KAPPA)
        states = written(sums.where(gain > DIVERGENCE * float(np.log(max(total, 2)))).select(F.col("c").alias("state"), rest.alias("rest")), "states")
        p = F.col("n") / (F.col("total") + KAPPA) + F.col("rest") * F.col("q")
        below = written(rows.join(states, F.col("c") == F.col("state"), "left").select("k", "n", F.coalesce(p, "q").alias("p"), F.coalesce(F.log10(p / F.col("q") / F.col("rest")), F.lit(0.0)).alias("bonus")), "level")
        discard(rows)
        bonus.append(below.select("k", "n", F.lit(None).cast("double").alias("base"), "bonus"))
        rests.append(states.select("state", F.log10("rest").alias("rest")))
    every = reduce(DataFrame.unionByName, [roots.withColumn("bonus", F.col("base")), *bonus]).join(reduce(DataFrame.unionByName, rests), F.col("k") == F.col("state"), "left")
    value = F.col("bonus") + F.coalesce("rest", F.lit(0.0))
    entries = written(every.select(F.col("k").alias("key"), "n", "base", value.alias("value")).where("base is not null or value <> 0"), "entries")
    discard(vocabulary)
    return entries, total, distinct


def _hot_from(entries: DataFrame) -> int:
    """The least count from which on there are HOT entries at most; counts are looked at in eighths of powers of two."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r[0], r[1]) for r in entries.groupBy(step).count().collect()), reverse=True)
    most, least = 0, float("inf")
    for at, n in sizes:
        most += n
        if most > HOT:
            break
        least = at
    return int(np.ceil(2 ** (least / 8) - 1e-9)) if least < float("inf") else 1 << 62


@dataclass
class Hot:
    key: np.ndarray
    base: np.ndarray
    value: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, or -1."""
        if not len(self.key):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)


def lm_scores(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH) -> DataFrame:
    """id column, held_out, n_tokens, n_known, train_tokens, base_score, score; rows for which held_out holds are not learned from."""
    with brief_shuffles(docs.sparkSession):  # those of a step go when its table is written
        return _scores(docs, held_out, id_column, text_column, depth)


def _scores(docs: DataFrame, held_out, id_column: str, text_column: str, depth: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    entries, total, distinct = grown(base.where("not held_out").select("text"), depth)
    least = max(_hot_from(entries), HOT_COUNT)
    key, own, value = _columns(entries.where(F.col("n") >= least).select("key", "base", "value"))
    order = np.argsort(key.view(np.uint64))
    shared = spark.sparkContext.broadcast(Hot(key.view(np.uint64)[order], own[order], value[order]))
    # Pairs and longer grams that have an entry; those without one are not asked for.
    longer_ = bitmap(entries.where("base is null"), "key")
    unknown = float(np.log10(0.1 / (total + 0.1 * (distinct + 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, may = shared.value, longer_.value
        for b in batches:
            for lo, hi, data, offs in chunks(b):
                x, first = tokens(data, offs)
                n = hi - lo
                doc = np.repeat(np.arange(n), np.diff(first))
                place = np.arange(len(x)) - first[doc]
                word = np.flatnonzero(place > 0)
                at = hot.find(x[word])
                on = at >= 0
                known = np.bincount(doc[word], on, n).astype(np.int64)
                base_sum = np.bincount(doc[word[on]], hot.base[at[on]], n).astype(float)
                score_sum = np.bincount(doc[word[on]], hot.value[at[on]], n).astype(float)
                asked = [(doc[word[~on]], x[word[~on]])]
                g = x
                for k in range(2, depth + 2):
                    g, there = grams(g, place, k)
                    i = np.flatnonzero(there)
                    i = i[may.has(g[i])]
                    at = hot.find(g[i])
                    on = at >= 0
                    score_sum += np.bincount(doc[i[on]], hot.value[at[on]], n)
                    asked.append((doc[i[~on]], g[i[~on]]))
                of, keys = (np.concatenate(z) for z in zip(*asked, strict=True))
                order, start = _sorted_runs(of, keys)
                times = np.diff(np.append(start, len(order)))
                of, keys = of[order][start], keys[order][start]
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "k"]))
                cols = [*(b.column(i).slice(lo, n) for i in range(3)), pa.array(np.diff(first) - 1), pa.array(known), pa.array(base_sum), pa.array(score_sum), lists]
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "held_out", "n_tokens", "known", "base", "score", "asked"])

    scored = written(mapped(base, score, "row long, id long, held_out boolean, n_tokens long, known long, base double, score double, asked array<struct<key: long, k: long>>"), "scored")
    cold = entries.where(F.col("n") < least).select(F.col("key").alias("entry"), F.col("base").alias("own"), "value")
    # Unknown words are told from grams without an entry by what the text's own counts leave over.
    asked = scored.select("row", F.explode("asked").alias("a")).select("row", "a.key", "a.k").join(cold, F.col("key") == F.col("entry"))
    word = F.when(F.col("own").isNotNull(), F.col("k")).otherwise(0)
    sums = asked.groupBy(F.col("row").alias("sum_row")).agg(F.sum(word).alias("more_known"), F.sum(F.col("k") * F.coalesce("own", F.lit(0.0))).alias("more_base"), F.sum(F.col("k") * F.col("value")).alias("more_score"))
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    rest = (F.col("n_tokens") - known) * F.lit(unknown)
    return scored.join(sums, F.col("row") == F.col("sum_row"), "left").select(
        F.col("id").alias(id_column), "held_out", "n_tokens", known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + rest).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0)) + rest).alias("score"),
    )
