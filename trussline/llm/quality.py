"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of its bytes
(capitals, symbols, bars, digits, exclamation, punctuation), of its words that
repeat the word before, whether the line occurred in the document before, and
its length; the features of the lines before and after it are inputs as well.
The field has one weight per feature and a 2 x 2 table of transitions. Only
documents have labels, so the lines' labels are hidden when it is fitted: a
document's label favours every line of the same label by TIE / sqrt(lines), and
the likelihood of the documents' labels, with the lines' summed out, is climbed
by gradient steps with an L2 penalty. Its gradient is the difference of two
forward-backward passes, one for each label the document might have. So a good
document may hold bad lines, and how good and bad lines follow each other is
learned. A document's quality is the mean marginal of good under the field,
weighted by line length, put on the scale of the labels by a logistic curve.

The fit uses TRAIN_DOCS labelled documents and TRAIN_LINES of their lines at
most (whole documents, in order of a hash of their ids); features and marginals
of all documents are computed where they are read.

Edge cases: a null or empty text has no lines and gets the training rows' share
of good ones; without labels of both kinds every score is that share (0.5 with
none at all); repeated rows are scored alike; a null id counts as the text ''
for the split; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, labelled_sample, mapped, prefix_hash, release, span_hash, white_space, word_places

#: Labelled documents and lines that the fit uses at most; gradient steps; penalty; how much a document's label favours its lines'.
TRAIN_DOCS, TRAIN_LINES, STEPS, L2, TIE = 6000, 400_000, 150, 1e-3, 4.0
#: Byte classes whose shares are features (fixed values).
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"*#$%&@^~=+<>{}[]\\/_", b"|", b"0123456789", b"!?", b".,;:")
SHARES = len(CLASSES) + 1
OWN = SHARES + 4


def _classes() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256), np.float32)
    for i, c in enumerate(CLASSES):
        table[i, list(c)] = 1
    return table


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line that is not empty, its bytes, first line of each text and one more at the end)."""
    newline = np.zeros(256, bool)
    newline[[10, 13]] = True
    start, end = word_places(data, offs, newline) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(start, offs)
    n, size = len(start), (end - start).astype(np.float32)
    x = np.zeros((n, OWN), np.float32)
    if n:
        cuts = np.stack([start, end], 1).ravel()
        table = _classes()
        bytes_ = np.append(data, np.uint8(0))
        for i in range(len(CLASSES)):
            x[:, i] = np.sqrt(np.add.reduceat(table[i][bytes_], cuts)[::2] / size)
        s = prefix_hash(data, True)
        w0, w1 = word_places(data, offs, white_space())
        h = span_hash(s, w0, w1)
        again = np.zeros(len(h) + 1, np.float32)
        again[1:-1] = h[1:] == h[:-1]
        at = np.searchsorted(w0, np.stack([start, end], 1).ravel())
        words = np.diff(at)[::2].astype(np.float32)
        x[:, SHARES - 1] = np.sqrt(np.add.reduceat(again, np.minimum(at, len(h)))[::2] * (words > 0) / np.maximum(words, 1))
        lines = span_hash(s, start, end)
        doc = np.searchsorted(first, np.arange(n), "right") - 1
        order = np.lexsort((np.arange(n), lines, doc))
        seen = np.zeros(n, bool)
        seen[order[1:]] = (lines[order][1:] == lines[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        x[:, SHARES] = seen
        x[:, SHARES + 1] = np.log1p(size) / 8
        x[:, SHARES + 2] = np.minimum(size / np.maximum(words, 1) / 10, 3)
        x[:, SHARES + 3] = bytes_[end - 1] == 46
    return with_neighbours(x, first), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zero beyond its ends), and a constant."""
    n = len(x)
    out = np.zeros((n, 3 * OWN + 3), np.float32)
    out[:, :OWN], out[:, -1] = x, 1
    if n:
        is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
        has = first[1:] > first[:-1]
        is_first[first[:-1][has]] = True
        is_last[first[1:][has] - 1] = True
        out[1:, OWN : 2 * OWN] = x[:-1]
        out[:-1, 2 * OWN : 3 * OWN] = x[1:]
        out[is_first, OWN : 2 * OWN] = 0
        out[is_last, 2 * OWN : 3 * OWN] = 0
        out[:, -3], out[:, -2] = is_first, is_last
    return out


def _lse(a: np.ndarray) -> np.ndarray:
    m = a.max(-1)
    return m + np.log(np.exp(a - m[..., None]).sum(-1))


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(P(good) of every line, summed P(label, next label) of each text, log partition), by forward and backward passes over all texts at once."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, longest + 1), "right") if longest else np.zeros(0, int)  # texts with more than t lines
    e = np.stack([np.zeros(len(emit)), emit], 1)
    a = np.zeros((len(emit), 2))
    z = np.zeros(len(n))
    for t in range(longest):
        i = at[: live[t]] + t
        a[i] = e[i] if t == 0 else e[i] + _lse(a[i - 1][:, None, :] + trans.T[None])
    some = n > 0
    z[some] = _lse(a[at[some] + n[some] - 1])
    b = np.zeros((len(emit), 2))
    for t in range(longest - 2, -1, -1):
        i = at[: live[t + 1]] + t
        b[i] = _lse(trans[None] + (e[i + 1] + b[i + 1])[:, None, :])
    which = np.empty(len(n), np.int64)
    which[order] = np.arange(len(n))
    per_line = np.repeat(z[which], np.diff(first))
    good = np.exp(a[:, 1] + b[:, 1] - per_line)
    joint = None
    if pairs:
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        i = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, int)
        p = np.exp(a[i][:, :, None] + trans[None] + (e[i + 1] + b[i + 1])[:, None, :] - per_line[i][:, None, None])
        joint = np.stack([np.bincount(doc[i], p[:, j, k], len(n)) for j in (0, 1) for k in (0, 1)], 1).reshape(-1, 2, 2)
    return good, joint, z[which]


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    scale: tuple[float, float]  # of the logistic curve over a document's mean marginal's logit
    prior: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, size, first = line_features(data, offs)
        n = len(offs) - 1
        if not len(self.weights):
            return np.full(n, self.prior)
        good, _, _ = marginals(x @ self.weights, self.trans, first)
        mean = _weighted(good, size, first)
        out = 1 / (1 + np.exp(-(self.scale[0] * _logit(mean) + self.scale[1])))
        return np.where(np.diff(first) > 0, out, self.prior)


def _weighted(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(first) - 1
    return np.bincount(doc, good * size, n) / np.maximum(np.bincount(doc, size, n), 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def slope(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the documents' labels, and its gradient by weights and transitions; the lines' labels are summed out."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(y)), n)
    tie = TIE / np.sqrt(np.maximum(n, 1))
    emit = x @ w
    bad, bad_pairs, z0 = marginals(emit - tie[doc], trans, first, pairs=True)
    good, good_pairs, z1 = marginals(emit + tie[doc], trans, first, pairs=True)
    odds = np.clip(z1 - z0 - n * tie, -500, 500)
    p = 1 / (1 + np.exp(-odds))
    off = (p - y) / len(y)
    loss = float(np.logaddexp(0, np.where(y == 1, -odds, odds)).mean())
    return loss, x.T @ (off[doc] * (good - bad)), (off[:, None, None] * (good_pairs - bad_pairs)).sum(0)


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray) -> Field:
    """The field of documents with these labels."""
    prior = float(y.mean()) if len(y) else 0.5
    n = np.diff(first)
    if len(set(y[n > 0].tolist())) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), (1.0, 0.0), prior)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        _, gw, gt = slope(x, first, y, w, trans)
        g = np.concatenate([gw + L2 * w, (gt + L2 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        trans -= move[len(w) :].reshape(2, 2)
    good, _, _ = marginals(x @ w, trans, first)
    q = _logit(_weighted(good, size, first))[n > 0]
    t = y[n > 0]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the two numbers of the curve
        p = 1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * q * q).sum() + 1, (s * q).sum()], [(s * q).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([((p - t) * q).sum() + (a - 1), (p - t).sum()]))
        a, b = a - d[0], b - d[1]
    return Field(w, trans, (float(a), float(b)), prior)


def train(docs: DataFrame, labels: DataFrame, column: str, keep: Column, rows: int = TRAIN_DOCS) -> Field:
    """The field fitted on a bounded sample of labelled documents; their line features, not their texts, reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b):
                x, size, first = line_features(data, offs)
                lists = [pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([size[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), *lists], ["id", "y", "lines", "x", "size"])

    t = mapped(labelled_sample(docs, labels, column, rows, keep), features, "id long, y int, lines long, x binary, size binary")
    # A bounded sample, so one task can sum up its lines.
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("id"), "id", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("upto", upto).where(F.col("upto") <= TRAIN_LINES).drop("lines", "upto").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    sizes = [np.frombuffer(b, np.float32) for b in t.column("size").to_pylist()]
    xs = [np.frombuffer(b, np.float32).reshape(-1, 3 * OWN + 3) for b in t.column("x").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    empty = np.zeros((0, 3 * OWN + 3), np.float32)
    return fit(np.concatenate([empty, *xs]), np.concatenate([np.zeros(0, np.float32), *sizes]), first, t.column("y").to_numpy().astype(int))


def document_quality(docs: DataFrame, labels: DataFrame, held_out: Column, column: str = "quality", keep_columns: tuple[str, ...] = (), rows: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (and keep_columns of it); held_out documents are not learned from."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column, F.coalesce(~held_out, F.lit(True)), rows))
    release()  # the driver goes on without the sample
    own = docs.select(F.col("doc_id").cast("long").alias("id"), held_out.alias("held_out"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep_columns)], "text")
    names = own.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b, limit=2 << 20):
                s = field.value.score(data, offs)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(names))), pa.array(s)], [*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    out = mapped(own, score, f"{kinds}, score double")
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep_columns)])

