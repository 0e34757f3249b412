"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Severity has ordered grades: the distinct values of the label column, in order
(two or more; with labels that only say toxic or not there are two, and nothing
is made up above them). One weight per feature is shared by all thresholds:
P(grade > k) = sigmoid(w x - theta_k), theta ascending; the expected severity is
the sum of these over k. Features are words (runs of letters and digits, case
folded, by hash) and their beginnings of PREFIXES bytes, which gather inflected
and compound forms; a feature's value is ln(1 + 200 * its share of the
text's terms). Those that best tell documents above a threshold from those below
(likelihood ratio over documents, either way) are kept, MAX_FEATURES at most.

The fit uses TRAIN_DOCS labelled documents at most (equal texts once); every
whole document is scored where it is read.

Edge cases: null and empty texts have no features and get the intercept's
severity; with labels of one value only every document has that grade (0
without any labels); repeated rows are scored alike; a null id counts as the
text '' for the split; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, labelled_sample, mapped, prefix_hash, span_hash, word_places

#: Labelled documents that the fit uses at most; features; documents that a feature needs; gradient steps; penalty.
TRAIN_DOCS, MAX_FEATURES, MIN_DOCS, STEPS, L2 = 6000, 512, 5, 600, 2e-4
PREFIXES = (4, 5, 6, 7, 8, 10)
#: Log-likelihood ratio that a feature needs.
MIN_RATIO = 12.0


def _separators() -> np.ndarray:
    sep = np.ones(256, bool)
    sep[128:] = False
    for a, b in ((48, 58), (65, 91), (97, 123)):
        sep[a:b] = False
    return sep


@dataclass
class Scale:
    features: np.ndarray  # hashes, ascending
    weights: np.ndarray
    theta: np.ndarray  # ascending
    grades: np.ndarray  # label values, one more than thresholds

    def above(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.theta[None], -30, 30)))


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and every beginning of one."""
    start, end = word_places(data, offs, _separators()) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    s = prefix_hash(data, True)
    doc = np.searchsorted(offs, start, "right") - 1
    docs, out = [doc], [span_hash(s, start, end)]
    for n in PREFIXES:
        on = end - start > n
        docs.append(doc[on])
        out.append(span_hash(s, start[on], start[on] + n))
    return np.concatenate(docs), np.concatenate(out).view(np.int64)


def counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the distinct terms of each text."""
    doc, h = terms(data, offs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return doc[cut], h[cut], np.diff(np.append(cut, len(h)))


def value(times: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A feature's value from its count and the number of terms in the text."""
    return np.log1p(200 * times / total)


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio of a word being in a of na documents of one class, b of nb of the other."""

    def part(k, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    p = (a + b) / (na + nb)
    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))


def slope(doc: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, w: np.ndarray, raw: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of grades 0..K, and its gradient by weights and by raw = (first threshold, logs of the steps to the next ones)."""
    n, k = len(grade), len(raw)
    steps = np.append(raw[:1], np.exp(raw[1:]))
    x = np.bincount(doc, val * w[col], n)
    up = np.ones((n, k + 2))  # P(grade >= i)
    up[:, 1:-1] = 1 / (1 + np.exp(-np.clip(x[:, None] - np.cumsum(steps)[None], -30, 30)))
    up[:, -1] = 0
    rows = np.arange(n)
    p = np.maximum(up[rows, grade] - up[rows, grade + 1], 1e-9)
    rise = up * (1 - up)
    lo, hi = rise[rows, grade] / p / n, rise[rows, grade + 1] / p / n
    theta = np.bincount(grade, lo, k + 2)[1 : k + 1] - np.bincount(grade + 1, hi, k + 2)[1 : k + 1]
    tail = np.cumsum(theta[::-1])[::-1]
    return float(-np.log(p).mean()), np.bincount(col, val * (hi - lo)[doc], len(w)), tail * np.append(1.0, steps[1:])


def fit(doc: np.ndarray, word: np.ndarray, times: np.ndarray, y: np.ndarray) -> Scale:
    n, grades = len(y), np.unique(y)
    if len(grades) < 2:
        return Scale(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), grades if n else np.zeros(1, int))
    grade, k = np.searchsorted(grades, y), len(grades) - 1
    names, col = np.unique(word, return_inverse=True)
    worth = np.zeros(len(names))
    for cut in range(1, k + 1):
        high = grade >= cut
        na = int(high.sum())
        a, b = np.bincount(col, high[doc], len(names)), np.bincount(col, ~high[doc], len(names))
        apart = (a / na > 2 * b / (n - na)) | (b / (n - na) > 2 * a / na)
        worth = np.maximum(worth, np.where((a + b >= MIN_DOCS) & apart, _ratio(a, b, na, n - na), 0))
    top = np.sort(np.argsort(-worth, kind="stable")[:MAX_FEATURES])
    top = top[worth[top] >= MIN_RATIO]
    place = np.full(len(names), -1)
    place[top] = np.arange(len(top))
    on = place[col] >= 0
    doc_, col_ = doc[on], place[col][on]
    val = value(times[on], np.maximum(np.bincount(doc, times, n), 1)[doc_])
    w, raw = np.zeros(len(top)), np.zeros(k)
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for step in range(1, STEPS + 1):
        _, gw, gr = slope(doc_, col_, val, grade, w, raw)
        g = np.concatenate([gw + L2 * w, gr])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        raw -= move[len(w) :]
    return Scale(names[top], w, np.cumsum(np.append(raw[:1], np.exp(raw[1:]))), grades)


def train(docs: DataFrame, labels: DataFrame, column: str, keep: Column, rows: int = TRAIN_DOCS) -> Scale:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b):
                d, h, k = counts(data, offs)
                at = np.searchsorted(d, np.arange(hi - lo + 1))
                lists = [pa.array([z[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for z in (h, k.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *lists], ["id", "y", "h", "k"])

    t = mapped(labelled_sample(docs, labels, column, rows, keep), features, "id long, y int, h binary, k binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    h = [np.frombuffer(b, np.int64) for b in t.column("h").to_pylist()]
    k = [np.frombuffer(b, np.int32) for b in t.column("k").to_pylist()]
    doc = np.repeat(np.arange(len(h)), [len(z) for z in h])
    return fit(doc, np.concatenate([np.zeros(0, np.int64), *h]), np.concatenate([np.zeros(0, np.int32), *k]), t.column("y").to_numpy().astype(int))


def severity(docs: DataFrame, labels: DataFrame, held_out: Column, column: str = "toxic", rows: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score (probability of a grade above the lowest), expected_severity (0 to the number of thresholds), grade (the likeliest label value) and predicted (1 if score >= 0.5)."""
    scale = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column, F.coalesce(~held_out, F.lit(True)), rows))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), held_out.alias("held_out"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scale.value
        for b in batches:
            for lo, hi, data, offs in chunks(b):
                text, h = terms(data, offs)
                total = np.maximum(np.bincount(text, minlength=hi - lo), 1)
                i = np.minimum(np.searchsorted(s.features, h), max(len(s.features) - 1, 0))
                on = np.flatnonzero(s.features[i] == h) if len(s.features) else np.zeros(0, np.int64)
                key, k = np.unique(text[on] * max(len(s.features), 1) + i[on], return_counts=True)
                x = np.bincount(key // max(len(s.features), 1), s.weights[key % len(s.features)] * value(k, total[key // len(s.features)]), hi - lo) if len(key) else np.zeros(hi - lo)
                up = np.concatenate([np.ones((hi - lo, 1)), s.above(x), np.zeros((hi - lo, 1))], 1)
                grade = s.grades[(up[:, :-1] - up[:, 1:]).argmax(1)].astype(np.int32)
                # With grades of one value only, whether it is above 0 is all there is to say.
                any_ = up[:, 1] if len(s.theta) else np.full(hi - lo, float(s.grades[0] > 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(any_), pa.array(up[:, 1:-1].sum(1)), pa.array(grade)], ["id", "held_out", "score", "expected_severity", "grade"])

    out = mapped(own, score, "id long, held_out boolean, score double, expected_severity double, grade int")
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "expected_severity", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted"))
