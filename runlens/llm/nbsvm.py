"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are hashed byte n-grams (1 to 3 bytes) and word-shape n-grams (1 to 3
words): capitals, the marks a word ends with, and whether it repeats the word
before.  Class counts of every labelled training row give each indicator a
log-count ratio; the indicators, scaled by it and to unit length, train a linear
squared-hinge model by dual coordinate descent (Fan et al. 2008, Wang and
Manning 2012).  A logistic curve through the margins of rows that the fit left
out turns margins into scores.

The counts cover all training rows.  The descent itself runs in one task over a
sample bounded by ``fit_rows`` rows and ``fit_entries`` indicators.  The model
is bounded by ``2 ** BITS`` weights, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS = 17
_SIZE = 1 << BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _ODD
    h ^= h >> np.uint64(32)
    return ((h * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def _shapes(b: np.ndarray) -> np.ndarray:
    """A shape code of each word of a text."""
    blank = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
    at = np.flatnonzero(blank[:-1] & ~blank[1:])
    end = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(at):
        return np.zeros(0, np.uint64)
    upper = np.concatenate(([0], np.cumsum((b >= 65) & (b <= 90))))
    lower = np.concatenate(([0], np.cumsum((b >= 97) & (b <= 122))))
    digit = np.concatenate(([0], np.cumsum((b >= 48) & (b <= 57))))
    u, low, d = (c[end] - c[at] for c in (upper, lower, digit))
    case = np.where(u == 0, 0, np.where(low > 0, 1, np.where(u > 1, 3, 2)))
    marks = np.zeros(len(at), dtype=np.uint64)
    for k in (1, 2, 3):
        c = b[np.maximum(end - k, at)].astype(np.uint64)
        plain = (c >= 128) | ((c >= 48) & (c <= 57)) | ((c | np.uint64(32)) - np.uint64(97) < 26)
        marks = marks * np.uint64(256) + np.where(plain, np.uint64(0), c)
    size = end - at
    same = np.zeros(len(at), dtype=bool)
    maybe = np.flatnonzero((size[1:] == size[:-1]) & (b[at[1:]] == b[at[:-1]])) + 1
    raw = b.tobytes()
    for k in maybe.tolist():
        same[k] = raw[at[k]:end[k]] == raw[at[k - 1]:end[k - 1]]
    return marks * np.uint64(64) + (case * 4 + (d > 0) * 2 + same).astype(np.uint64)


class Indicators:
    """Distinct indicators of a text; keeps its scratch between texts."""

    def __init__(self):
        self.mark = np.zeros(_SIZE, dtype=bool)

    def of(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode(), dtype=np.uint8)
        mark = self.mark
        w = b.astype(np.uint64)
        s = _shapes(b)
        for salt, units in ((1, w), (11, s)):
            grams = units
            for n in range(1, 4):
                if len(grams):
                    mark[_hash(grams, salt + n)] = True
                if len(grams) > 1:
                    grams = grams[:-1] * np.uint64(0x100000001B3) + units[n:]
                else:
                    break
        out = np.flatnonzero(mark)
        mark[out] = False
        return out


def log_ratios(pos: np.ndarray, neg: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = pos + alpha, neg + alpha
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12,
                 seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge model of unit rows, costs balanced by class."""
    n = len(rows)
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(n)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * cost * share)
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + w[-1]) - 1 + diag[i] * alpha[i]
            if alpha[i] > 0 or g < 0:
                worst = max(worst, abs(g))
                new = max(alpha[i] - g / (2 + diag[i]), 0.0)   # unit rows and a bias of 1
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, smoothed targets, by Newton steps."""
    hi, lo = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-6 * a, (p - t).sum()])
        d = p * (1 - p)
        h = np.array([[(d * margin * margin).sum() + 1e-6, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


@dataclass
class Model:
    weight: np.ndarray   # of each indicator, scaled by its ratio
    square: np.ndarray   # of its ratio
    bias: float
    slope: float
    offset: float

    def score(self, text: Column) -> Column:
        """Score of a whole text, 0 to 1; a null text counts as empty."""
        model = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = Indicators()
            for texts in batches:
                yield pd.Series([model.one(find.of(t)) for t in texts], dtype=float)
        return run(F.coalesce(text, F.lit("")))

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum(dtype=np.float64)))
        return float(self.weight[found].sum(dtype=np.float64)) / max(norm, 1e-12) + self.bias

    def one(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_rows: int = 20_000, fit_entries: int = 40_000_000) -> Model:
    """Train on the rows of ``docs`` that have a label 0 or 1 in ``labels``.

    Of several labels of an id the larger counts; null ids and labels are left
    out.  Without rows of both classes the model gives every text the same
    score: 1, or 0 if all labels are 0.
    """
    scratch = Scratch(docs.sparkSession, "nbsvm")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = scratch.keep(known, "labels")
    tally = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(tally) < 2:
        zero = np.zeros(_SIZE, dtype=np.float32)
        return Model(zero, zero, -30.0 if set(tally) == {0} else 30.0, 1.0, 0.0)
    share = min(1.0, fit_rows / sum(tally.values()))
    train = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(known, "id").select("text", "y", F.xxhash64("id").alias("order")).withColumn(
        "picked", F.pmod("order", F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen = Indicators(), np.zeros((2, _SIZE), dtype=np.int64)
        for pdf in batches:
            keep = []
            for text, y, order, picked in pdf[["text", "y", "order", "picked"]].itertuples(index=False):
                got = find.of(text)
                seen[y, got] += 1
                if picked:
                    keep.append((order, y, got.astype("<i4").tobytes()))
            if keep:
                yield pd.DataFrame({"picked": True, "a": [k[0] for k in keep], "b": [k[1] for k in keep], "c": 0,
                                    "found": [k[2] for k in keep]})
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"picked": False, "a": at, "b": seen[0, at], "c": seen[1, at], "found": None})

    got = scratch.keep(train.mapInPandas(count, "picked boolean, a long, b long, c long, found binary"), "counts")
    ratio = got.where("not picked").groupBy("a").agg(F.sum("b").alias("neg"), F.sum("c").alias("pos"))
    counts = np.zeros((2, _SIZE))
    for r in ratio.collect():     # at most 2 ** BITS rows
        counts[:, r["a"]] = r["neg"], r["pos"]
    scale = log_ratios(counts[1], counts[0])

    def train_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, y, part, total = [], [], [], 0
        for pdf in batches:
            for order, label, found in pdf[["a", "b", "found"]].itertuples(index=False):
                r = np.frombuffer(found, "<i4")
                total += len(r)
                if total > fit_entries:
                    break
                rows.append(r)
                y.append(1.0 if label else -1.0)
                part.append(order % 5 == 0)
        yy, aside = np.array(y), np.array(part)
        out = [0.0] * (_SIZE + 1), 1.0, 0.0
        if len(set(y)) == 2:
            main = [k for k in range(len(rows)) if not aside[k]]
            if len(set(yy[main])) == 2 and len(set(yy[aside])) == 2:
                w = dual_descent([rows[k] for k in main], yy[main], scale)
                m = Model((w[:-1] * scale), scale ** 2, float(w[-1]), 1.0, 0.0)
                curve = platt(np.array([m.margin(rows[k]) for k in np.flatnonzero(aside)]), yy[aside])
            else:
                curve = (4.0, 0.0)
            out = dual_descent(rows, yy, scale).tolist(), *curve
        yield pd.DataFrame({"w": [np.asarray(out[0]).tobytes()], "slope": [out[1]], "offset": [out[2]]})

    sample = got.where("picked").select("a", "b", "found").repartition(1).sortWithinPartitions("a")
    best = sample.mapInPandas(train_one, "w binary, slope double, offset double").first()
    w = np.frombuffer(best["w"], "<f8")
    return Model((w[:-1] * scale).astype(np.float32), (scale ** 2).astype(np.float32), float(w[-1]), best["slope"],
                 best["offset"])
