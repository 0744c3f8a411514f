"""Personal data by rules and by a semi-Markov conditional random field.

The rules are fixed patterns with checks (part sizes, digit counts, Luhn).  The
segment model scores whole candidate spans: the shape of the span, its digits,
marks and checks, and the words beside it.  A dynamic programme over tokens,
with entities of at most ``MAX_TOKENS`` tokens, chooses boundaries and types of
all spans of a region together.  Its weights maximise the conditional likelihood
(forward-backward over segmentations) of the rules' spans in a bounded sample of
the corpus.  Spans that the model is sure of and the rules lack are added; the
rules' spans always stay.

Only places with a digit or an at sign can be in an entity, so the programme
runs over regions around those; outside them every token is a non-entity.  A
region of more than ``_LONG`` characters is worked through in blocks of tokens:
candidates and features live for one block, and only sums, best scores and best
candidates stay, about 60 bytes a token.  The result is that of one lattice.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from math import exp, inf, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
_REACH = 40            # characters that a region extends beyond a digit or at sign
_SURE = 0.95           # posterior that an added span needs
_PRIOR = 2.0           # taken from the score of every candidate
_LONG = 1 << 14        # characters of a region that one lattice takes
_STEP = 1 << 11        # tokens of a block of a longer one

# fixed patterns of the rules; look-behind and possessive repeats only spare work inside long runs
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_MARK = re.compile("[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' spans, in that order; per kind leftmost and not overlapping."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            # the local part is the run before the sign; it is looked up in doubling windows
            size, run = 64, None
            while True:
                lo = max(last, at - size)
                run = _LOCAL.search(text[lo:at])
                if not run or run.start() > 0 or lo == last:
                    break
                size *= 2
            if run:
                out.append((lo + run.start(), 0, m.end()))
                last = m.end()
        at = text.find("@", m.end() if m and last == m.end() else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _only_digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_only_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, whole words where these end within reach, neighbours joined."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        lo, hi = m.start(), m.end()
        while lo > max(0, m.start() - _REACH) and not text[lo - 1].isspace():
            lo -= 1
        while hi < min(len(text), m.end() + _REACH) and not text[hi].isspace():
            hi += 1
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_CLASS = re.compile("([A-Za-z]+)|([0-9]+)")


def _shape(s: str) -> str:
    return _CLASS.sub(lambda m: "a" if m.group(1) else "9", s)[:24]


def span_features(text: str, start: int, end: int, before: str, after: str) -> list[str]:
    """Features of a whole span: shape, digits, checks, and what stands beside it."""
    s = text[start:end]
    digits = _only_digits(s)
    out = ["shape " + _shape(s), f"digits {min(len(digits), 20)}", "edge " + _shape(s[0]) + _shape(s[-1]),
           "before " + before, "after " + after, f"at {s.count('@')}", f"dots {min(s.count('.'), 5)}",
           f"space {' ' in s}"]
    if 14 <= len(digits) <= 19 and not re.search("[A-Za-z@.]", s):
        out.append(f"luhn {luhn(digits)}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"parts {all(len(p) < 4 and int(p) < 256 for p in parts)}")
    if s[0] == "+":
        out.append(f"plus {10 <= len(digits) <= 15}")
    return out


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of a region (start, end), and the token ranges that may be an entity."""
    toks = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    return toks, token_ranges(text, toks, 0, len(toks))


def token_ranges(text: str, toks: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    """The token ranges that may be an entity and begin at the tokens from ``first`` up to ``last``."""
    hot = np.cumsum([0, *(text[a] in "0123456789@" for a, _ in toks)])
    spans = []
    for i in range(first, last):
        a = toks[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
            gap = toks[j - 1][0] - toks[j - 2][1] if j > i + 1 else 0
            if gap > 1 or "\n" in text[toks[j - 2][1]:toks[j - 1][0]] and j > i + 1:
                break
            if hot[j] > hot[i] and text[toks[j - 1][0]].isalnum():
                spans.append((i, j))
    return spans


def _context(text: str, toks: list[tuple[int, int]], i: int, j: int) -> tuple[str, str]:
    def kind(k: int, near: int, left: bool) -> str:
        if not 0 <= k < len(toks):
            return "end"
        a, b = toks[k]
        touch = (near == b) if left else (near == a)
        return _shape(text[a:b]) + ("+" if touch else " ")
    return kind(i - 1, toks[i][0], True), kind(j, toks[j - 1][1], False)


class Lattice:
    """Candidate segments of one region with their features as weight numbers."""

    def __init__(self, text: str, lo: int, hi: int, index: dict[str, int], learn: bool = False,
                 part: tuple[list[tuple[int, int]], list[tuple[int, int]]] | None = None):
        self.toks, self.spans = part or candidates(text, lo, hi)
        self.rows: list[list[int]] = []
        for i, j in self.spans:
            before, after = _context(text, self.toks, i, j)
            names = span_features(text, self.toks[i][0], self.toks[j - 1][1], before, after)
            if learn:
                self.rows.append([index.setdefault(f, len(index)) for f in names])
            else:
                self.rows.append([index[f] for f in names if f in index])
        self.by_end: list[list[int]] = [[] for _ in range(len(self.toks) + 1)]
        for n, (_, j) in enumerate(self.spans):
            self.by_end[j].append(n)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Score of each candidate as each kind; a token outside all entities scores 0."""
        out = np.zeros((len(self.spans), len(KINDS)))
        for n, r in enumerate(self.rows):
            out[n] = w[r].sum(axis=0) if r else -20.0
        return out

    def best(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, kind) of the best segmentation."""
        top = s.argmax(axis=1) if len(s) else []
        v, back = [0.0] * (len(self.toks) + 1), [None] * (len(self.toks) + 1)
        for j in range(1, len(self.toks) + 1):
            v[j] = v[j - 1]
            for n in self.by_end[j]:
                x = v[self.spans[n][0]] + s[n, top[n]]
                if x > v[j]:
                    v[j], back[j] = x, n
        out, j = [], len(self.toks)
        while j:
            n = back[j]
            if n is None:
                j -= 1
            else:
                out.append((n, int(top[n])))
                j = self.spans[n][0]
        return out[::-1]

    def marginals(self, s: np.ndarray) -> np.ndarray:
        """Posterior of each candidate as each kind over all segmentations."""
        n = len(self.toks)
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        every = np.logaddexp.reduce(s, axis=1) if len(s) else np.zeros(0)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[self.spans[k][0]] + every[k] for k in self.by_end[j])])
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(self.spans):
            ends[i].append(k)
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[self.spans[k][1]] + every[k] for k in ends[i])])
        if not len(s):
            return s
        outer = np.array([alpha[i] + beta[j] for i, j in self.spans]) - alpha[n]
        return np.exp(np.minimum(0.0, s + outer[:, None]))


def _either(x: float, y: float) -> float:
    """The logarithm of exp(x) + exp(y)."""
    if x < y:
        x, y = y, x
    return x if y == -inf else x + log1p(exp(y - x))


class Chain:
    """The programme over a region of any length, block of tokens by block."""

    def __init__(self, text: str, lo: int, hi: int, index: dict[str, int], w: np.ndarray):
        self.text, self.lo, self.hi, self.index, self.w = text, lo, hi, index, w
        self.begin, self.end = array("q"), array("q")
        for m in _TOKEN.finditer(text, lo, hi):
            self.begin.append(m.start())
            self.end.append(m.end())

    def _block(self, first: int, last: int) -> dict[int, list[tuple[int, float, int, float]]]:
        """Per first token of a candidate: end, score as any kind, best kind and its score."""
        base = max(0, first - 1)
        toks = list(zip(self.begin[base:last + MAX_TOKENS], self.end[base:last + MAX_TOKENS]))
        spans = token_ranges(self.text, toks, first - base, last - base)
        out: dict[int, list[tuple[int, float, int, float]]] = {}
        if spans:
            s = Lattice(self.text, self.lo, self.hi, self.index, part=(toks, spans)).scores(self.w) - _PRIOR
            each = zip(spans, np.logaddexp.reduce(s, axis=1).tolist(), s.argmax(axis=1).tolist(), s.max(axis=1).tolist())
            for (i, j), every, kind, top in each:
                out.setdefault(i + base, []).append((j + base, every, kind, top))
        return out

    def chosen(self) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, posterior) of the best segmentation's spans, in order."""
        n = len(self.begin)
        alpha, v = array("d", [-inf]) * (n + 1), array("d", [-inf]) * (n + 1)
        back, kind, gain = array("q", [-1]) * (n + 1), array("b", [0]) * (n + 1), array("d", [0.0]) * (n + 1)
        alpha[0] = v[0] = 0.0

        def step(i: int) -> None:
            # the token before is outside all entities
            alpha[i] = _either(alpha[i - 1], alpha[i])
            if v[i - 1] >= v[i]:
                v[i], back[i] = v[i - 1], -1

        for first in range(0, n, _STEP):
            last = min(n, first + _STEP)
            block = self._block(first, last)
            for i in range(first, last):
                if i:
                    step(i)
                for j, every, k, top in block.get(i, ()):
                    alpha[j] = _either(alpha[j], alpha[i] + every)
                    if v[i] + top > v[j]:
                        v[j], back[j], kind[j], gain[j] = v[i] + top, i, k, top
        if n:
            step(n)
        picked, j = [], n
        while j:
            if back[j] < 0:
                j -= 1
            else:
                picked.append((back[j], j))
                j = back[j]
        if not picked:
            return []
        beta = array("d", [-inf]) * (n + 1)
        beta[n] = 0.0
        for first in range((n - 1) // _STEP * _STEP, -1, -_STEP):
            if first + _STEP <= picked[-1][1]:
                break
            last = min(n, first + _STEP)
            block = self._block(first, last)
            for i in range(last - 1, first - 1, -1):
                beta[i] = beta[i + 1]
                for j, every, _, _ in block.get(i, ()):
                    beta[i] = _either(beta[i], beta[j] + every)
        return [(self.begin[i], kind[j], self.end[j - 1], exp(min(0.0, gain[j] + alpha[i] + beta[j] - alpha[n])))
                for i, j in reversed(picked)]


def train(samples: list[str], epochs: int = 8, rate: float = 0.3, l2: float = 1e-3) -> tuple[dict[str, int], np.ndarray]:
    """Weights by stochastic gradient (scaled by past squares) of the conditional log-likelihood of the rules' spans."""
    index: dict[str, int] = {}
    made = []
    for text in samples:
        gold = {(a, b): k for a, k, b in rule_spans(text)}
        for lo, hi in regions(text):
            lat = Lattice(text, lo, hi, index, learn=True)
            want = np.zeros((len(lat.spans), len(KINDS)))
            for n, (i, j) in enumerate(lat.spans):
                k = gold.get((lat.toks[i][0], lat.toks[j - 1][1]))
                if k is not None:
                    want[n, k] = 1
            if len(lat.spans):
                made.append((lat, want))
    w = np.zeros((len(index), len(KINDS)))
    past = np.full_like(w, 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for n in rng.permutation(len(made)).tolist():
            lat, want = made[n]
            # segments that are far too unlikely or already right to the last digit are left out
            g = want - lat.marginals(lat.scores(w) - _PRIOR)
            for k in np.flatnonzero(np.abs(g).max(axis=1) > 1e-4).tolist():
                r = lat.rows[k]
                step = g[k] - l2 * w[r]
                past[r] += step * step
                w[r] += rate * step / np.sqrt(past[r])
    return index, w


class Finder:
    """The rules and a trained model together."""

    def __init__(self, index: dict[str, int], w: np.ndarray):
        self.index, self.w = index, w

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The model's sure spans that touch none of the rules' spans."""
        out = []
        starts = [b[0] for b in base]
        widest = max((b[2] - b[0] for b in base), default=0)
        for lo, hi in regions(text):
            near = base[bisect_left(starts, lo - widest):bisect_left(starts, hi)]
            if self.w.size == 0:
                continue
            if hi - lo > _LONG:
                out += [(a, k, b) for a, k, b, p in Chain(text, lo, hi, self.index, self.w).chosen()
                        if p >= _SURE and self._free(near, widest, a, b)]
                continue
            lat = Lattice(text, lo, hi, self.index)
            s = lat.scores(self.w) - _PRIOR
            chosen = lat.best(s)
            if not chosen:
                continue
            sure = lat.marginals(s)
            for n, k in chosen:
                i, j = lat.spans[n]
                a, b = lat.toks[i][0], lat.toks[j - 1][1]
                if sure[n, k] >= _SURE and all(y <= a or b <= x for x, _, y in near):
                    out.append((a, k, b))
        return out

    @staticmethod
    def _free(near: list[tuple[int, int, int]], widest: int, a: int, b: int) -> bool:
        """No span of ``near`` (by start, none wider than ``widest``) touches a to b."""
        return all(y <= a for _, _, y in near[bisect_left(near, (a - widest,)):bisect_left(near, (b,))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 4000,
        fit_regions: int = 600, fit_chars: int = 400) -> str:
    """Train on a sample of at most ``fit_docs`` documents and ``fit_regions`` stretches of them; the model as JSON.

    Stretches of more than ``fit_chars`` characters are left out of the fit (not of the search).
    """
    count = docs.count()
    step = max(1, count // fit_docs)
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0) \
        .select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                out += [text[max(0, a - 20):b + 20] for a, b in regions(text) if b - a <= fit_chars]
            if out:
                yield pd.DataFrame({"text": out})

    found = some.mapInPandas(stretches, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(fit_regions)
    scratch = Scratch(docs.sparkSession, "segments")
    found = scratch.keep(found, "stretches").repartition(1).sortWithinPartitions("text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, w = train([t for pdf in batches for t in pdf["text"]])
        kept = {f: [round(float(x), 4) for x in w[n]] for f, n in index.items() if np.abs(w[n]).max() > 1e-3}
        yield pd.DataFrame({"model": [json.dumps(kept)]})

    got = found.mapInPandas(learn, "model string").first()
    return got["model"] if got else "{}"


def finder(model: str) -> Finder:
    kept = json.loads(model)
    index = {f: n for n, f in enumerate(kept)}
    return Finder(index, np.array(list(kept.values())) if kept else np.zeros((0, len(KINDS))))


SPAN = "struct<kind: string, start: int, end: int, rule: boolean>"


def spans(text: Column, model: str) -> Column:
    """array<struct<kind, start, end, rule>>: all spans of a whole text by start, then kind; null counts as empty.

    Offsets are code points, ends exclusive; ``rule`` tells the rules' spans from the model's.
    """
    @F.pandas_udf(f"array<{SPAN}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(model)
        for texts in batches:
            out = []
            for text in texts:
                base = rule_spans(text)
                both = [(*b, True) for b in base] + [(*a, False) for a in find.added(text, base)]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "rule": r} for a, k, b, r in sorted(both)])
            yield pd.Series(out, dtype=object)
    return run(F.coalesce(text, F.lit("")))


def _masked(t: str, found) -> str:
    parts, at = [], 0
    for start, kind, end in found:
        if start >= at:
            parts += [t[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, t[at:]])


def masked(text: Column, model: str) -> Column:
    """Each whole text with its spans masked, found and replaced in one pass; null stays null."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(model)
        for texts in batches:
            out = []
            for t in texts:
                base = rule_spans(t) if t else []
                both = sorted(base + find.added(t, base)) if t else []
                out.append(_masked(t, both) if both else t)
            yield pd.Series(out, dtype=object)
    return run(text)


def mask(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, under the first's name."""
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, spans_ in zip(texts, lists):
                if t is None or spans_ is None or not len(spans_):
                    out.append(t)
                    continue
                out.append(_masked(t, [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in spans_]))
            yield pd.Series(out, dtype=object)
    return run(text, found)
