"""Removal of long repeated byte strings by blockwise suffix sorting over a difference cover.

A string of ``min_len`` bytes that starts at two places makes two suffixes that
tie to that depth.  Such ties are found without a suffix array of the corpus in
any one place:

1. *Cover sample.*  Positions whose offset modulo ``v`` lies in a perfect
   difference set are the sample (about 9 % for 200 bytes, v = 133).  Any two
   places have a common distance below ``v`` after which both are sample
   positions, so a tie of ``min_len`` bytes also is a tie of the
   ``min_len - v + 1`` bytes at these two sample positions.  The sample is
   sorted bucket by bucket and each position learns whether its name ties.
2. *Suffix buckets.*  A suffix can tie only where a cover sample within its
   reach ties; all others are settled by their sample and never sorted.  The
   rest is dealt into buckets by its first bytes, and one bucket at a time
   is sorted by a fingerprint of the ``min_len`` bytes; suffixes that tie there
   and only those start a repeated string.
3. The bytes under such strings are marked, counted and removed.

The corpus lies in a bucketed table of chunks of about ``chunk_bytes``, which
is never shuffled.  Chunks and buckets exchange packed arrays of names: each
distinct name once per chunk, answered by one bit.  A string that occurs in
every document therefore costs each chunk one name, and a task holds one chunk
or one bucket of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PACKED, chunk_table, packed_rows, with_answers
from .common import Scratch

_BASE = 0x9E3779B97F4A7C15   # odd multiplier of the rolling fingerprints
_BLOCK = 1 << 20             # positions that are fingerprinted at once
_BUCKET_BYTES = 16 << 20     # packed names that one bucket holds, about
_U32 = np.uint64(0xFFFFFFFF)


@lru_cache
def difference_cover(min_len: int) -> tuple[int, tuple[int, ...]]:
    """(v, D): the largest perfect difference set modulo v = q*q + q + 1, q prime, with v at most two thirds of the length.

    The exponents modulo v at which the powers of a generator of the field of
    q cubed elements fall into a plane form such a set.
    """
    limit = 2 * min_len // 3 + 1
    for q in (31, 29, 23, 19, 17, 13, 11, 7, 5, 3, 2):
        v = q * q + q + 1
        if v > limit:
            continue
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x, found = (0, 0, 1), []
                    for i in range(v):
                        if x[0] == 0:
                            found.append(i)
                        x = ((a * x[0] + x[1]) % q, (b * x[0] + x[2]) % q, c * x[0] % q)
                    if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                        return v, tuple(found)
    return 1, (0,)


@lru_cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_11).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def fingerprints(body: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes from each position (shorter ones at the end are left out)."""
    n = len(body) - length + 1
    out = np.empty(max(n, 0), dtype=np.uint64)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        h, p = _byte_values()[body[lo:hi + length - 1]], 1
        while 2 * p <= length:
            h = h[:-p] * np.uint64(pow(_BASE, p, 1 << 64)) + h[p:]
            p *= 2
        m, rest = hi - lo, length - p
        h = h[:m] * np.uint64(pow(_BASE, rest, 1 << 64) ^ 0x5851F42D4C957F2C) + h[rest:rest + m]
        out[lo:hi] = _mix(h)
    return out


class Chunk:
    """Texts of a chunk, one after the other, and their positions."""

    def __init__(self, body: bytes, sizes, min_len: int):
        self.min_len = min_len
        self.v, cover = difference_cover(min_len)
        self.body = np.frombuffer(body, dtype=np.uint8)
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.reach = min_len - self.v + 1     # bytes that a sample name covers
        n = len(self.body)
        in_cover = np.zeros(self.v, dtype=bool)
        in_cover[list(cover)] = True
        sample = np.zeros(n, dtype=bool)
        for s, k in zip(self.starts.tolist(), self.sizes.tolist()):
            m = k - self.reach + 1
            if k >= min_len:
                sample[s:s + m] = np.resize(in_cover, m)
        self.sample = np.flatnonzero(sample)

    def names(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of the sample as bucket and 32 bits, sorted; for each position its name; which repeat here."""
        h = fingerprints(self.body, self.reach)[self.sample] if len(self.sample) else np.zeros(0, np.uint64)
        key = (((h & _U32) % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))
        u, back, n = np.unique(key, return_inverse=True, return_counts=True)
        return u, back, n > 1

    def digests(self) -> np.ndarray:
        raw = self.body.tobytes()
        return np.array([int.from_bytes(hashlib.blake2b(raw[s:s + k], digest_size=8).digest(), "little")
                         for s, k in zip(self.starts.tolist(), self.sizes.tolist())], dtype=np.uint64)

    def suffixes(self, tied: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Positions with a tied cover sample within reach, in the texts that are not skipped."""
        ties = np.zeros(len(self.body) + 1, dtype=np.int32)
        ties[self.sample[tied] + 1] = 1
        np.cumsum(ties, out=ties)
        out = [np.zeros(0, np.int64)]
        for s, k, no in zip(self.starts.tolist(), self.sizes.tolist(), skip.tolist()):
            m = k - self.min_len + 1
            if m > 0 and not no:
                at = np.arange(s, s + m)
                out.append(at[ties[at + self.v] > ties[at]])
        return np.concatenate(out)

    def prefixes(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Distinct fingerprints in bucket order, their buckets; for each suffix its fingerprint's place; which repeat."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        u, first, back, n = np.unique(fingerprints(self.body, self.min_len)[at], return_index=True,
                                      return_inverse=True, return_counts=True)
        lead = min(16, self.min_len)
        bucket = (fingerprints(self.body, lead)[at[first]] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return u[order], bucket[order], place[back], (n > 1)[order]

    def removed(self, repeats: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Which bytes lie under a repeated string."""
        edge = np.zeros(len(self.body) + 1, dtype=np.int32)
        np.add.at(edge, repeats, 1)
        np.add.at(edge, repeats + self.min_len, -1)
        out = np.cumsum(edge[:-1]) > 0
        for k in np.flatnonzero(whole & (self.sizes >= self.min_len)).tolist():
            out[self.starts[k]:self.starts[k] + self.sizes[k]] = True
        return out


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sort one bucket; for each chunk, which of its names other chunks hold too, and which it holds first."""
    pdf = pdf.sort_values("chunk")
    kind = "<u4" if pdf["kind"].iloc[0] == 0 else "<u8"
    parts = [np.frombuffer(b, kind) for b in pdf["packed"]]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    ties, first = np.zeros(len(s), bool), np.ones(len(s), bool)
    ties[order[1:]] |= same
    ties[order[:-1]] |= same
    first[order[1:]] = ~same
    cut = np.cumsum([len(p) for p in parts])[:-1]
    return pdf[["chunk", "kind", "bucket"]].assign(
        ties=[np.packbits(x).tobytes() for x in np.split(ties, cut)],
        first=[np.packbits(x).tobytes() for x in np.split(first, cut)], n=[len(p) for p in parts])


def _bits(answers, kind: int, field: str, expected: int) -> np.ndarray:
    got = sorted((a for a in (answers if answers is not None else []) if a["kind"] == kind), key=lambda a: a["bucket"])
    bits = [np.unpackbits(np.frombuffer(a[field], np.uint8), count=a["n"]) for a in got]
    out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    if len(out) != expected:
        raise RuntimeError("answers do not fit the names of the chunk")
    return out


class _Settled:
    """What a chunk knows from the answers about its sample and whole texts."""

    def __init__(self, row, min_len: int, buckets: int):
        self.chunk = Chunk(row.body, row.sizes, min_len)
        names, back, here = self.chunk.names(buckets)
        tied = (_bits(row.answers, 0, "ties", len(names)) | here)[back]
        u, bucket, place, here = _digest_names(self.chunk.digests(), buckets)
        ties, first = _bits(row.answers, 1, "ties", len(u)), _bits(row.answers, 1, "first", len(u))
        seen, opens = set(), []
        for k in place.tolist():
            opens.append(k not in seen)
            seen.add(k)
        self.copied = (ties | here)[place]
        # of equal texts only the first has its suffixes sorted
        self.skip = self.copied & ~(first[place] & np.asarray(opens, dtype=bool))
        self.at = self.chunk.suffixes(tied, self.skip)


def _digest_names(digests: np.ndarray, buckets: int):
    u, back, n = np.unique(digests, return_inverse=True, return_counts=True)
    bucket = (_mix(u) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return u[order], bucket[order], place[back], (n > 1)[order]


def remove_repeats(df: DataFrame, min_len: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   outputs: tuple[str, ...] = ("spans", "kept"), chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256 and the asked ``outputs``.

    Each byte under a string of ``min_len`` bytes that also starts elsewhere in
    the table (in the same text too, overlaps included) is removed.  ``spans``
    array<struct<start,end>>, the maximal removed runs in bytes; ``kept`` binary,
    the remaining bytes.  A null text counts as empty; null and repeated ids are
    kept; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunk_table(docs, scratch, chunk_bytes)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    v, cover = difference_cover(min_len)
    few = max(shards, ceil(total * len(cover) / v * 4 / _BUCKET_BYTES))
    many = max(shards, ceil(total * 2 / _BUCKET_BYTES))
    answer = "chunk long, kind int, bucket long, ties binary, first binary, n int"

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                c = Chunk(row.body, row.sizes, min_len)
                u, _, _ = c.names(few)
                yield from packed_rows(row.chunk, 0, u >> np.uint64(32), (u & _U32).astype("<u4"))
                u, bucket, _, _ = _digest_names(c.digests(), few)
                yield from packed_rows(row.chunk, 1, bucket, u)

    first = scratch.keep(chunks.select("chunk", "sizes", "body").mapInPandas(sample, PACKED)
                         .groupBy("kind", "bucket").applyInPandas(_answer, answer), "answers-1")

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = _Settled(row, min_len, few)
                u, bucket, _, _ = s.chunk.prefixes(s.at, many)
                yield from packed_rows(row.chunk, 2, bucket, u)

    def told(answers: DataFrame) -> DataFrame:
        return with_answers(chunks, answers, "kind", "bucket", "ties", "first", "n")

    second = scratch.keep(told(first).select("chunk", "sizes", "body", "answers").mapInPandas(suffixes, PACKED)
                          .groupBy("kind", "bucket").applyInPandas(_answer, answer), "answers-2")

    kinds = {"spans": "array<struct<start: long, end: long>>", "kept": "binary"}
    schema = "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + \
        "".join(f", {o} {kinds[o]}" for o in outputs)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = _Settled(row, min_len, few)
                u, _, place, here = s.chunk.prefixes(s.at, many)
                ties = _bits(row.answers, 2, "ties", len(u)) | here
                gone = s.chunk.removed(s.at[ties[place]], s.copied)
                cols: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *outputs)}
                for a, k in zip(s.chunk.starts.tolist(), s.chunk.sizes.tolist()):
                    mine = gone[a:a + k]
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                    kept = s.chunk.body[a:a + k][~mine].tobytes()
                    put = {"n_bytes": k, "n_removed": int(mine.sum()), "n_spans": len(edge) // 2,
                           "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept,
                           "spans": [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()]}
                    for c in cols:
                        cols[c].append(put[c])
                ids = pd.Series(list(row.ids), dtype=object)
                yield pd.DataFrame({"id": ids, **cols})

    # ids travel as text, so that a null does not turn whole numbers into floats
    out = told(first.unionByName(second)).select(F.col("ids").cast("array<string>").alias("ids"), "sizes", "body", "answers") \
        .mapInPandas(finish, schema)
    return out.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)
