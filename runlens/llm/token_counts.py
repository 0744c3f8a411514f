"""Token counts with a byte-level BPE; huge documents are encoded in overlapping chunks.

Documents up to ``chunk_chars`` are counted where they are read.  The text is
cut at single spaces between two visible characters: the pre-tokenizer always
starts a word at such a space, so the pieces encode independently and the
count of each distinct piece is kept in a bounded memo.

Longer documents become chunk rows of their own, which any executor may take.
Neighbouring chunks overlap.  A position in the overlap is a *stable common
boundary* when both encodings start a word there and the left chunk holds
enough text beyond it to settle every look-ahead and special string; from such
a position both scans see the same text, so all later words agree.  The counts
are spliced there.  Documents without such a position in some overlap are
encoded again with the overlap (and the chunk) eight times as wide, until one
chunk holds the whole document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Scratch, slices

# characters next to which a space is never taken as a cut: anything that some
# engine may class as white space, control or format character
_GLUE = "\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯　﻿"
_CUT = re.compile(f"(?<=[^{_GLUE}]) (?=[^{_GLUE}])")
_ODD = re.compile(f"^$|^[{_GLUE}]|[{_GLUE}]$")
_EDGE = frozenset(c for c in map(chr, range(0x10000)) if re.match(f"[{_GLUE}]", c)) | {""}
_MARGIN = 64          # characters the left chunk must hold beyond a boundary
_MEMO = 400_000       # words in each generation of a worker's memo
_SLICE = 1_000_000    # characters handled together
_LOADED: dict[str, tuple] = {}


def _load(path: str) -> tuple:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        longest = max([len(t.content) for t in tok.get_added_tokens_decoder().values()], default=0)
        if longest >= _MARGIN:
            raise ValueError("an added token is longer than the splice margin")
        _LOADED[path] = (tok, Memo(_MEMO))
    return _LOADED[path]


def _lengths(tok, texts: list[str]) -> list[int]:
    return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts, by memoised pieces."""
    tok, memo = _load(path)
    out: list[int] = []
    for lo, hi in slices([len(t) for t in texts], _SLICE):
        cut = [t.split(" ") for t in texts[lo:hi]]
        heads = _lengths(tok, [c.pop(0) for c in cut])
        new = memo.missing(cut)
        memo.now.update(zip(new, _lengths(tok, [" " + w for w in new])))
        memo.now.update((w, None) for w in new if _ODD.search(w))
        get = memo.now.__getitem__
        for k, (head, words) in enumerate(zip(heads, cut)):
            try:
                if texts[lo + k][-1:] in _EDGE or texts[lo + k].split(" ", 1)[0][-1:] in _EDGE:
                    raise TypeError
                out.append(head + sum(map(get, words)))
            except TypeError:  # some space has an invisible neighbour: cut at the others only
                first, *rest = _CUT.split(texts[lo + k])
                out.append(sum(_lengths(tok, [first, *(" " + w for w in rest)])))
    return out


def word_starts(tok, text: str) -> tuple[int, list[int], list[int]]:
    """Number of tokens, and for each word its start and the tokens before it."""
    enc = tok.encode(text, add_special_tokens=False)
    pos, before, last = [], [], object()
    for k, (w, (s, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
        if w is None or w != last:
            pos.append(s)
            before.append(k)
        last = w
    return len(enc), pos, before


def cut_chunks(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the chunks of a text of ``n`` characters."""
    if n <= chunk:
        return [(0, n)]
    step = chunk - overlap
    ends = [(s, min(n, s + chunk)) for s in range(0, n - overlap, step)]
    return ends


def encode_chunk(tok, text: str, start: int, end: int, n: int, overlap: int) -> tuple:
    """(tokens, left positions, tokens before, right positions, tokens before), positions in the document."""
    total, pos, before = word_starts(tok, text)
    left = [(p + start, b) for p, b in zip(pos, before) if start and p <= overlap]
    stable = min(pos[-1] if pos else 0, end - start - _MARGIN)
    right = [(p + start, b) for p, b in zip(pos, before) if end < n and p >= end - start - overlap and p <= stable]
    return total, [p for p, _ in left], [b for _, b in left], [p for p, _ in right], [b for _, b in right]


def splice(chunks: list[tuple]) -> int | None:
    """Tokens of the document from its chunks in order, or None where two chunks share no stable boundary."""
    total, skipped = 0, 0
    for k, (n, _, _, rp, rb) in enumerate(chunks):
        if k + 1 == len(chunks):
            return total + n - skipped
        left = dict(zip(chunks[k + 1][1], chunks[k + 1][2]))
        common = [(b, left[p]) for p, b in zip(rp, rb) if p in left and b >= skipped]
        if not common:
            return None
        upto, skip_next = common[len(common) // 2]
        total += upto - skipped
        skipped = skip_next
    return total


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 512,
                 chunk_chars: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty; null and repeated ids are kept row by row;
    other columns are not read.  No text is cut: ``chunk_chars`` only decides
    which documents are encoded in chunks.
    """
    if overlap * 2 > chunk_chars or overlap <= _MARGIN:
        raise ValueError("overlap must exceed the margin and be at most half a chunk")
    spark = df.sparkSession
    # ids travel as text, so that a null does not turn whole numbers into floats
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = df.schema[id_col].dataType
    out = "id string, n_bytes long, n_tokens long"

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": count_texts(texts, path)})

    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    done = sized.where(F.length("text") <= chunk_chars).mapInPandas(small, out)
    todo = sized.where(F.length("text") > chunk_chars)
    key = ["id", "digest", "n_bytes"]
    todo = todo.withColumn("digest", F.xxhash64("text"))
    scratch = Scratch(spark, "tokens")
    parts, wide, chunk = [], overlap, chunk_chars
    for k in range(64):
        got = scratch.keep(_count_chunked(todo, key, path, chunk, wide), f"round-{k}")
        parts.append(got.where("n_tokens is not null"))
        failed = got.where("n_tokens is null").select(*key).distinct()
        if failed.isEmpty():
            break
        cond = [todo[c].eqNullSafe(failed[c]) for c in key]
        todo = todo.join(failed, cond, "left_semi")
        wide *= 8
        chunk = max(chunk, 4 * wide)
    for p in parts:
        done = done.unionByName(p.select("id", "n_bytes", "n_tokens"))
    return done.select(F.col("id").cast(id_type).alias(id_col), "n_bytes", "n_tokens",
                       (F.col("n_tokens") > max_tokens).alias("over_limit"))


def _count_chunked(todo: DataFrame, key: list[str], path: str, chunk: int, overlap: int) -> DataFrame:
    keys = "id string, digest long, n_bytes long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for no, (s, e) in enumerate(cut_chunks(len(row.text), chunk, overlap)):
                    yield pd.DataFrame({"id": [row.id], "digest": [row.digest], "n_bytes": [row.n_bytes], "no": [no],
                                        "start": [s], "stop": [e], "n": [len(row.text)], "piece": [row.text[s:e]]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, _ = _load(path)
        for pdf in batches:
            got = [encode_chunk(tok, r.piece, r.start, r.stop, r.n, overlap) for r in pdf.itertuples(index=False)]
            cols = list(zip(*got)) if got else [[]] * 5
            yield pdf[["id", "digest", "n_bytes", "no"]].assign(
                **{c: list(v) for c, v in zip(("total", "lp", "lb", "rp", "rb"), cols)})

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int((pdf["no"] == 0).sum())  # equal rows of the input share a key
        pdf = pdf.drop_duplicates("no").sort_values("no")
        n = splice(list(pdf[["total", "lp", "lb", "rp", "rb"]].itertuples(index=False, name=None)))
        first = pdf.iloc[[0] * rows]
        return first[["id", "digest", "n_bytes"]].assign(n_tokens=pd.array([n] * rows, dtype="Int64"))

    pieces = todo.select(*key, "text").mapInPandas(
        cut, f"{keys}, no int, start long, stop long, n long, piece string")
    shards = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = pieces.repartition(shards, "digest", "no").mapInPandas(
        encode, f"{keys}, no int, total long, lp array<long>, lb array<long>, rp array<long>, rb array<long>")
    return coded.groupBy(*key).applyInPandas(join_up, f"{keys}, n_tokens long")
