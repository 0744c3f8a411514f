"""SentencePiece encoding and decoding that keeps, for every piece, its byte span in the source.

The model's own normaliser spec is read by ``charsmap``: longest-prefix
replacement through the compiled map records the source offset of every
normalised byte, and pieces, which partition the normalised text, are projected
through that record.

Where the map is empty, the spec neither trims nor skips the prefix, and no
piece of the vocabulary holds a space mark after another character, a word is
encoded alike wherever it stands.  Then texts are cut before such marks and the
ids of each distinct word are kept in a bounded memo.  Any
other model takes the general path, one library call per text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charsmap import SPACE, CharsMap, load_spec, normalise
from .common import Memo, slices

_CUT = re.compile("(?<=[^ ▁]) ")
_MEMO = 100_000       # words in each generation of a worker's memo
_SLICE = 1_000_000
_LOADED: dict[str, "Coder"] = {}


class Coder:
    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.spec = load_spec(f.read())
        self.table = CharsMap(self.spec.charsmap)
        sp, mark = self.sp, SPACE.decode()
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = [sp.is_byte(i) for i in range(size)]
        self.unk = sp.unk_id()
        # bytes of the normalised text that a piece stands for
        self.width = np.array([1 if b else len(p.encode()) for p, b in zip(self.pieces, self.is_byte)], dtype=np.int64)
        # with an empty map the source of a piece is the piece, each mark being one space
        self.source = np.array([1 if b else len(p.replace(mark, " ").encode())
                                for p, b in zip(self.pieces, self.is_byte)], dtype=np.int64)
        free = all(mark not in p.lstrip(mark) for p in self.pieces)
        bytes_known = sum(self.is_byte) == 256
        self.by_word = (not self.spec.charsmap and self.spec.dummy_prefix and not self.spec.trim and self.spec.escape
                        and free and bytes_known and sp.piece_to_id(mark) != self.unk)
        self.lone = sp.piece_to_id(mark)
        self.memo = Memo(_MEMO)

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids (little-endian unsigned 32 bits) and the byte offsets of the piece borders."""
        return self._by_word(texts) if self.by_word else [self._whole(t) for t in texts]

    def _by_word(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        cut = [[] if not t else _CUT.split(t) if "  " in t or "▁" in t or t[0] == " " else t.split(" ")
               for t in texts]
        memo = self.memo.now
        new = self.memo.missing(cut)
        if new:
            # a word as it stands after a space; nothing after a last space leaves a lone mark
            for w, ids in zip(new, self.sp.encode(new, num_threads=1)):
                memo[w] = pack("<%dI" % len(ids), *ids) if w else pack("<I", self.lone)
        out, get = [], memo.__getitem__
        for t, c in zip(texts, cut):
            raw = b"".join(map(get, c))
            ids = np.frombuffer(raw, "<u4")
            if "▁" in t:  # marks of the source itself: project through the recorded alignment
                norm, align = normalise(t.encode(), self.spec, self.table)
                ends = np.concatenate(([0], np.cumsum(self.width[ids])))
                if ends[-1] != len(norm):
                    raise ValueError("pieces do not partition the normalised text")
                border = align[ends]
            else:
                border = np.concatenate(([0], np.cumsum(self.source[ids]) - 1)) if c else np.zeros(1, np.int64)
            out.append((raw, border))
        return out

    def _whole(self, text: str) -> tuple[bytes, np.ndarray]:
        norm, align = normalise(text.encode(), self.spec, self.table)
        pieces = self.sp.encode(text, out_type=str)
        ids = self.sp.encode(text)
        width = [1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, pieces)]
        ends = np.cumsum(np.asarray([0, *width], dtype=np.int64))
        if ends[-1] != len(norm):
            raise ValueError("pieces do not partition the normalised text")
        return np.asarray(ids, "<u4").tobytes(), align[ends]


def coder(path: str) -> Coder:
    if path not in _LOADED:
        _LOADED[path] = Coder(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True,
                  end: bool = True, outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded")) -> DataFrame:
    """One row per row of ``df``: id, n_tokens and the asked ``outputs``.

    ``ids`` array<int> with begin and end ids; ``starts`` and ``ends``
    array<long>, the byte span of each id in the source (begin and end ids are
    empty spans); ``decoded`` the library's decoding of the ids; ``ids_sha256``
    and ``decoded_sha256`` digests of the two; ``span_bytes`` the bytes that
    the spans cover.  A null text counts as empty; null and repeated ids are
    kept; other columns are not read.
    """
    # ids travel as text, so that a null does not turn whole numbers into floats
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {"ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string",
             "ids_sha256": "string", "decoded_sha256": "string", "span_bytes": "long"}
    schema = "id string, n_tokens long, " + ", ".join(f"{c} {kinds[c]}" for c in outputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        head = np.asarray([c.sp.bos_id()], "<u4").tobytes() if begin else b""
        tail = np.asarray([c.sp.eos_id()], "<u4").tobytes() if end else b""
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in slices([len(t) for t in texts], _SLICE):
                cols: dict[str, list] = {k: [] for k in ("n_tokens", *outputs)}
                for raw, border in c.encode(texts[lo:hi]):
                    raw = head + raw + tail
                    ids = np.frombuffer(raw, "<u4")
                    cols["n_tokens"].append(len(ids))
                    put = {}
                    if "ids" in cols:
                        put["ids"] = ids.astype(np.int32)
                    if "starts" in cols or "ends" in cols:
                        last = border[-1:]
                        put["starts"] = np.concatenate((border[:1] * 0 if begin else [], border[:-1],
                                                        last if end else [])).astype(np.int64)
                        put["ends"] = np.concatenate((border[:1] * 0 if begin else [], border[1:],
                                                      last if end else [])).astype(np.int64)
                    if "decoded" in cols or "decoded_sha256" in cols:
                        put["decoded"] = c.sp.decode(ids.tolist())
                        put["decoded_sha256"] = hashlib.sha256(put["decoded"].encode()).hexdigest()
                    put["ids_sha256"] = hashlib.sha256(raw).hexdigest()
                    put["span_bytes"] = int(border[-1] - border[0])
                    for k in outputs:
                        cols[k].append(put[k])
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].reset_index(drop=True), **cols})

    return docs.mapInPandas(run, schema).select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_tokens", *outputs)
