"""Token counts and pieces against the libraries; spans, chunks, the character map, and odd tables."""

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest

from runlens.llm import charsmap
from runlens.llm.pieces import coder, encode_decode
from runlens.llm.token_counts import _load, count_texts, count_tokens, cut_chunks, encode_chunk, splice

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "a ", " a", "  a  b ", "a\n\n b<|endoftext|> c 's 'll x y", "▁ b ▁▁c", "日本語 😀 \x00 x",
         "<s> </s> <unk>", "é" * 50, "a\n b", "a \nb", "word " * 300, "x" * 500, "don't  stop 123 \t456", "The end."]


def test_counts_equal_the_library():
    tok, _ = _load(BPE)
    assert count_texts(TEXTS, BPE) == [len(tok.encode(t, add_special_tokens=False)) for t in TEXTS]


@pytest.mark.parametrize("chunk,overlap", [(300, 140), (200, 90)])
def test_chunks_splice_to_the_whole(chunk, overlap):
    tok, _ = _load(BPE)
    text = " ".join(TEXTS) * 4 + "<|endoftext|>" + "it's " * 60 + "\n\n   \n tail"
    chunks = [encode_chunk(tok, text[s:e], s, e, len(text), overlap) for s, e in cut_chunks(len(text), chunk, overlap)]
    got = splice(chunks)
    assert got is None or got == len(tok.encode(text, add_special_tokens=False))


def test_count_tokens_of_huge_texts_widens_where_nothing_is_common(spark):
    tok, _ = _load(BPE)
    texts = [*TEXTS, None, "ab cd " * 700, "z" * 3000, "ab cd " * 700]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = count_tokens(df, BPE, chunk_chars=400, overlap=150).collect()
    want = sorted((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and sum(r.doc_id is None for r in got) == 1
    assert count_tokens(df.limit(0), BPE).count() == 0


def test_pieces_equal_the_library_and_spans_cover_the_source(spark):
    sp = coder(PIECE).sp
    df = spark.createDataFrame([*enumerate(TEXTS), (None, None), (3, "again")], "doc_id long, text string")
    rows = encode_decode(df, PIECE, outputs=("ids", "starts", "ends", "decoded", "ids_sha256", "span_bytes")).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows if r.doc_id != 3}
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = sp.encode(t, add_bos=True, add_eos=True)
        r, raw = by[i], t.encode()
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw and r.span_bytes == len(raw)
    assert encode_decode(df.limit(0), PIECE).count() == 0


def test_memo_path_equals_whole_path():
    c = coder(PIECE)
    for t in TEXTS:
        ids, border = c._whole(t)
        got, got_border = c.encode([t])[0]
        assert got == ids and border[-1] == got_border[-1]


def _compiled(table: dict[bytes, bytes]) -> bytes:
    """A compiled map with the given prefixes: a double array, built by hand."""
    strings, at = b"", {}
    for k, v in table.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, used = {0: 0}, {0}

    def place(node: int, keys: list[bytes], depth: int):
        labels = sorted({k[depth] if len(k) > depth else -1 for k in keys})
        base = 1
        while any((base ^ max(x, 0)) in used for x in labels) or (base ^ node) >= 1 << 21:
            base += 1
        for x in labels:
            used.add(base ^ max(x, 0))
        units[node] |= (base ^ node) << 10 | ((1 << 8) if -1 in labels else 0)
        for x in labels:
            child = base ^ max(x, 0)
            if x < 0:
                units[child] = 1 << 31 | at[next(k for k in keys if len(k) == depth)]
            else:
                units[child] = x
                place(child, [k for k in keys if len(k) > depth and k[depth] == x], depth + 1)
    place(0, list(table), 0)
    flat = [units.get(i, 0) for i in range(max(units) + 1)]
    blob = struct.pack(f"<{len(flat)}I", *flat)
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_and_alignment():
    table = charsmap.CharsMap(_compiled({"ﬁ".encode(): b"fi", "Å".encode(): "å".encode(), b"ab": b"X", b"abc": b"Y"}))
    spec = charsmap.Spec(b"", True, True, True)
    out, align = charsmap.normalise("  ﬁ abcab  Åz ".encode(), spec, table)
    assert out.decode() == "▁fi▁YX▁åz"
    src = "  ﬁ abcab  Åz ".encode()
    y = out.index(b"Y")
    assert src[align[y]:align[y + 1]] == b"abc" and src[align[y + 1]:align[y + 2]].startswith(b"ab")
    assert np.all(np.diff(align) >= 0) and align[-1] == len(src) - 1
