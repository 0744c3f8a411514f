"""The normaliser that a SentencePiece model carries, with source alignment.

``load_spec`` reads the normaliser part of a model file.  Its compiled
character map is a double-array trie over UTF-8 bytes, whose values point to
null-ended replacement strings.  ``normalise`` replaces the longest prefix that
the trie holds at each position (one character where there is none) and keeps,
for every byte of the result, the byte of the source it stems from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁".encode()  # what a space becomes


@dataclass(frozen=True)
class Spec:
    charsmap: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        value |= (byte & 127) << shift
        i += 1
        if byte < 128:
            return value, i
        shift += 7


def fields(b: bytes):
    """(number, value) of the fields of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i:i + n], i + n
        yield tag >> 3, value


def load_spec(model: bytes) -> Spec:
    # fixed field numbers of the published model format: normaliser 3; map 2, prefix 3, trim 4, escape 5
    got = dict(fields(dict(fields(model)).get(3, b"")))
    return Spec(got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1)))


class CharsMap:
    """Longest-prefix look-up in a compiled map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size:]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) for the longest key that starts at ``i``."""
        units, best = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for k in range(i, len(b)):
            node ^= b[k]
            if node >= len(units) or units[node] & 0x800000FF != b[k]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                at = units[node] & 0x7FFFFFFF
                best = (k + 1 - i, self.strings[at:self.strings.index(b"\0", at)])
        return best


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


def _char(b: bytes, i: int) -> int:
    lead = b[i]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def normalise(text: bytes, spec: Spec, table: CharsMap | None = None) -> tuple[bytes, np.ndarray]:
    """The normalised bytes, and for each of them (and the end) the source offset where its character begins.

    The offset after the last byte is the length of the source without
    trimmed trailing spaces, so ``align[a], align[b]`` bound the source of
    ``out[a:b]``.  The dummy prefix has no source and takes the first offset.
    """
    table = table or CharsMap(spec.charsmap)
    space = SPACE if spec.escape else b" "
    i, n = 0, len(text)
    units: list[tuple[bytes, int]] = []
    while i < n:
        hit = table.longest(text, i)
        step, out = hit if hit else (_char(text, i), text[i:i + _char(text, i)])
        units.append((out, i))
        i += step
    if spec.trim:
        while units and units[0][0].strip(b" ") == b"":
            units.pop(0)
        end = n
        while units and units[-1][0].strip(b" ") == b"":
            end = units.pop()[1]
    else:
        end = n
    out, align = bytearray(), []
    if spec.dummy_prefix and units:
        out += space
        align += [units[0][1]] * len(space)
    blank = spec.trim
    for s, at in units:
        for c in (s[k:k + 1] for k in range(len(s))):
            if c == b" ":
                if spec.trim and blank:
                    continue
                out += space
                align += [at] * len(space)
                blank = True
            else:
                out += c
                align.append(at)
                blank = False
    align.append(end)
    return bytes(out), np.asarray(align, dtype=np.int64)
