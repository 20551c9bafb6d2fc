"""Vectorised splitting of UTF-8 text into the pieces of the public byte-level pattern.

The pattern (contractions, then letters, numbers, other characters, each with an optional leading space,
then white space) is decided by character classes alone, so numpy finds all piece boundaries of a block
of documents at once instead of running a regular expression for each piece.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
_WORDS = 4
PACKED = 8 * _WORDS


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for cp in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = SPACE
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = class_table()
    first = np.zeros(256, np.uint8)
    first[:128] = table[:128]
    cls = first[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int64)
        for low, high, more, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            m = (b0 >= low) & (b0 < high)
            at = lead[m]
            if not len(at):
                continue
            cp = b0[m] & bits
            for k in range(1, more + 1):
                cp = (cp << 6) | (buf[at + k] & 0x3F)
            c = table[np.minimum(cp, 0x10FFFF)]
            for k in range(more + 1):
                cls[at + k] = c
    return cls


def piece_starts(buf: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
    """Start bytes of all pieces of the documents that lie one after the other in buf."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
    doc_edge = np.zeros(n + 1, bool)
    doc_edge[doc_offsets] = True
    edge |= doc_edge
    runs = np.flatnonzero(edge)
    begin, end = runs[:-1], runs[1:]
    white = (cls[begin] == SPACE) & ~doc_edge[end]
    s, e = begin[white], end[white]
    last = e - 1
    while len(back := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
        last[back] -= 1
    edge[last] = True
    edge[e[buf[last] == 0x20]] = False
    quote = np.flatnonzero(buf == 0x27)
    if len(quote):
        quote = quote[edge[quote] & edge[quote + 1] & ~doc_edge[quote + 1]]
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        two &= ~doc_edge[np.minimum(quote + 2, n)] & (quote + 2 < n)
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        edge[quote + 1] = False
        edge[quote + size] = True
    return np.flatnonzero(edge[:n])


class Pieces:
    """Distinct pieces of a block: first (start, length) of each, and the index of the distinct piece at each place."""

    def __init__(self, buf: np.ndarray, doc_offsets: np.ndarray):
        self.starts = piece_starts(buf, doc_offsets)
        n = len(self.starts)
        self.lengths = np.diff(np.concatenate([self.starts, [len(buf)]]))
        self.doc_of_first = np.searchsorted(self.starts, doc_offsets)
        if not n:
            self.index, self.distinct = np.zeros(0, np.int64), []
            return
        pad = np.concatenate([buf, np.zeros(PACKED + 8, np.uint8)])
        view = np.ndarray((len(buf) + PACKED,), np.dtype("<u8"), pad.data, strides=(1,))
        mixed = self.lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        packed = []  # (pieces of over 8 k bytes, their bytes 8 k to 8 k + 7)
        for k in range(_WORDS):
            at = np.flatnonzero(self.lengths > 8 * k) if k else slice(None)
            w = view[self.starts[at] + 8 * k] & _MASKS[np.minimum(self.lengths[at] - 8 * k, 8)]
            m = (mixed[at] ^ w) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            mixed[at] = m ^ (m >> np.uint64(31))
            packed.append((at, w))
        long = np.flatnonzero(self.lengths > PACKED)
        raw = buf.tobytes() if len(long) else b""
        longs: dict[bytes, int] = {}
        for i in long.tolist():  # whole bytes decide for the few long pieces
            piece = raw[self.starts[i]: self.starts[i] + self.lengths[i]]
            mixed[i] = longs.setdefault(piece, len(longs))
        mixed[long] |= np.uint64(1) << np.uint64(63)
        short = np.ones(n, bool)
        short[long] = False
        mixed[short] &= np.uint64(2**63 - 1)
        coded = pa.array(mixed).dictionary_encode()
        index = coded.indices.to_numpy()
        first = np.empty(len(coded.dictionary), np.int64)
        first[index[::-1]] = np.arange(n - 1, -1, -1)
        rep = first[index]
        bad = self.lengths != self.lengths[rep]
        same = np.flatnonzero(~bad & (rep != np.arange(n)))
        for k, (at, w) in enumerate(packed):
            same = same[self.lengths[same] > 8 * k]
            every = np.zeros(n, np.uint64)
            every[at] = w
            bad[same] |= every[same] != every[rep[same]]
        bad &= short
        at, size = self.starts[first], self.lengths[first]
        data = buf.tobytes()
        self.distinct = [data[a: a + b] for a, b in zip(at.tolist(), size.tolist())]
        self.index = index.astype(np.int64)
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(bad).tolist():  # a collision of the 63-bit mix
            piece = data[self.starts[i]: self.starts[i] + self.lengths[i]]
            if piece not in known:
                known[piece] = len(self.distinct)
                self.distinct.append(piece)
            self.index[i] = known[piece]
