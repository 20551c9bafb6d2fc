"""Removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a smaller doc_id. Equal
strings have the same smallest 24-byte gram (by a mixed hash), so that gram decides where they meet:

1. ask: each block of documents sends, by gram, one entry for its distinct grams; grams met in two documents or more are
   shared and are told to the document groups that hold them. Text that nobody shares stops here.
2. gather: each document group cuts its text into runs of windows with one shared gram and sends every distinct run
   once, with its smallest doc_id. Grams in over hot_docs documents are dealt out window by window, by the
   window's own hash, so that a line in a third of all documents is no hot group.
3. judge: runs that meet at a gram are put into one text, whose Burrows-Wheeler transform is expanded breadth first:
   from intervals of strings of l bytes, backward extension gives those of l + 1 bytes and so the common prefixes of
   exactly l bytes. It stops at `length`; neighbours still without a value share at least that much. Each such class
   gets its smallest doc_id. A gram with only one distinct run needs no comparison.
4. remove: the answers go back to the document groups, which mark and cut bytes.

Groups and buckets are numbered by the bytes of the input, so what a task holds stays the same at any size; the text is
shuffled once (both uses share the exchange). Nothing reaches the driver but one sum.

Defined cases: null text counts as empty (and stays null in remove_text()); texts shorter than `length` keep everything;
rows with equal doc_id are one document, whose rows don't remove each other; a null doc_id is smaller than all
others; an empty table stays empty; remove_text() carries other columns, spans() does not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, blocks_of, give_back, map_batches, plain_names

GRAM = 24
_NULL_ID = -(2**63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each width consecutive elements, by doubling."""
    out, span, rest = a, 1, width
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(out) - (width - span)], out[width - span:]) if width > span else out


#: Places whose grams are hashed at once.
_PART = 1 << 14


def window_grams(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of length bytes inside documents, 48-bit hash of each window's smallest gram)."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, whole = n - GRAM + 1, n - length + 1
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = [np.ndarray((places,), "<u8", pad[k:].data, strides=(1,)) for k in range(0, GRAM, 8)]
    low = np.empty(whole, np.uint64)
    for at in range(0, whole, _PART):  # parts that stay in a core's cache
        end = min(whole, at + _PART)
        part = slice(at, end + length - GRAM)
        h = words[0][part] * _ODD[0]
        for word in words[1:]:
            h ^= h >> np.uint64(29)
            h += word[part]
            h *= _ODD[1]
        h ^= h >> np.uint64(32)
        h *= _ODD[2]
        h ^= h >> np.uint64(31)
        low[at:end] = _slide(h, length - GRAM + 1, np.minimum)
    starts = _ranges(off[:-1], np.maximum(np.diff(off) - length + 1, 0))
    return starts, low[starts] >> np.uint64(16)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + size)."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _text_blocks(raw: np.ndarray, off: np.ndarray, limit: int = 1 << 21):
    for i, j in blocks_of(off, limit):
        yield i, j, raw[off[i]: off[j]], off[i: j + 1] - off[i]


def _distinct_pairs(grams: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (gram, doc place), sorted."""
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    o = np.lexsort((docs, grams))
    grams, docs = grams[o], docs[o]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    return grams[new], docs[new]


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


_ASK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_ASK_SQL = "bucket int, kind int, grp int, n int, blob binary"


def _pack(*arrays, level: int = 1) -> bytes:
    """Arrays as byte planes (numbers of one size have like high bytes), compressed; bytes as they are."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a for a in map(np.asarray, arrays)]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in planes))


def _unpack(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def _steps(sorted_grams: np.ndarray) -> np.ndarray:
    return np.diff(sorted_grams, prepend=np.uint64(0))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _cut(keys: np.ndarray):
    """(key, order of its rows) for each distinct key."""
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    edges = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)) if len(k) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(k[a]), o[a:b]


#: In a block of text, a gram of so many documents or more is not asked about for each of them.
LOCAL_HOT = 16


def _ask(length: int, buckets: int):
    """kind 0: (gram, doc, group to be told or -1, documents it stands for). kind 1: grams of many documents of a block, told to their groups at once."""
    def run(batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(2))
            ids, grps = _ids(batch.column(0)), batch.column(1).to_numpy()
            for i, j, buf, part in _text_blocks(raw, off):
                starts, grams = window_grams(buf, part, length)
                if not len(starts):
                    continue
                grams, place = _distinct_pairs(grams, np.searchsorted(part, starts, side="right") - 1)
                docs, grp = ids[i:j][place], grps[i:j][place]
                head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
                count = np.diff(np.append(head, len(grams)))
                known = np.repeat(count >= LOCAL_HOT, count)
                rows = []
                for g, at in _cut(grp[known]):
                    pairs = np.unique(grams[known][at])
                    rows.append((g % buckets, 1, g, len(pairs), _pack(_steps(pairs))))
                many = head[count >= LOCAL_HOT]
                least = np.minimum.reduceat(docs, head)[count >= LOCAL_HOT]
                a_gram, a_doc = np.concatenate([grams[~known], grams[many]]), np.concatenate([docs[~known], least])
                a_grp = np.concatenate([grp[~known], np.full(len(many), -1)]).astype(np.int32)
                a_count = np.concatenate([np.ones(int((~known).sum())), count[count >= LOCAL_HOT]]).astype(np.int32)
                o = np.argsort(a_gram, kind="stable")
                a_gram, a_doc, a_grp, a_count = a_gram[o], a_doc[o], a_grp[o], a_count[o]
                for b, at in _cut((a_gram % np.uint64(buckets)).astype(np.int64)):  # stable: grams stay sorted
                    rows.append((b, 0, 0, len(at), _pack(_steps(a_gram[at]), a_doc[at], a_grp[at], a_count[at])))
                yield _rows(rows, _ASK)
    return run


_TOLD = pa.schema([("grp", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_TOLD_SQL = "grp int, n int, blob binary"


ONE_WAY, BY_WINDOW, BOTH_WAYS = 0, 1, 2


def _tell(hot_docs: int):
    """Of one bucket, the shared grams for each group that asked, with the way their runs go.

    A group that did not ask, as its block knew the gram as shared, can't tell whether it is hot, and sends it both ways.
    """
    def run(key, table):
        rows, parts = [], []
        for kind, grp, n, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "grp", "n", "blob"))):
            if kind == 0:
                part = _unpack(blob, n, np.uint64, np.int64, np.int32, np.int32)[:4]
                parts.append([np.cumsum(part[0], dtype=np.uint64), *part[1:]])
            else:
                rows.append((grp, n, _pack(_unpack(blob, n, np.uint64)[0], np.full(n, BOTH_WAYS, np.uint8))))  # steps stay steps
        if parts:
            grams, docs, grps, count = (np.concatenate(x) for x in zip(*parts))
            o = np.argsort(grams, kind="stable")
            grams, docs, grps, count = grams[o], docs[o], grps[o], count[o]
            head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            size = np.diff(np.append(head, len(grams)))
            shared = (np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)) | (np.maximum.reduceat(count, head) > 1)
            hot = np.add.reduceat(count.astype(np.int64), head) > hot_docs
            keep = np.repeat(shared, size) & (grps >= 0)
            way = np.where(np.repeat(hot, size)[keep], BY_WINDOW, ONE_WAY).astype(np.uint8)
            told = grams[keep]
            for g, at in _cut(grps[keep]):
                rows.append((g, len(at), _pack(_steps(told[at]), way[at])))
        return pa.Table.from_batches([_rows(rows, _TOLD)])
    return run


def _shared_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shared grams, way of each); an answer to a question goes before what a block knew."""
    parts = [_unpack(b, n, np.uint64, np.uint8)[:2] for n, b in zip(table.column("n").to_pylist(), table.column("blob").to_pylist())]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    grams, way = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in parts]), np.concatenate([w for _, w in parts])
    o = np.lexsort((way, grams))
    grams, way = grams[o], way[o]
    head = np.append(True, grams[1:] != grams[:-1])
    return grams[head], way[head]


def _runs(buf: np.ndarray, off: np.ndarray, length: int, shared: np.ndarray):
    """(first window, number of windows, gram, doc place) of the runs with shared grams."""
    starts, grams = window_grams(buf, off, length)
    if not len(starts) or not len(shared):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    edge = np.append(True, (grams[1:] != grams[:-1]) | (starts[1:] != starts[:-1] + 1))
    head = np.flatnonzero(edge)
    size = np.diff(np.append(head, len(starts)))
    g = grams[head]
    at = np.minimum(np.searchsorted(shared, g), len(shared) - 1)
    ok = shared[at] == g
    first = starts[head][ok]
    return first, size[ok], g[ok], np.searchsorted(off, first, side="right") - 1


class _Contents:
    """Of one group: its texts, its runs in blocks, and the distinct contents of runs with gram, way and smallest doc_id."""

    def __init__(self, table: pa.Table, told: pa.Table, length: int):
        self.raw, self.off = binary_parts(table.column("text"))
        self.ids = _ids(table.column("doc_id").combine_chunks())
        shared, ways = _shared_of(told)
        self.names: dict[bytes, int] = {}
        self.blocks, grams, docs = [], [], []
        for i, j, buf, part in _text_blocks(self.raw, self.off):
            first, size, gram, doc = _runs(buf, part, length, shared)
            data, names = buf.tobytes(), self.names
            which = np.fromiter((names.setdefault(data[a: b], len(names)) for a, b in zip(first.tolist(), (first + size + length - 1).tolist())), np.int32, len(first))
            self.blocks.append((i, j, len(buf), first, size, doc, which))
            grams.append(gram)
            docs.append(self.ids[i:j][doc])
        self.gram, self.doc = np.zeros(len(self.names), np.uint64), np.full(len(self.names), np.iinfo(np.int64).max)
        for block, gram, doc in zip(self.blocks, grams, docs):
            self.gram[block[-1]] = gram
            np.minimum.at(self.doc, block[-1], doc)
        self.way = ways[np.searchsorted(shared, self.gram)] if len(self.gram) else np.zeros(0, np.uint8)


_SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_SENT_SQL = "bucket int, grp int, n int, blob binary"


def _dealt(found: _Contents, length: int, buckets: int):
    """(bucket, texts, smallest docs, keys, numbers of whole runs, -1 for windows) of what a group sends, in an order that only its contents decide."""
    names = sorted(found.names)
    at = np.fromiter(map(found.names.__getitem__, names), np.int64, len(names))
    grams, docs, way = found.gram[at], found.doc[at], found.way[at]
    windows: dict[bytes, int] = {}
    for k in np.flatnonzero(way != ONE_WAY).tolist():
        t, d = names[k], int(docs[k])
        for s in range(len(t) - length + 1):
            w = t[s: s + length]
            if windows.get(w, 2**63) > d:
                windows[w] = d
    whole = way != BY_WINDOW
    texts = [names[k] for k in np.flatnonzero(whole).tolist()] + list(windows)
    keys = np.concatenate([grams[whole], np.array([int.from_bytes(hashlib.blake2b(w, digest_size=6).digest(), "little") for w in windows], np.uint64)])
    docs = np.concatenate([docs[whole], np.fromiter(windows.values(), np.int64, len(windows))])
    which = np.concatenate([at[whole], np.full(len(windows), -1)])
    for b, at in _cut(((keys >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)):
        o = at[np.argsort(keys[at], kind="stable")]
        yield b, [texts[k] for k in o.tolist()], docs[o], keys[o], which[o]


def _gather(length: int, buckets: int):
    def run(key, left, right):
        grp = key[0].as_py()
        rows = []
        for b, texts, docs, keys, _ in _dealt(_Contents(left, right, length), length, buckets):
            rows.append((b, grp, len(texts), _pack(_steps(keys), docs, np.fromiter(map(len, texts), np.int32, len(texts)), np.frombuffer(b"".join(texts), np.uint8), level=3)))
        return pa.Table.from_batches([_rows(rows, _SENT)])
    return run


def suffix_order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of sym sorted by at least depth symbols (prefix doubling)."""
    n, wide = len(sym), int(sym.max(initial=0)) > 255
    per = 4 if wide else 8
    pad = np.concatenate([sym.astype(">u2" if wide else np.uint8), np.zeros(per, ">u2" if wide else np.uint8)])
    word = np.ndarray((n,), ">u8", np.ascontiguousarray(pad).data, strides=(pad.itemsize,)).astype(np.uint64)
    order = np.argsort(word)
    span = per
    w = word[order]
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, w[1:] != w[:-1]))
        if span >= depth or rank.max() == n:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: n - span] = rank[span:] if span < n else 0
        word = ((rank << 32) | nxt).view(np.uint64)
        order = np.argsort(word)
        w = word[order]
        span *= 2


class Wavelet:
    """Wavelet matrix of a symbol array; gives the distinct symbols of many ranges at once, with their counts before and in the range."""

    def __init__(self, sym: np.ndarray):
        self.bits = max(1, int(sym.max(initial=1)).bit_length())
        self.zeros, self.ranks = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (sym >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            self.zeros.append(int(self.ranks[-1][-1]))
            one = bit.astype(bool)
            sym = np.concatenate([sym[~one], sym[one]])
        head = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))  # equal symbols end up together
        self.first = np.zeros(1 << self.bits, np.int64)
        self.first[sym[head]] = head

    def expand(self, lo: np.ndarray, hi: np.ndarray):
        """(symbol, occurrences before lo, occurrences before hi) of every symbol in every range [lo, hi)."""
        sym = np.zeros(len(lo), np.int64)
        for zeros, rank in zip(self.zeros, self.ranks):
            l0, h0 = rank[lo], rank[hi]
            left, right = h0 > l0, (hi - h0) > (lo - l0)
            sym = np.concatenate([sym[left] << 1, (sym[right] << 1) | 1])
            lo, hi = np.concatenate([l0[left], (lo - l0)[right] + zeros]), np.concatenate([h0[left], (hi - h0)[right] + zeros])
        return sym, lo - self.first[sym], hi - self.first[sym]


def long_prefix_classes(sym: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each place in it): suffixes with length common symbols share a class.

    The common prefix before place j is set by breadth-first backward extension, in order of value, up to length - 1;
    a place that has none by then starts no new class.
    """
    order = suffix_order(sym, length + 2)
    n = len(sym)
    bwt = sym[order - 1].astype(np.int64)
    wave = Wavelet(bwt)
    before = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=int(sym.max()) + 1))]).astype(np.int64)
    run = np.cumsum(np.append(True, bwt[1:] != bwt[:-1]))
    back = np.empty(n, np.int64)  # place of each suffix once the symbol before it is put in front
    back[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        one = run[lo] == run[hi - 1]  # the same symbol before all of the interval: its places move on as they are
        s, a, b = wave.expand(lo[~one], hi[~one])
        lo, hi = np.concatenate([back[lo[one]], before[s] + a]), np.concatenate([back[hi[one] - 1] + 1, before[s] + b])
        new = ~cut[hi]
        if not new.any() and not len(lo):
            break
        cut[hi[new]] = True
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
    return order, np.cumsum(cut[:n]) - 1


def smallest_docs(texts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the smallest doc of every window of length bytes over all texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    used = np.zeros(256, bool)
    inner = np.ones(len(data), bool)
    inner[ends - 1] = False
    used[data[inner]] = True
    code = np.cumsum(used).astype(np.uint16)  # 0 is the end of a text
    sym = np.where(inner, code[data], 0).astype(np.uint16)
    order, cls = long_prefix_classes(sym, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = order + length < ends[owner[order]]
    least = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls[whole], docs[owner[order[whole]]])
    at = np.empty(len(data), np.int64)
    at[order] = least[cls]
    return [at[a: b - length] for a, b in zip(starts.tolist(), ends.tolist())]


_JUDGED = pa.schema([("grp", pa.int32()), ("n", pa.int32()), ("blob", pa.binary()), ("bucket", pa.int32())])
_JUDGED_SQL = "grp int, n int, blob binary, bucket int"


def _judge(length: int, batch_bytes: int = 1 << 18):
    """The smallest docs of all windows, back to the groups in the order in which each sent its texts."""
    def run(key, table):
        names: dict[bytes, int] = {}
        sent, keys, docs = [], [], []
        for grp, n, blob in zip(*(table.column(c).to_pylist() for c in ("grp", "n", "blob"))):
            step, doc, sizes, raw = _unpack(blob, n, np.uint64, np.int64, np.int32)
            data, ends = raw.tobytes(), np.cumsum(sizes)
            which = np.fromiter((names.setdefault(data[a:b], len(names)) for a, b in zip((ends - sizes).tolist(), ends.tolist())), np.int64, n)
            sent.append((grp, which))
            keys.append(np.cumsum(step, dtype=np.uint64))
            docs.append(doc)
        texts, ids = list(names), np.concatenate([w for _, w in sent])
        del names
        count = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, ids, np.concatenate(docs))
        # distinct (key, text): a text can come as a run of its gram and as a window of its own key
        keys, ids = _distinct_pairs(np.concatenate(keys), ids)
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        many = np.diff(np.append(head, len(keys)))
        alone = (many == 1) & (count[ids[head]] <= length)
        ends = np.cumsum(np.append(0, count))
        answer = np.full(ends[-1], np.iinfo(np.int64).max)
        lone = np.unique(ids[head[alone]])
        answer[_ranges(ends[lone], count[lone])] = np.repeat(least[lone], count[lone])
        head, many = head[~alone], many[~alone]
        pooled = ids[_ranges(head, many)]
        full = np.cumsum(count[pooled] + length - 1)[np.cumsum(many) - 1]  # bytes up to the end of each key's texts
        at = np.cumsum(many)
        i = k = 0
        while k < len(head):
            k = min(len(head), int(np.searchsorted(full, (full[k - 1] if k else 0) + batch_bytes, side="right")) + 1)
            pool, i = pooled[i: at[k - 1]], int(at[k - 1])
            said = np.concatenate(smallest_docs([texts[t] for t in pool.tolist()], least[pool], length))
            np.minimum.at(answer, _ranges(ends[pool], count[pool]), said)
        rows = []
        bucket = key[0].as_py()
        for grp, which in sent:
            told = answer[_ranges(ends[which], count[which])]
            head = np.flatnonzero(np.append(True, told[1:] != told[:-1]))  # runs of one document
            rows.append((grp, len(head), _pack(told[head], np.diff(np.append(head, len(told))).astype(np.int32)), bucket))
        return pa.Table.from_batches([_rows(rows, _JUDGED)])
    return run


def removed_masks(left: pa.Table, told: pa.Table, judged: pa.Table, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, mask of removed bytes) of the texts of one group."""
    found = _Contents(left, told, length)
    count = np.fromiter(map(len, found.names), np.int64, len(found.names)) - length + 1
    ends = np.cumsum(np.append(0, count))
    values = np.full(ends[-1], np.iinfo(np.int64).max)
    answer: dict[bytes, int] = {}  # of windows that came one by one
    said = {b: _unpack(blob, n, np.int64, np.int32)[:2] for b, n, blob in zip(judged.column("bucket").to_pylist(), judged.column("n").to_pylist(), judged.column("blob").to_pylist())}
    for b, texts, _, _, which in _dealt(found, length, buckets):
        docs, run = np.repeat(*said.pop(b)), which >= 0
        size = np.where(run, count[which], 1) if len(count) else np.ones(len(which), np.int64)
        start = np.cumsum(size) - size
        values[_ranges(ends[which[run]], size[run])] = docs[_ranges(start[run], size[run])]
        single = np.flatnonzero(~run)
        answer.update(zip((texts[k] for k in single.tolist()), docs[start[single]].tolist()))
    if answer:
        names = list(found.names)
        for k in np.flatnonzero(found.way != ONE_WAY).tolist():
            t, n = names[k], int(count[k])
            part = values[ends[k]: ends[k] + n]
            np.minimum(part, np.fromiter((answer[t[s: s + length]] for s in range(n)), np.int64, n), out=part)
    del answer
    mask = np.zeros(len(found.raw), bool)
    for i, j, n, first, size, doc, which in found.blocks:
        if not len(first):
            continue
        where = _ranges(first, size)
        hit = where[values[_ranges(ends[which], size)] < np.repeat(found.ids[i:j][doc], size)]
        delta = np.bincount(hit, minlength=n + 1) - np.bincount(hit + length, minlength=n + 1)
        mask[found.off[i]: found.off[j]] = np.cumsum(delta[:-1]) > 0
    return found.raw, found.off, mask


def _freed(run):
    """run for applyInArrow, giving memory back after each group."""
    def one(*args):
        try:
            return run(*args)
        finally:
            give_back()

    return (lambda key, table: one(key, table)) if run.__code__.co_argcount == 2 else (lambda key, left, right: one(key, left, right))


def _remove(length: int, buckets: int, finish):
    def run(key, left, right):
        kind = right.column("kind").to_numpy()
        told, judged = (right.filter(pa.array(kind == k)) for k in (0, 1))
        return finish(left, *removed_masks(left, told, judged, length, buckets))
    return run


def _spans_table(left, raw, off, mask) -> pa.Table:
    out = []
    for k in range(len(off) - 1):
        m = mask[off[k]: off[k + 1]]
        runs = int((m & ~np.append(False, m[:-1])).sum()) if len(m) else 0
        out.append((int(off[k + 1] - off[k]), int(m.sum()), runs, hashlib.sha256(raw[off[k]: off[k + 1]][~m].tobytes()).hexdigest()))
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table([left.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut_table(left, raw, off, mask) -> pa.Table:
    text = left.column("text")
    values = text.to_pylist()
    for k in range(len(off) - 1):
        m = mask[off[k]: off[k + 1]]
        if m.any():
            values[k] = raw[off[k]: off[k + 1]][~m].tobytes().decode("utf-8", "ignore")
    at = left.schema.get_field_index("text")
    return left.set_column(at, "text", pa.array(values, pa.string()))


def _run(docs: DataFrame, length: int, hot_docs: int, group_bytes: int, finish, schema) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"length is at least {GRAM}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes), 1)
    group = "group_of_text"
    text = docs.withColumn(group, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    grouped = text.repartition(n, group)
    asked = map_batches(text.select(F.col("doc_id").cast("bigint"), group, "text"), _ask(length, n), _ASK_SQL)
    told = asked.groupBy("bucket").applyInArrow(_freed(_tell(hot_docs)), _TOLD_SQL).repartition(n, "grp")
    sent = grouped.groupBy(group).cogroup(told.groupBy("grp")).applyInArrow(_freed(_gather(length, n)), _SENT_SQL)
    judged = sent.groupBy("bucket").applyInArrow(_freed(_judge(length)), _JUDGED_SQL)
    back = told.withColumn("bucket", F.lit(0)).withColumn("kind", F.lit(0)).union(judged.withColumn("kind", F.lit(1)))
    return grouped.groupBy(group).cogroup(back.groupBy("grp")).applyInArrow(_freed(_remove(length, n, lambda left, *parts: finish(left.drop_columns([group]), *parts))), schema)


def spans(docs: DataFrame, length: int = 50, hot_docs: int = 1000, group_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return _run(docs.select("doc_id", "text"), length, hot_docs, group_bytes, _spans_table, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_text(docs: DataFrame, length: int = 50, hot_docs: int = 1000, group_bytes: int = 16 << 20) -> DataFrame:
    """docs with the removed bytes cut from text; bytes of a character cut in two go as well."""
    plain = plain_names(docs, "doc_id", "text")
    return _run(plain, length, hot_docs, group_bytes, _cut_table, plain.schema).toDF(*docs.columns)
