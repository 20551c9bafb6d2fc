"""Byte-level BPE: encoding by a fold of ranked merges in Spark's higher-order functions, decoding by binary pieces.

Text is split into pieces in blocks of consecutive rows of a partition. The distinct pieces of a task travel as rows of
row_words arrays of byte ids each, ahead of the block that first has them; a block's row holds its documents and the
number of the piece at each place. Spark folds the ranked merges over each distinct piece, with the rank map as a
literal of the plan, and the rows, still in order, are put together again. A task numbers its pieces anew after
scope_words of them, which bounds memory. Nothing is shuffled; a lost executor costs only its own partitions again.

The rank map is a row-displaced sparse matrix: rank of (a, b) at shift[a] + b, beside the owner a. Inside the fold ids and
ranks count from 1, so that an empty place is 0 for every owner; zeros are one shared object wherever the plan is read.

Defined cases: null text counts as empty and gives no ids; repeated rows give repeated rows; an empty table gives an
empty table; other columns of the input are not carried. Pieces over long_piece bytes (the fold is quadratic in the
piece) are merged by a heap in Python, with the same result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, blocks_of, map_batches
from .wordsplit import Pieces

#: Bits of a byte's place in its piece, so the most that long_piece can be is 2 ** PLACE_BITS - 2.
PLACE_BITS = 12


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file (token in base64, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of tokens whose joined bytes are a token."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


@functools.cache
def rank_table(path: str) -> tuple[int, list[int], list[int]]:
    """(bits, shift, table) over numbers (id + 1) of so many bits: table[shift[a] + b] >> bits is a where a and b are a pair, the low bits its rank + 1.

    The first number after the last stands for no token; it has no pairs.
    """
    ranks = read_ranks(path)
    base = max(ranks.values()) + 3
    bits, span = base.bit_length(), 1024
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pair_ranks(ranks).items():
        rows.setdefault(a + 1, []).append((b + 1, rank + 1))
    table, free, shift = np.zeros(base + span, np.int64), np.ones(base + span, bool), np.zeros(base, np.int64)
    end, at, size = 0, 0, 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        cols = [b for b, _ in rows[a]]
        if len(cols) != size:  # rows of one size go on where the one before found room
            at, size = 0, len(cols)
        while True:
            if at + span + base > len(free):
                table, free = np.concatenate([table, np.zeros_like(table)]), np.concatenate([free, np.ones_like(free)])
            fits = free[at + cols[0]: at + cols[0] + span].copy()
            for k, c in enumerate(cols[1:]):
                fits &= free[at + c: at + c + span]
                if k % 8 == 7 and not fits.any():
                    break
            if fits.any():
                break
            at += span
        shift[a] = at + int(fits.argmax())
        free[shift[a] + cols], table[shift[a] + cols] = False, [a << bits | rank for _, rank in rows[a]]
        end = max(end, int(shift[a]))
    return bits, shift.tolist(), table[: end + base].tolist()


def merge_expression(path: str, words: str) -> str:
    """SQL that makes each array of byte ids, counted from 1, in the array words an array of merged ids, counted from 0.

    A token in the fold's state is one number: from the top, the rank of its pair with the next token (over all ranks
    where they are no pair), the place of its first byte, its id. So the least number is the leftmost of the best pairs,
    and all numbers of a state differ. A merge puts new numbers for the first of the pair and the token before it, and takes out the second.
    """
    bits, shift, table = rank_table(path)
    nothing = len(shift) - 1
    low, places, top = (1 << bits) - 1, ((1 << PLACE_BITS) - 1) << bits, bits + PLACE_BITS
    literal = "cast(split('" + ",".join(map(str, shift + table)) + "', ',') as array<bigint>)"

    def look(x: str, y: str) -> str:
        return f"(get(t, cast(get(t, cast({x} as int)) + {y} + {len(shift)} as int)) ^ shiftleft({x}, {bits}))"

    def edge(place: int) -> str:
        return f"{low << bits + top | place << bits | nothing}L"

    one = f"shiftleft({look('cast(b as bigint)', f'coalesce(get(w, i + 1), {nothing})')}, {top}) | shiftleft(cast(i + 1 as bigint), {bits}) | b"
    start = f"array_append(array_prepend(transform(w, (b, i) -> {one}), {edge(0)}), {edge((1 << PLACE_BITS) - 1)})"
    before, second, after = "get(x, p - 2)", "get(x, p)", "get(x, p + 1)"
    left = f"shiftleft({look(f'({before} & {low}L)', 'm')}, {top}) | ({before} & {places | low}L)"
    merged = f"shiftleft({look('m', f'({after} & {low}L)')}, {top}) | (e & {places}L) | m"
    both = f"array_remove(transform(x, v -> if(v = e, {merged}, if(v = {before}, {left}, v))), {second})"
    placed = f"get(transform(array(cast(array_position(x, e) as int)), p -> {both}), 0)"
    step = f"get(transform(array(array_min(x)), e -> if(e >= {1 << bits + top}L, x, get(transform(array(shiftright(e, {top})), m -> {placed}), 0))), 0)"
    ids = f"array_remove(transform(x, e -> cast((e & {low}L) - 1 as int)), {nothing - 1})"
    return f"transform(array({literal}), t -> transform({words}, w -> aggregate(w, {start}, (x, i) -> {step}, x -> {ids})))[0]"


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by a heap of candidate merges over a linked list; for pieces too long for the fold."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(piece[i: end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        alive[j], end[i], after[i] = False, e, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i: end[i]]])
        i = after[i]
    return out


_ROWS = "anew boolean, words array<array<int>>, long_at array<int>, long_ids array<array<int>>, ids array<bigint>, counts array<int>, place binary"


def _split(path: str, long_piece: int, block_bytes: int, row_words: int, scope_words: int):
    """Rows of the pieces that a task has not sent yet (anew: from here numbers start at 0), and of blocks of documents."""
    if not 1 <= long_piece < (1 << PLACE_BITS) - 1:
        raise ValueError(f"long_piece must lie in 1..{(1 << PLACE_BITS) - 2}")
    schema = pa.schema([("anew", pa.bool_()), ("words", pa.list_(pa.list_(pa.int32()))), ("long_at", pa.list_(pa.int32())), ("long_ids", pa.list_(pa.list_(pa.int32()))),
                        ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("place", pa.binary())])

    def run(batches):
        ranks = read_ranks(path)
        lut = np.array([ranks[bytes([i])] + 1 for i in range(256)], dtype=np.int32)

        def row(anew=False, words=(), ids=(), counts=(), place=b""):
            longs = [k for k, w in enumerate(words) if len(w) > long_piece]
            done = [heap_merge(words[k], ranks) for k in longs]
            short = [b"" if len(w) > long_piece else w for w in words]
            starts = np.cumsum([0, *map(len, short)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(lut[np.frombuffer(b"".join(short), np.uint8)])), longs, done, ids, counts]
            one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t.value_type) if not isinstance(a, pa.Array) else a)
            return pa.RecordBatch.from_arrays([pa.array([anew]), *(one(a, f.type) for a, f in zip(lists, list(schema)[1:])), pa.array([place], pa.binary())], schema=schema)

        known: dict[bytes, int] = {}
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for i, j in blocks_of(off, block_bytes):
                anew = len(known) >= scope_words
                if anew:
                    known = {}
                pieces, sent = Pieces(raw[off[i]: off[j]], off[i: j + 1] - off[i]), len(known)
                to = np.array([known.get(w, -1) for w in pieces.distinct], np.int32)
                new = np.flatnonzero(to < 0)
                to[new] = np.arange(sent, sent + len(new))
                fresh = [pieces.distinct[k] for k in new.tolist()]
                known.update(zip(fresh, range(sent, sent + len(new))))
                for k in range(0, max(len(fresh), 1 if anew else 0), row_words):
                    yield row(anew and not k, fresh[k: k + row_words])
                counts = np.diff(np.concatenate([pieces.doc_of_first, [len(pieces.starts)]])[: j - i + 1])
                yield row(ids=ids.slice(i, j - i), counts=counts, place=to[pieces.index].astype("<i4").tobytes())
    return run


class _Answers:
    """Ids of the pieces of a task by their numbers, as rows of pieces bring them."""

    def __init__(self):
        self.values, self.ends, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, words: pa.Array, long_at: list[int], long_ids: list[list[int]]) -> None:
        off = words.offsets.to_numpy()
        flat, sizes = words.flatten().to_numpy(zero_copy_only=False), np.diff(off)
        if long_at:
            sizes[long_at] = [len(x) for x in long_ids]
            flat = np.insert(flat, np.repeat((off[:-1] - off[0])[long_at], sizes[long_at]), np.concatenate(long_ids))
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used: self.used + len(flat)] = flat
        self.ends[self.n + 1: self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of the ids of each place)."""
        starts, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        return self.values[_ranges(starts, sizes)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < (1 << 31) - total) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def decode_bytes(ids: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each id's bytes): the binary pieces of the ids, concatenated."""
    data, off = vocabulary
    sizes = off[ids + 1] - off[ids]
    return data[_ranges(off[ids], sizes)], np.cumsum(sizes)


@functools.cache
def vocabulary_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def _finish(path: str, digests: bool, with_ids: bool = False):
    """Rows of documents from blocks: their ids, digests of ids and decoded bytes, or the ids and the latter digest."""
    def run(batches):
        known = _Answers()
        for batch in batches:
            for r in range(batch.num_rows):
                anew, words, long_at, long_ids, doc_ids, counts, place = (batch.column(k).slice(r, 1) for k in range(7))
                if anew[0].as_py():
                    known = _Answers()
                if len(more := words.flatten()):
                    known.add(more, long_at[0].as_py(), long_ids[0].as_py())
                doc_ids, counts, place = doc_ids.flatten(), counts.flatten().to_numpy(), np.frombuffer(place[0].as_buffer(), "<i4")
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                for i, j in blocks_of(ends, 1 << 18):  # pieces at a time
                    ids, piece_end = known.of(place[ends[i]: ends[j]])
                    doc_end = piece_end[ends[i: j + 1] - ends[i]]
                    listed = None if digests else pa.ListArray.from_arrays(pa.array(doc_end, pa.int32()), pa.array(ids, pa.int32()))
                    if not digests and not with_ids:
                        yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), listed], names=["doc_id", "ids"])
                        continue
                    data, done = decode_bytes(ids, vocabulary_of(path))
                    byte_end = np.concatenate([[0], done])[doc_end].tolist()
                    data = memoryview(data)
                    decoded = pa.array([hashlib.sha256(data[a: b]).hexdigest() for a, b in zip(byte_end, byte_end[1:])])
                    if with_ids:
                        yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), listed, decoded], names=["doc_id", "ids", "decoded_sha256"])
                        continue
                    little, cuts = memoryview(ids.astype("<u4")).cast("B"), doc_end.tolist()
                    yield pa.RecordBatch.from_arrays([
                        doc_ids.slice(i, j - i), pa.array(np.diff(doc_end), pa.int64()),
                        pa.array([hashlib.sha256(little[4 * a: 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                        decoded,
                    ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encoded_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_piece: int = 256, block_bytes: int = 1 << 19,
                   row_words: int = 1024, scope_words: int = 1 << 20) -> DataFrame:
    """Rows of distinct pieces with their ids, and rows of document ids, pieces per document and the piece at each place; in order."""
    split = map_batches(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), _split(path, long_piece, block_bytes, row_words, scope_words), _ROWS)
    return split.selectExpr("anew", f"{merge_expression(path, 'words')} words", "long_at", "long_ids", "ids", "counts", "place")


def encode(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return map_batches(encoded_blocks(docs, path, **options), _finish(path, False), "doc_id bigint, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, ids, decoded_sha256): the ids and a digest of the bytes decoded from them, in the pass that encodes."""
    return map_batches(encoded_blocks(docs, path, **options), _finish(path, False, True), "doc_id bigint, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids give null bytes."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.column(1):
                ids = row.values.to_numpy(zero_copy_only=False).astype(np.int64) if row.is_valid else None
                out.append(None if ids is None else decode_bytes(ids, vocabulary_of(path))[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])
    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, in the pass that encodes."""
    return map_batches(encoded_blocks(docs, path, **options), _finish(path, True), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
