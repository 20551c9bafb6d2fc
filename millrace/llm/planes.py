"""Token ids in binary files: fixed-size id blocks as byte planes, each plane compressed with zstandard, with a chunk index.

A file is one row of a Parquet container, so Spark's committer writes it whole or not at all, into any store. Its
payload is

    magic "MRBP" | u32 version | u32 number of chunks | u32 length of the index | chunk index | planes

and the chunk index (zstandard) holds, for each chunk, ids (u32), documents begun in it (u32), and offset and length of
each plane. Chunks of chunk_ids ids are transposed to plane_bytes(width) planes: all lowest bytes, then all second
bytes, and so on (width 2 where the vocabulary allows it, else 4). Documents are kept as two further arrays in the same
form: their ids (i64) and lengths (u32), since the end id may also occur inside a text.

Rows go to files by ranges of doc_id cut at quantiles of all doc_ids, so the files in order hold ascending doc_ids.
A range that is longer than file_ids is continued in further files by the task that sorts it, batch by batch.
Defined cases: null text is an empty document (only the end id); rows with equal doc_id are ordered by the crc32 of
their ids and then their length; a null doc_id comes first; an empty table gives no file.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary_parts, blocks_of, fresh_path, map_batches
from .wordsplit import Pieces

MAGIC = b"MRBP"
_HEAD = struct.Struct("<4sIII")
_CACHE = 1 << 18
#: Files whose starts are broadcast, 24 bytes each; of more, they are joined by a shuffle.
MOST_SENT = 1 << 20


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _known_pieces(path: str) -> dict[bytes, list[int]]:
    return {}


def encode_texts(raw: np.ndarray, off: np.ndarray, path: str, specials: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) as the tokenizers library gives them.

    Its pre-tokenizer cuts texts into the pieces of Pieces(), and no id spans two pieces, so each distinct piece is
    encoded once. Documents that hold the string of a special token are encoded whole.
    """
    tok, cache = _tokenizer(path), _known_pieces(path)
    pieces = Pieces(raw, off)
    new = [w for w in pieces.distinct if w not in cache]
    fresh = {}
    if new:
        for w, e in zip(new, tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            fresh[w] = e.ids
    each = [fresh[w] if w in fresh else cache[w] for w in pieces.distinct]
    room = _CACHE - len(cache)
    if room > 0:
        cache.update(list(fresh.items())[:room])
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter(chain.from_iterable(each), np.uint32, int(begin[-1]))
    n = sizes[pieces.index]
    ends = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(begin[pieces.index] - ends[:-1], n) + np.arange(ends[-1])] if len(n) else np.zeros(0, np.uint32)
    cuts = ends[np.concatenate([pieces.doc_of_first[: len(off) - 1], [len(pieces.starts)]])]
    data = raw.tobytes() if specials else b""
    if any(s in data for s in specials):
        parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in range(len(parts)):
            text = data[off[k]: off[k + 1]]
            if any(s in text for s in specials):
                parts[k] = np.array(tok.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids = np.concatenate(parts)
    return ids, np.diff(cuts)


def one_to_a_task(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions, a number that hash partitioning deals to it: ranges dealt by their own numbers would share tasks."""
    number = F.col("id").cast("int")
    rows = spark.range(32 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("k")).agg(F.min(number).alias("v")).collect()
    known = {r.k: r.v for r in rows}
    return np.array([known.get(k, k) for k in range(n)], np.int32)


def _encode(path: str, end_id: int, bounds: np.ndarray, width: int, dealt: np.ndarray):
    def run(batches):
        tok = _tokenizer(path)
        specials = tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values())
        pack = zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if width == 2 else np.uint32
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            for i, j in blocks_of(off, 4 << 20):
                ids, sizes = encode_texts(raw[off[i]: off[j]], off[i: j + 1] - off[i], path, specials)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                keys = batch.column(0).slice(i, j - i)
                at = np.searchsorted(bounds, keys.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
                blobs, crcs = [], []
                for a, b in zip(cuts, cuts[1:]):
                    part = np.append(ids[a:b], np.uint32(end_id))
                    crcs.append(zlib.crc32(part.astype("<u4").tobytes()))
                    blobs.append(part.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at), keys, pa.array(crcs, pa.int64()), pa.array(sizes + 1, pa.int64()), pa.array([pack.compress(b) for b in blobs], pa.binary()), pa.array(dealt[at])],
                                                 names=["range", "doc_id", "crc", "n_tokens", "blob", "dealt"])
    return run


def to_planes(a: np.ndarray) -> list[bytes]:
    """Byte planes of an integer array: plane k holds byte k of every element."""
    return [np.ascontiguousarray(p).tobytes() for p in a.view(np.uint8).reshape(len(a), a.itemsize).T]


def from_planes(planes: list[bytes], dtype) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view(dtype).ravel()


def pack_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, chunk_ids: int, level: int = 3) -> bytes:
    """Payload of one file."""
    zip_ = zstandard.ZstdCompressor(level=level)
    chunks = [ids[i: i + chunk_ids] for i in range(0, len(ids), chunk_ids)] + [doc_ids.astype("<i8"), lengths.astype("<u4")]
    begun = np.diff(np.concatenate([np.searchsorted(np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.arange(0, len(ids), chunk_ids)), [len(lengths)]])) if len(ids) else []
    body, index = [], []
    at = 0
    for k, c in enumerate(chunks):
        planes = [zip_.compress(p) for p in to_planes(c)] if len(c) else []
        index.append(struct.pack("<III", len(c), int(begun[k]) if k < len(begun) else len(doc_ids), len(planes)))
        for p in planes:
            index.append(struct.pack("<QI", at, len(p)))
            at += len(p)
        body += planes
    packed = zip_.compress(b"".join(index))
    return _HEAD.pack(MAGIC, 1, len(chunks), len(packed)) + packed + b"".join(body)


def unpack_file(payload: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, lengths) of a payload, found through its chunk index."""
    unzip = zstandard.ZstdDecompressor()
    magic, version, n, size = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a file of byte planes")
    index, base, at, out = unzip.decompress(payload[_HEAD.size: _HEAD.size + size]), _HEAD.size + size, 0, []
    kinds = ["<u2" if width == 2 else "<u4"] * (n - 2) + ["<i8", "<u4"]
    for kind in kinds:
        count, _, planes = struct.unpack_from("<III", index, at)
        at += 12
        parts = []
        for _ in range(planes):
            p, length = struct.unpack_from("<QI", index, at)
            at += 12
            parts.append(unzip.decompress(payload[base + p: base + p + length]))
        out.append(from_planes(parts, kind) if count else np.zeros(0, kind))
    ids = np.concatenate(out[:-2]) if n > 2 else np.zeros(0, kinds[0])
    return ids, out[-2], out[-1]


_FILES = "range int, part int, n_docs bigint, n_ids bigint, payload binary"


def _write(chunk_ids: int, file_ids: int, width: int):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        now, part, blobs, keys, sizes, total = None, 0, [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(blobs), "<u2" if width == 2 else "<u4")
            payload = pack_file(ids, np.array(keys, np.int64), np.array(sizes, np.int64), chunk_ids)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                                              names=["range", "part", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for at, key, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if keys and (at != now or total >= file_ids):
                    yield flush()
                    part = part + 1 if at == now else 0
                    blobs, keys, sizes, total = [], [], [], 0
                now = at
                blobs.append(unzip.decompress(blob.as_py()))
                keys.append(key if key is not None else -(2**63))
                sizes.append(n)
                total += n
        if keys:
            yield flush()
    return run


def width_of(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 where every id of the vocabulary fits, else 4."""
    return 2 if max([end_id, *_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values()]) < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, width: int | None = None, chunk_ids: int = 1 << 16, file_ids: int = 4 << 20, ranges: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes the files to path, in ascending order of doc_id."""
    spark = docs.sparkSession
    width = width or width_of(tokenizer, end_id)
    if ranges is None:
        ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    cuts = docs.selectExpr("cast(doc_id as bigint) doc_id").agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))
    ids = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _encode(tokenizer, end_id, bounds, width, one_to_a_task(spark, ranges)), "range int, doc_id bigint, crc bigint, n_tokens bigint, blob binary, dealt int")
    ordered = ids.repartition(ranges, "dealt").sortWithinPartitions("range", "doc_id", "crc", "n_tokens").select("range", "doc_id", "n_tokens", "blob")
    ordered.mapInArrow(_write(chunk_ids, file_ids, width), _FILES).write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(path)


def read(spark: SparkSession, path: str, width: int) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(_FILES).parquet(path)
    index = files.select("range", "part", "n_ids").withColumn("before", F.sum("n_ids").over(W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)))
    starts = index.select("range", "part", F.coalesce("before", F.lit(0)).cast("bigint").alias("before"))  # a row of numbers for each file
    if files.count() <= MOST_SENT:
        starts = F.broadcast(starts)  # payloads stay where they are

    def run(batches):
        for batch in batches:
            for payload, before in zip(batch.column(0), batch.column(1).to_pylist()):
                ids, keys, sizes = unpack_file(payload.as_py(), width)
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                little, cuts = memoryview(ids.astype("<u4")).cast("B"), ends.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.astype(np.int64), mask=keys == -(2**63)), pa.array(ends[:-1] + before), pa.array(sizes.astype(np.int64)),
                    pa.array([zlib.crc32(little[4 * a: 4 * b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(files.join(starts, ["range", "part"]).select("payload", "before"), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Files in the shared folder, and the rows read back from them."""
    path = fresh_path(docs.sparkSession, "planes")
    options["width"] = options.get("width") or width_of(tokenizer, options.get("end_id", 2))
    write(docs, tokenizer, path, **options)
    return read(docs.sparkSession, path, options["width"])
