"""SimHash near-duplicates by a generalised pigeonhole search.

A document's fingerprint has a bit set where over half of its word shingles' XXH64 have it. Distinct fingerprints are
searched for pairs within max_bits of each other: correlated bits are grouped into partitions, and partition i gets its
own threshold t_i with sum(t_i + 1) = max_bits + 1, so that every pair within max_bits is within t_i in some partition
(t_i = -1 leaves a partition out). Dynamic programming picks the thresholds, and the number of partitions, by probe rows
and estimated candidates. The plan only decides the cost; every pair found is verified, and none within reach is lost.

A probe bucket of more than max_group rows is dealt out as pairs of hashed blocks. Within a task, verified links become
local components, and only one row (member, smallest member) leaves for each, never all pairs. Exact copies share a
fingerprint and are one node.

Defined cases: null or wordless text has fingerprint 0 and links like any other; fewer words than the shingle length
make one shingle; repeated rows repeat in the result; an empty table stays empty; other columns are not carried; a null
doc_id gets a fingerprint but is not a component's smallest id unless nothing else is in it.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, connected_components, free_name, map_batches, written

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Spreads the 8 bits of a byte over the 8 bytes of a word, so that sums of up to 255 words count bits.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(documents, 64) counts of set bits; document k has hashes[starts[k]:starts[k + 1]]."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = -(-sizes[full] // 255)
    owner = np.repeat(full, pieces)
    inside = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    at = starts[owner] + 255 * inside
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_SPREAD[octets[:, k]], at) for k in range(8)], 1)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(at), 64).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    out[full] = np.add.reduceat(counts, first, axis=0)
    return out


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and the columns to carry."""
    kept = docs.select(F.col("doc_id").cast("bigint"), "text", *carry)
    def run(batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            data = raw.tobytes()
            for i in range(0, batch.num_rows, 200):
                j = min(i + 200, batch.num_rows)
                hashes = [shingle_hashes(data[off[k]: off[k + 1]], shingle) for k in range(i, j)]
                starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
                counts = bit_counts(np.fromiter((x for h in hashes for x in h), np.uint64, starts[-1]), starts)
                fp = ((2 * counts > np.diff(starts)[:, None]) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp.view(np.int64)), *(batch.column(c).slice(i, j - i) for c in carry)], names=["doc_id", "fp", *carry])

    return map_batches(kept, run, ", ".join(["doc_id bigint", "fp bigint", *(f"{c} {kept.schema[c].dataType.simpleString()}" for c in carry)]))


def bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number, 64 x 64 counts of rows with both bits set) over all fingerprints: 4096 sums, whatever the input."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(x), 1 << 15):
                bits = ((x[i: i + (1 << 15), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(4097)
    for k, n in rows:
        sums[k] = n
    return int(sums[-1]), sums[:-1].reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in partitions of nearly equal size, each filled with the bits most correlated to those in it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(group)
    return out


def plan(n: int, both: np.ndarray, max_bits: int, row_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost: row_cost for a probe row, 1 for a candidate pair."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for parts in range(2, 9):
        groups = grouped_bits(n, both, parts)
        costs = []
        for bits in groups:
            dist = np.array([1.0])  # chance of each number of differing bits for two unrelated fingerprints
            for b in bits:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            costs.append([0.0] + [n * row_cost * sum(math.comb(len(bits), i) for i in range(t + 1)) + 0.5 * n * n * dist[: t + 1].sum() for t in range(max_bits + 1)])
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of (t + 1): cost, thresholds
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for take in range(min(len(row) - 1, max_bits + 1 - used) + 1):
                    new = (cost + row[take], ts + [take - 1])
                    if used + take not in step or new[0] < step[used + take][0]:
                        step[used + take] = new
            table = step
        cost, ts = table[max_bits + 1]
        if cost < best[0]:
            best = (cost, list(zip(groups, ts)))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probes(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): own rows hold a fingerprint's bits of a partition, the others all values within its threshold."""
    rows = []
    for k, (bits, t) in enumerate(chosen):
        mask = _signed(sum(1 << b for b in bits))
        flips = [_signed(sum(1 << b for b in c)) for size in range(t + 1) for c in combinations(bits, size)]
        values = "array(" + ",".join(f"{f}L" if f != -(2**63) else "-9223372036854775807L - 1L" for f in flips) + ")"
        rows.append(f"transform({values}, x -> named_struct('part', {k}, 'value', (fp & {_literal(mask)}) ^ x, 'own', x = 0L))")
    return fps.selectExpr("fp", f"explode(concat({', '.join(rows)})) p").select("p.part", "p.value", "p.own", "fp")


def _literal(x: int) -> str:
    return f"{x}L" if x != -(2**63) else "(-9223372036854775807L - 1L)"


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the sets of a[i] and b[i]; a label is the smallest place in its set."""
    a, b = labels[a], labels[b]
    keep = a != b
    a, b = a[keep], b[keep]
    to = np.arange(len(labels))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        keep = a != b
        a, b = a[keep], b[keep]
    return to[labels]


def _links_in(fp: np.ndarray, own: np.ndarray, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the local components of all groups; group g has rows starts[g]:starts[g + 1]."""
    n = len(fp)
    labels, sizes = np.arange(n), np.diff(starts)
    small = np.flatnonzero((sizes > 1) & (sizes <= 256))
    order = small[np.argsort(sizes[small], kind="stable")]
    sz = sizes[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sz)) + 1, [len(sz)]]) if len(sz) else [0, 0]
    for c, d in zip(cuts[:-1], cuts[1:]):
        if c == d:
            continue
        s = int(sz[c])
        i, j = np.triu_indices(s, 1)
        for e in range(c, d, max(1, (1 << 21) // len(i))):
            base = starts[order[e: min(d, e + max(1, (1 << 21) // len(i)))]][:, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            ok = (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits) & (own[a] | own[b])
            labels = merge_labels(labels, a[ok], b[ok]) if ok.any() else labels
    for g in np.flatnonzero(sizes > 256):
        s, e = starts[g], starts[g + 1]
        for r in range(s, e, 64):
            near = np.bitwise_count(fp[r: min(e, r + 64), None] ^ fp[None, s:e]) <= max_bits
            near &= own[r: min(e, r + 64), None] | own[None, s:e]
            a, b = np.nonzero(near)
            labels = merge_labels(labels, a + r, b + s)
    moved = np.flatnonzero(labels != np.arange(n))
    return fp[moved], fp[labels[moved]]


def _verify(max_bits: int):
    def run(batches):
        held = None

        def edges(t: pa.Table):
            key = [t.column(k).to_numpy() for k in range(4)]
            new = np.zeros(len(t), bool)
            new[:1] = True
            for c in key:
                new[1:] |= c[1:] != c[:-1]
            starts = np.append(np.flatnonzero(new), len(t))
            a, b = _links_in(t.column(5).to_numpy().view(np.uint64), t.column(4).to_numpy(zero_copy_only=False), starts, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), int(starts[-2]) if len(starts) > 1 else 0

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if len(held) < 50_000:
                continue
            last = [held.column(k)[-1].as_py() for k in range(4)]
            same = np.ones(len(held), bool)
            for k in range(4):
                same &= held.column(k).to_numpy() == last[k]
            cut = int(np.argmax(same))  # rows are sorted: the last group is the tail
            if cut:
                yield edges(held.slice(0, cut).combine_chunks())[0]
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield edges(held)[0]
    return run


def link_edges(fps: DataFrame, max_bits: int, max_group: int = 2048) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all pairs within max_bits."""
    n, both = bit_pairs(fps)
    rows = probes(fps, plan(n, both, max_bits))
    hot = rows.groupBy("part", "value").count().where(F.col("count") > max_group).selectExpr("part", "value", f"cast(ceil(count / {max_group}) as int) blocks")
    rows = rows.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own_block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", own_block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("part", "value", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "own", "fp")
    parted = rows.repartition("part", "value", "low", "high").sortWithinPartitions("part", "value", "low", "high")
    return parted.mapInArrow(_verify(max_bits), "a bigint, b bigint")


def _labels(each: DataFrame, max_bits: int) -> DataFrame:
    """(fp, rep, root_fp): smallest doc_id and component of every distinct fingerprint."""
    reps = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    edges = link_edges(reps.select("fp"), max_bits)
    roots = connected_components(edges).withColumnRenamed("node", "fp").withColumnRenamed("root", "root_fp")
    return reps.join(roots, "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    labels = _labels(each, max_bits)
    least = labels.groupBy("root_fp").agg(F.min("rep").alias("component_id"))
    by_fp = labels.join(least, "root_fp").select("fp", "component_id")
    return each.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of docs for each component: the smallest doc_id, nulls last, then by digests of the text and of the row."""
    names = [free_name(x, docs) for x in ("digest_of_text", "digest_of_row", "kept_id", "kept_text", "kept_row")]
    marks = {names[0]: F.md5(F.col("text").cast("binary")), names[1]: F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))}
    each = written(fingerprints(docs.withColumns(marks), shingle, tuple(marks)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks)
    first = each.join(_labels(each, max_bits).select("fp", "root_fp"), "fp").groupBy("root_fp").agg(F.min(order).alias("k"))
    kept = written(first.select(*(F.col(f"k.{a}").alias(b) for a, b in zip(("doc_id", *marks), names[2:]))), "survivors")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(names[2]))
    for a, b in zip(marks, names[3:]):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return docs.withColumns(marks).join(kept, same, "left_semi").dropDuplicates(["doc_id", *marks]).drop(*marks)
