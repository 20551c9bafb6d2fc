"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual codes, table distances, exact rerank.

Equal vectors are one node with a count. A coarse quantiser of about sqrt(n) cells and one codebook per subspace of the
residuals are fitted on at most train_rows distinct vectors, those with the smallest hashes. Every distinct vector is
indexed in its nearest cell with its code and the length of what the code leaves out; it asks every cell that the radius
can reach: a cell goes only if its centroid is farther than the radius plus the cell's largest member distance, or if the
vector is farther than the radius beyond the plane between the cell's centroid and its own. Neither loses a link.
Distances come from the query's tables of products with the codes. As a code is at most its remainder away from its
vector, a query keeps every vector whose table distance is within the radius plus that remainder, so the filter loses
nothing either. What is kept is judged by the cosine in double precision, each pair once for both of its vectors.

Cells are packed into blocks of bounded size, and larger cells split over several. A vector goes to the blocks that hold
cells it reaches, to one of each two blocks that meet. A task gives counts and one edge per member of its local
components, never the pairs. Data without structure reaches nearly all cells: pairs are then compared by table as the
square of the distinct vectors, and rows dealt grow as its power of 1.5. Defined cases: vectors that are null, zero, of another length
than the commonest, or hold null or non-finite components link with nothing and are their own component; repeated rows
count as vectors; an empty table stays empty; other columns are not carried. A null vec_id keeps its row.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hash_sample, written
from .simhash import merge_labels

TRAIN_ROWS = 16_384
#: Widens bounds against rounding; what passes them is judged exactly.
_SLACK = 1e-5


def _keyed(dims: int):
    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                if values is None or len(values) != dims or values.null_count:
                    keys.append(None)
                    vectors.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype("<f8")
                ok = np.isfinite(x).all() and x.any()
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
                vectors.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vec"])
    return run


def _unit(blobs) -> np.ndarray:
    x = np.array([np.frombuffer(b, "<f8") for b in blobs]) if len(blobs) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[:k].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """Places of the p nearest rows of c for each row of x, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        score = x[i: i + 4096] @ c.T - 0.5 * (c**2).sum(1)
        top = np.argpartition(-score, min(p, len(c)) - 1, axis=1)[:, :p]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, p), np.int64)


class Quantiser:
    """Coarse cells and residual codebooks."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = 8, codes: int = 256):
        self.coarse = kmeans(sample, min(cells, len(sample)))
        rest = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        self.cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], min(codes, len(rest)), 6) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes leave out)."""
        codes = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, (codes, queries) products."""
        return [(book @ x[:, a:b].T).astype(np.float32) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows of x, rows of c) squared distances."""
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (x @ c.T), 0)


class Layout:
    """Which cells a vector reaches, and the blocks that hold each cell."""

    def __init__(self, coarse: np.ndarray, sizes: np.ndarray, far: np.ndarray, radius: float, block: int):
        self.coarse, self.radius = coarse, radius
        self.limit = np.where(sizes > 0, (radius + far + _SLACK) ** 2 + _SLACK, -1.0)  # an empty cell is out of reach
        self.chunks = np.maximum(1, -(-sizes // block))
        self.first = np.zeros(len(sizes), np.int64)
        at, room = -1, 0
        for c, n in enumerate(sizes.tolist()):
            if n > block:
                self.first[c], at, room = at + 1, at + int(self.chunks[c]), 0
            else:
                if n > room or at < 0:
                    at, room = at + 1, block
                self.first[c] = at
                room -= n
        self.blocks = at + 1

    def reached(self, x: np.ndarray, home: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """(rows of x, cells): whether the cell can hold a vector within the radius."""
        c = self.coarse if cells is None else self.coarse[cells]
        d = _distances(x, c)
        own = self.coarse[home]
        beyond = d - ((x - own) ** 2).sum(1)[:, None]
        return (d <= (self.limit if cells is None else self.limit[cells])) & (beyond <= 2 * self.radius * np.sqrt(_distances(own, c)) + _SLACK)

    def asked(self, x: np.ndarray, home: np.ndarray, block: np.ndarray) -> list[list[int]]:
        """The other blocks each vector goes to; of two blocks, one is the other's index, by the parity of their sum."""
        out = []
        for row, b in zip(self.reached(x, home), block.tolist()):
            to = np.zeros(self.blocks + 1, np.int64)  # marks of runs of blocks
            np.add.at(to, self.first[row], 1)
            np.add.at(to, self.first[row] + self.chunks[row], -1)
            to = np.flatnonzero(np.cumsum(to))
            out.append(to[np.where((to + b) % 2 == 0, to > b, to < b)].tolist())
        return out


def _index(shared):
    def run(batches):
        q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _unit([v.as_py() for v in part.column(2)])
                home = nearest(x, q.coarse, 1)[:, 0]
                rest = x - q.coarse[home]
                codes, left = q.encode(rest)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(home, pa.int32()), pa.array(np.linalg.norm(rest, axis=1)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)],
                                                 names=["rep", "n", "vec", "cell", "far", "code", "rest"])
    return run


def _ask(shared):
    def run(batches):
        layout = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, home = _unit([v.as_py() for v in part.column(2)]), part.column(3).to_numpy()
                block = layout.first[home] + np.array([zlib.crc32(v.as_py()) for v in part.column(2)], np.int64) % layout.chunks[home]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block, pa.int32()), pa.array(layout.asked(x, home, block), pa.list_(pa.int32()))], names=[*part.schema.names, "home", "asked"])
    return run


class _Block:
    """The index rows of a block; links() compares queries with them."""

    def __init__(self, q: Quantiser, layout: Layout, threshold: float, t: pa.Table, chunk: int):
        t = t.sort_by("cell")
        self.q, self.layout, self.threshold, self.chunk = q, layout, threshold, chunk
        self.rep, self.n, cell = (t.column(c).to_numpy() for c in ("rep", "n", "cell"))
        self.x = _unit(t.column("vec").to_pylist())
        self.cell = cell
        self.codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1)
        parts = q.decode(self.codes)
        # Squared distance of a query u to a code: |u - centroid|^2 - 2 u.code + (2 centroid.code + |code|^2).
        self.fixed = (2 * (q.coarse[cell] * parts).sum(1) + (parts**2).sum(1)).astype(np.float32)
        self.reach = ((layout.radius + t.column("rest").to_numpy() + _SLACK) ** 2 + _SLACK).astype(np.float32)
        self.starts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        self.cells = cell[self.starts[:-1]]
        self.counts, self.labels = np.zeros(len(t), np.int64), np.arange(len(t))

    def links(self, x: np.ndarray, rep: np.ndarray, n: np.ndarray, cell: np.ndarray, place: np.ndarray | None = None):
        """(count, label) of each query; place: the queries are rows of the block, and only later rows are theirs."""
        size = len(self.rep)
        counts, labels = np.zeros(len(x), np.int64), np.concatenate([self.labels, np.arange(size, size + len(x))])
        node = np.arange(size, size + len(x)) if place is None else place
        for s in range(0, len(x), self.chunk):
            mine = slice(s, min(s + self.chunk, len(x)))
            tables = self.q.tables(x[mine])
            near = self.layout.reached(x[mine], cell[mine], self.cells)
            base = _distances(x[mine], self.q.coarse[self.cells]).astype(np.float32)
            for k, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:])):
                at = np.flatnonzero(near[:, k])
                if place is not None:
                    at = at[place[mine][at] < hi - 1]
                if not len(at):
                    continue
                every = 2 * len(at) > near.shape[0]
                at = np.arange(near.shape[0]) if every else at
                for i in range(lo, hi, 512):
                    j = min(i + 512, hi)
                    inner = np.zeros((j - i, len(at)), np.float32)
                    for m, table in enumerate(tables):
                        inner += (table if every else table[:, at])[self.codes[i:j, m]]
                    found = base[at, k] - 2 * inner <= (self.reach - self.fixed)[i:j, None]
                    if not found.any():
                        continue
                    u = at + s
                    if np.count_nonzero(found) * 16 > found.size:  # dense: all cosines at once
                        found &= self.x[i:j] @ x[u].T >= self.threshold
                        b, a = np.nonzero(found)
                        a, b = u[a], b + i
                    else:
                        b, a = np.nonzero(found)
                        a, b = u[a], b + i
                        ok = np.einsum("ij,ij->i", x[a], self.x[b]) >= self.threshold
                        a, b = a[ok], b[ok]
                    ok = rep[a] != self.rep[b]
                    if place is not None:
                        ok &= place[a] < b
                    a, b = a[ok], b[ok]
                    if len(a):
                        counts += np.bincount(a, self.n[b], len(x)).astype(np.int64)
                        self.counts += np.bincount(b, n[a], size).astype(np.int64)
                        labels = merge_labels(labels, node[a], b)
        self.labels = labels[:size]
        return counts, labels[size:]


def _found(rep, counts, labels, nodes, places) -> pa.RecordBatch:
    hit, moved = np.flatnonzero(counts), np.flatnonzero(labels != places)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([rep[hit], rep[moved]])), pa.array(np.concatenate([rep[hit], nodes[labels[moved]]])), pa.array(np.concatenate([counts[hit], np.zeros(len(moved), np.int64)])),
    ], names=["a", "b", "n"])


def _search(quantiser, layout, threshold: float, chunk: int):
    """Rows come by block, its index rows first; only these are held."""
    def run(batches):
        q, lay = quantiser.value, layout.value
        key, rows, block = None, [], None

        def opened() -> _Block | None:
            if not rows:  # a share of a split cell may be empty
                return None
            b = _Block(q, lay, threshold, pa.Table.from_batches(rows).combine_chunks(), chunk)
            rows.clear()
            got, _ = b.links(b.x, b.rep, b.n, b.cell, np.arange(len(b.rep)))
            b.counts += got
            return b

        def closed(b: _Block) -> pa.RecordBatch:
            if b is None:
                return _found(*[np.zeros(0, np.int64)] * 5)
            return _found(b.rep, b.counts, b.labels, b.rep, np.arange(len(b.rep)))

        for batch in batches:
            block_of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero((block_of[1:] != block_of[:-1]) | (asks[1:] != asks[:-1])) + 1, batch.num_rows)
            i = 0
            for j in ends.tolist():
                part, now = batch.slice(i, j - i), int(block_of[i])
                if key is not None and now != key:
                    yield closed(block or opened())
                    block = None
                key = now
                if not asks[i]:
                    rows.append(part)
                elif (block := block or opened()) is not None:
                    t = pa.Table.from_batches([part])
                    rep = t.column("rep").to_numpy()
                    counts, labels = block.links(_unit(t.column("vec").to_pylist()), rep, t.column("n").to_numpy(), t.column("cell").to_numpy())
                    yield _found(rep, counts, labels, np.concatenate([block.rep, rep]), np.arange(len(block.rep), len(block.rep) + len(rep)))
                i = j
        if key is not None:
            yield closed(block or opened())
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, train_rows: int = TRAIN_ROWS, max_cells: int = 4096, chunk: int = 1024, block: int = 4096, block_roots: int = 24) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    dims = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    keyed = written(vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(_keyed(dims[0] if dims else 0), "vec_id bigint, key binary, vec binary"), "vectors")
    reps = written(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")).where("rep is not null"), "distinct-vectors")
    total = reps.count()
    if total < 2:
        found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    else:
        sample = _unit([bytes(r[0]) for r in hash_sample(reps, train_rows, "key").select("vec").collect()])
        quantiser = Quantiser(sample, min(max_cells, max(1, math.isqrt(total))))
        shared = spark.sparkContext.broadcast(quantiser)
        indexed = written(reps.select("rep", "n", "vec").mapInArrow(_index(shared), "rep bigint, n bigint, vec binary, cell int, far double, code binary, rest double"), "inverted-lists")
        sizes, far = np.zeros(len(quantiser.coarse), np.int64), np.zeros(len(quantiser.coarse))
        for c, n, f in indexed.groupBy("cell").agg(F.count("*"), F.max("far")).collect():  # one row per cell, max_cells at most
            sizes[c], far[c] = n, f
        layout = Layout(quantiser.coarse, sizes, far, math.sqrt(max(0.0, 2 - 2 * threshold)), min(max(block, 1 << 16), max(block, block_roots * math.isqrt(total))))
        placed = spark.sparkContext.broadcast(layout)
        dealt = indexed.select("rep", "n", "vec", "cell", "code", "rest").mapInArrow(_ask(placed), "rep bigint, n bigint, vec binary, cell int, code binary, rest double, home int, asked array<int>")
        dealt = dealt.select(F.explode(F.expr("concat(array(named_struct('block', home, 'asks', false)), transform(asked, b -> named_struct('block', b, 'asks', true)))")).alias("to"), "rep", "n", "vec", "cell", "code", "rest")
        dealt = dealt.select("to.block", "to.asks", "rep", "n", "vec", "cell", *(F.when(~F.col("to.asks"), F.col(c)).alias(c) for c in ("code", "rest")))
        dealt = dealt.repartition(4 * layout.blocks, "block").sortWithinPartitions("block", "asks")
        found = written(dealt.mapInArrow(_search(shared, placed, threshold, chunk), "a bigint, b bigint, n bigint"), "links")
    roots = connected_components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("other"))
    per_key = reps.select("key", "rep", "n").join(links, "rep", "left").join(roots, "rep", "left").select("key", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = keyed.select("vec_id", "key").join(per_key, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
