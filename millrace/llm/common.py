"""Shared helpers: the shared folder, lineage cuts, run iteration and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back; unlike cut() it stores columns compressed."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores put behind it until no column of the frames has it (case ignored)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of rows that go to a Python worker at once, where the session does not say.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Gives memory that is free inside a Python worker back to the system: workers are kept for later tasks, and idle ones for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) on batches bounded by bytes, not only by rows: texts are held several times over on their way.

    The bound is a setting of the session, and is set where the session has none.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(freed, schema)


def plain_names(df: DataFrame, *keep: str) -> DataFrame:
    """df with names that Arrow functions and grouping can take in place of all but keep; toDF(*df.columns) gives the names back."""
    return df.toDF(*(c if c in keep else f"carried_{k}" for k, c in enumerate(df.columns)))


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most rows rows of df, those with the smallest hashes of key.

    Rows are first cut to about 1.5 times as many by a bound on the hash, so that tasks have few rows each to offer,
    however many tasks there are. key should tell rows apart: rows with one key stay or go together.
    """
    span = 1 << 30
    h = F.pmod(F.xxhash64(*key), F.lit(span))
    total = df.count()
    if total > 2 * rows:
        df = df.where(h < max(1, min(span, -(-span * 3 * max(rows, 200) // (2 * total)))))
    return df.orderBy(h, *key).limit(rows)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def binary_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets) of an Arrow string or binary array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1 + array.offset)[array.offset:]
    size = int(off[-1]) if len(off) else 0
    raw = np.frombuffer(data, dtype=np.uint8, count=size) if data is not None and size else np.zeros(0, np.uint8)
    lengths = np.diff(off)
    if array.null_count:
        valid = array.is_valid().to_numpy(zero_copy_only=False)
        if lengths[~valid].any():
            keep = np.repeat(valid, lengths)
            raw = raw[off[0]:][keep]
            off = np.concatenate([[0], np.cumsum(np.where(valid, lengths, 0))])
    return raw[off[0]: off[-1]], off - off[0]


def blocks_of(offsets: np.ndarray, limit: int):
    """Cuts rows into consecutive blocks of about limit bytes; a single longer row stays whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node in edges(a long, b long), as (node, root).

    Alternates large-star and small-star steps (Kiveris et al., 2014): the number of rounds is logarithmic
    in the longest chain, the edge count never grows, and nothing but a sum of the edges reaches the driver.
    A node's neighbours are only reduced by min(), so a node with millions of links is no hot group.
    Each step is written before the next and reads its edges twice: steps planned together double the plan that
    the driver holds with every step.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def paired(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return e.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))).alias("p")).select("p.a", "p.b")

    def largest(e: DataFrame) -> DataFrame:
        both = paired(e, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        return tidy(both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def smallest(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        return tidy(paired(e.join(low, F.col("a") == F.col("k")), ("a", "m"), ("b", "m")))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = written(tidy(edges), "edges")
    before = state(e)
    for _ in range(max_rounds):
        for step in (largest, smallest):
            e = written(step(e), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
