"""Queries of the ten operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words in a host that label a training URL as blocked where no rule does; other URLs are labelled allowed.
BLOCK_WORDS = ("casino", "pills", "bets", "adult", "spam", "ads-")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import spans

    return spans(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordcount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter as U

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host = U.host_of(F.col("url"))
    _, said = U.rule_columns(host, U.path_of(F.col("url")), URL_RULES)
    word = F.lit(False)
    for w in BLOCK_WORDS:
        word = word | host.contains(w)
    labelled = pages.select("url", (F.coalesce(said, F.when(word, "block").otherwise("allow")) == "block").cast("int").alias("block"))
    model, rates = U.fit(labelled)
    return U.judge(pages, URL_RULES, model, rates)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import hits

    return hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid as L

    docs = _table(spark, sf_dir, "documents")
    model = L.fit(docs.where(~L.held_out()))
    return L.predict(docs.select("doc_id", "text"), model, spans="spans").select("doc_id", L.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op9_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .planes import write_and_read

    return write_and_read(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .slots import shard

    rows = shard(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_pq, op2_suffix_dedup, op3_token_counts, op4_simhash_gph, op5_url_filter, op6_byte_bpe, op7_decontamination, op8_language_crf, op9_byte_planes, op10_virtual_slots)}


_OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_pq": _OP1_SQL}
