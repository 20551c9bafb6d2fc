"""Resolution of free text against vocabularies and entities by joins on folded keys.

Key tables are joined without a hint: Spark broadcasts one that its statistics show to be small and shuffles a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T


def lookup(df: DataFrame, column: str, keys: DataFrame, to: str = "resolved") -> DataFrame:
    """Canonical name of a cell, else the trimmed cell."""
    k = keys.select(F.col("key").alias("_k"), F.col("canonical").alias("_c"))
    return df.join(k, T.fold(F.col(column)) == F.col("_k"), "left").withColumn(to, F.coalesce("_c", F.trim(column))).drop("_k", "_c")


def lookup_values(df: DataFrame, key: str, column: str, keys: DataFrame) -> DataFrame:
    """(key, terms, codes) of a multi-valued cell: canonical names and their codes by position, joined by '; '."""
    parts = df.select(key, F.posexplode_outer(T.split_values(F.col(column))).alias("pos", "part"))
    j = parts.join(keys.withColumnRenamed("key", "_k"), T.fold(F.col("part")) == F.col("_k"), "left")
    one = F.struct("pos", F.coalesce(F.lower("canonical"), F.lower("part")).alias("t"), F.coalesce("code", F.lit("unknown")).alias("c"))
    rows = j.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), one))).alias("a"))
    packed = lambda f: F.when(F.size("a") == 0, "unknown").otherwise(F.array_join(F.transform("a", lambda x: x[f]), "; "))
    return rows.select(key, packed("t").alias("terms"), packed("c").alias("codes"))


def clean_cell_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\bcells?\b", ""), r"""[.,\-_;:()\[\]'"]""", " "), r"\s+", " "))


def cascade(df: DataFrame, key: str, column: str, keys: DataFrame) -> DataFrame:
    """(key, canonical) by the first of: folded text, its letters and digits only, its cleaned text."""
    tries = df.select(key, F.posexplode(F.array(T.fold(F.col(column)), T.compact(F.col(column)), clean_cell_name(F.col(column)))).alias("pos", "k"))
    hits = tries.join(keys.select(F.col("key").alias("k"), "canonical"), "k")
    return hits.groupBy(key).agg(F.min_by("canonical", "pos").alias("canonical"))


def second_pass(df: DataFrame, key: str, column: str, keys: DataFrame) -> DataFrame:
    """(key, canonical) of the first token with a capital and a digit that is known, as written or letters and digits only."""
    tokens = F.filter(F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z0-9][A-Za-z0-9._/'-]*[A-Za-z0-9]"), 0), lambda t: t.rlike("[A-Z]") & t.rlike("[0-9]"))
    tries = df.select(key, F.posexplode(F.flatten(F.transform(tokens, lambda t: F.array(F.lower(t), T.compact(t))))).alias("pos", "k"))
    return tries.join(keys.select(F.col("key").alias("k"), "canonical"), "k").groupBy(key).agg(F.min_by("canonical", "pos").alias("canonical"))


def propagate(df: DataFrame, on: str, entity: DataFrame, fields: list[str], overwrite: bool = False, source: str = "entity") -> DataFrame:
    """Fields from the entity of a row: only where missing, or over what is there; <field>_source tells."""
    e = entity.select(F.col("name").alias("_n"), *[T.missing_to_null(F.col(f)).alias(f"_e_{f}") for f in fields])
    j = df.join(e, F.col(on) == F.col("_n"), "left")
    cols = {}
    for f in fields:
        own, ent = T.missing_to_null(F.col(f)), F.col(f"_e_{f}")
        first, second = (ent, own) if overwrite else (own, ent)
        cols[f] = F.coalesce(first, second)
        taken = ent.isNotNull() & (F.lit(True) if overwrite else own.isNull())
        cols[f"{f}_source"] = F.when(taken, source).otherwise(F.col(f"{f}_source") if f"{f}_source" in df.columns else F.when(own.isNotNull(), "own"))
    return j.withColumns(cols).drop("_n", *[f"_e_{f}" for f in fields])


def bag_lookup(bag: Column, aliases: list[str]) -> Column:
    """First value of a map by aliases in their order, keys compared without case and separators."""
    norm = F.map_from_entries(F.aggregate(F.map_entries(bag), F.array().cast("array<struct<key:string,value:string>>"), lambda a, e: F.when(F.exists(a, lambda x: x["key"] == T.compact(e["key"])), a).otherwise(F.concat(a, F.array(F.struct(T.compact(e["key"]).alias("key"), e["value"].alias("value")))))))
    return F.coalesce(*[F.try_element_at(norm, F.lit("".join(ch for ch in a.lower() if ch.isalnum()))) for a in aliases])


def dictionary_matches(df: DataFrame, key: str, column: str, terms: DataFrame) -> DataFrame:
    """(key, candidates): distinct terms(term) met in the text as runs of words, however long, in order of first place.

    A place of the text is one row that meets the terms with its first word and is then compared with the whole term.
    """
    known = terms.select(F.concat(T.plain(F.col("term")), F.lit(" ")).alias("run"), "term").where("run <> ' '").groupBy("run").agg(F.min("term").alias("term"))
    known = known.select(F.substring_index("run", " ", 1).alias("first"), "run", "term")
    longest = known.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 2
    words = df.select(key, F.split(T.plain(F.col(column)), " ").alias("w"))
    places = words.select(key, F.posexplode(F.expr(f"transform(w, (x, i) -> named_struct('first', x, 'here', concat(array_join(slice(w, i + 1, {longest - 1}), ' '), ' ')))")).alias("pos", "p"))
    hits = places.select(key, "pos", "p.first", "p.here").join(known, "first").where(F.col("here").startswith(F.col("run"))).groupBy(key, "term").agg(F.min("pos").alias("pos"))
    return hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("candidates"))


def best_candidate(df: DataFrame, key: str, text: str = "text", candidates: str = "candidates") -> DataFrame:
    """(key, chosen): the candidate met most often, the first on a tie (also where none is met)."""
    c = df.select(key, text, F.posexplode(candidates).alias("pos", "c"))
    n = c.select(key, "c", "pos", F.regexp_count(text, T.candidate_pattern(F.col("c"))).alias("n"))
    return n.groupBy(key).agg(F.max_by("c", F.struct("n", -F.col("pos"))).alias("chosen"))


def trim_cell_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\b(cells?|lines?|cultures?)\b", ""), r"[\s,;:.-]+$", ""))


def incomplete_phrase(c: Column) -> Column:
    return F.lower(c).rlike(r"(with|and|of|for|,|-)\s*$")


def keep_last(df: DataFrame, key: list[str] | str, order: str) -> DataFrame:
    """Last row per key; the whole row breaks ties."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c != order]
    w = W.partitionBy(*keys).orderBy(F.desc(order), *rest)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def side_lookup(df: DataFrame, key: str, side: DataFrame, order: str, to: str) -> DataFrame:
    """Left join to the last row of side per key, its other columns joined by ';' into one (default empty)."""
    last = keep_last(side, key, order)
    rest = [c for c in side.columns if c not in (key, order)]
    packed = last.select(F.col(key).alias("_k"), F.concat_ws(";", *rest).alias(to))
    return df.join(packed, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(to, F.coalesce(to, F.lit("")))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has, and 'twice' for keys repeated in a."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    twice = a.groupBy(key).count().where("count > 1").select(key, F.lit("twice").alias("side"))
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right"))).union(twice)


def interleave(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """(position, side, key): the two lists in turn, in each one's own order.

    Positions come from ranks within sorted ranges (see numbered()), not from one task.
    """
    from millrace.operators.sample import numbered

    one = numbered(a.select(key, order), [order, key]).select("rn", F.lit(0).alias("side"), key)
    two = numbered(b.select(key, order), [order, key]).select("rn", F.lit(1).alias("side"), key)
    return one.union(two)
