"""Provenance merge and cross-field rules.

A field's evidence comes in layers (database, model, entity); the first layer with a value wins and is named beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def merge_layers(df: DataFrame, fields: list[str], layers: list[str], policy: str = "normalisation") -> DataFrame:
    """For each field, columns <layer>_<field> become <field> and <field>_source; nothing known is NULL in both."""
    out = [c for c in df.columns if not any(c == f"{la}_{f}" for la in layers for f in fields)]
    cols = [F.col(c) for c in out]
    for f in fields:
        known = [(la, T.missing_to_null(F.col(f"{la}_{f}"), policy)) for la in layers if f"{la}_{f}" in df.columns]
        source = F.coalesce(*[F.when(v.isNotNull(), F.lit(la)) for la, v in known])
        cols += [F.coalesce(*[v for _, v in known]).alias(f), source.alias(f"{f}_source")]
    return df.select(*cols)


def render(df: DataFrame, fields: list[str], sentinel: str = "unknown") -> DataFrame:
    """Missing values of fields as a sentinel, at the edge of the engine."""
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(sentinel)) for f in fields})


def render_sentinels(df: DataFrame, fields: list[str], keep_na: list[str]) -> DataFrame:
    """"None" to unknown everywhere, "not applicable" to unknown but in keep_na."""
    return df.withColumns({f: F.when(F.col(f).isin(*(["None"] if f in keep_na else ["None", "not applicable"])), "unknown").otherwise(F.col(f)) for f in fields})


def dependent_reset(df: DataFrame, master: str, dependents: list[str]) -> DataFrame:
    """Dependents of an unknown master are not applicable."""
    return df.withColumns({d: F.when(F.lower(F.trim(master)) == "unknown", "not applicable").otherwise(F.col(d)) for d in dependents})


def consistent_codes(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """A code without its term is unknown."""
    return df.withColumns({code: F.when(T.is_missing(F.col(term)), "unknown").otherwise(F.coalesce(F.col(code), F.lit("unknown"))) for code, term in pairs.items()})


def restore_database(df: DataFrame, fields: list[str], prefix: str = "db_") -> DataFrame:
    """The database's value wins at the end where it has one."""
    cols = {}
    for f in fields:
        known = ~T.is_missing(F.col(prefix + f))
        cols |= {f: F.when(known, F.trim(prefix + f)).otherwise(F.col(f)), f"{f}_source": F.when(known, "db").otherwise(F.col(f"{f}_source"))}
    return df.withColumns(cols)


def mask_confidence(df: DataFrame, metrics: dict[str, str], layer: str = "llm") -> DataFrame:
    """A metric stands only where its field came from the model."""
    return df.withColumns({m: F.when(F.col(f"{f}_source") == layer, T.metric_or_na(F.col(m))).otherwise("not applicable") for m, f in metrics.items()})


def check_ages(df: DataFrame, age: str = "age", source: str = "age_source", text: str = "summary") -> DataFrame:
    """An age from the model that its text does not state becomes unknown."""
    doubtful = (F.col(source) == "llm") & ~T.is_missing(F.col(age)) & ~T.age_confirmed(F.col(age), F.col(text))
    return df.withColumn(age, F.when(doubtful, "unknown").otherwise(F.col(age)))


def gate(df: DataFrame, allowed: dict[str, list[str]], default: str = "") -> DataFrame:
    return df.withColumns({f: F.when(F.col(f).isin(*vs), F.col(f)).otherwise(default) for f, vs in allowed.items()})


def ambiguous_rows(df: DataFrame, key: str, name: str, candidates: str, official: DataFrame) -> DataFrame:
    """(key, candidates) of rows with phrase candidates, or with a name that is not official; official(name) is deduplicated and folded."""
    names = official.select(T.fold(F.col("name")).alias("_official")).distinct()
    j = df.join(names, T.fold(F.col(name)) == F.col("_official"), "left")
    several = F.size(candidates) > 0
    return j.where(several | F.col("_official").isNull()).select(key, F.when(several, F.array_join(candidates, ";")).otherwise(F.coalesce(F.col(name), F.lit(""))).alias("candidates"))


def failed_rows(df: DataFrame, columns: list[str], error: str = "error") -> DataFrame:
    """Rows to be tried again: any of columns is the error mark or missing."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.col(c) == error)
    return df.where(bad)


def retry(fetch, keys: DataFrame, columns: list[str], passes: int = 3) -> DataFrame:
    """Calls fetch(keys) and again for what failed, at most passes times; the last answer of a key stands."""
    done = fetch(keys)
    for _ in range(passes - 1):
        again = failed_rows(done, columns)
        if again.isEmpty():
            break
        done = done.join(again.select(keys.columns[0]), keys.columns[0], "left_anti").unionByName(fetch(again.select(*keys.columns)))
    return done


def inject_unknown(df: DataFrame, key: str, rates: dict[str, float], seed: int = 42) -> DataFrame:
    """Sets a field unknown in a given share of rows, chosen by a hash of seed, field and key."""
    def share(f):
        return F.pmod(F.xxhash64(F.lit(f"{seed}:{f}"), F.col(key)), F.lit(1_000_000)) / 1_000_000
    return df.withColumns({f: F.when(share(f) < r, "unknown").otherwise(F.col(f)) for f, r in rates.items()})


_TIME = r"[0-9]+ *(?:hours?|hrs?|h|days?|d)\b"


def split_treatment(c: Column) -> tuple[Column, Column]:
    """(treatment without durations and small words, its durations joined by '; ')."""
    t = F.lower(c)
    return (F.trim(F.regexp_replace(F.regexp_replace(t, _TIME + r"|\b(?:for|to|and|in|with|via|on|of|the)\b", ""), r"\s+", " ")), F.array_join(F.regexp_extract_all(t, F.lit(_TIME), 0), "; "))
