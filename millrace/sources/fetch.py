"""Fetch seam: keys to bodies through a caller's getter, with retries; the engine itself opens no connection."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def with_retry(get: Callable[[str], str], key: str, valid: Callable[[str], bool] = bool, tries: int = 4, wait: float = 0.5, cap: float = 30.0, sleep=time.sleep) -> str:
    """get(key), again while it raises or its body is not valid, with doubled and jittered waits; 'error' at last."""
    rng = random.Random(key)
    for i in range(tries):
        try:
            body = get(key)
            if valid(body):
                return body
        except Exception:
            if i + 1 == tries:
                break
        if i + 1 < tries:
            sleep(min(cap, wait * 2**i) * (0.5 + rng.random()))
    return "error"


def well_formed(body: str) -> bool:
    """Whether a body parses as XML."""
    import xml.etree.ElementTree as E

    try:
        E.fromstring(body)
        return True
    except E.ParseError:
        return False


def fetch(keys: DataFrame, get: Callable[[str], str], key: str = "run_accession", valid: Callable[[str], bool] = bool, **retry) -> DataFrame:
    """(key, body) of every key; a failed key's body is 'error', for curate.failed_rows() and curate.retry()."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "body": [with_retry(get, k, valid, **retry) for k in pdf[key]]})
    return keys.select(key).mapInPandas(run, f"{key} string, body string")
