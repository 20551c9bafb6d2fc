"""Context texts within a budget of words; a real tokenizer takes the place of the word count by a pandas UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

# fixed values: small words that go first when a context is too long
SMALL_WORDS = frozenset("a an and are as at be by for from has in is it of on or that the this to was were will with".split())


def cut_words(c: Column, limit: int) -> Column:
    return F.array_join(F.slice(F.split(T.sanitise(c), " "), 1, limit), " ")


def append_note(long_form: Column, short_form: Column, note: Column, limit: int) -> Column:
    """long_form and the note if they fit, else short_form and the note."""
    whole = F.concat_ws(" ", long_form, note)
    return F.when(F.size(F.split(whole, " ")) <= limit, whole).otherwise(F.concat_ws(" ", short_form, note))


def trim_text(text: str, limit: int, count) -> str:
    """Drops accessions, then frequent and small words, then last sentences, until count(text) is within limit."""
    if count(text) <= limit:
        return text
    words = [w for w in text.split() if not re.match(r"^\W*([SDE]RR|[SDE]RP\d|PRJ[A-Z]{2}\d)", w.upper())]
    if count(" ".join(words)) <= limit:
        return " ".join(words)
    if len(words) > 50:
        seen: dict[str, int] = {}
        for w in words:
            seen[w.lower()] = seen.get(w.lower(), 0) + 1
        worth = sorted(range(len(words)), key=lambda i: (-(words[i].lower() in SMALL_WORDS) - 0.5 * seen[words[i].lower()], i))
        low, high = 0, len(worth)
        while low < high:  # the fewest words to drop
            mid = (low + high) // 2
            gone = set(worth[:mid])
            if count(" ".join(w for i, w in enumerate(words) if i not in gone)) <= limit:
                high = mid
            else:
                low = mid + 1
        gone = set(worth[:low])
        words = [w for i, w in enumerate(words) if i not in gone]
        if words and count(" ".join(words)) <= limit:
            return " ".join(words)
    sentences = re.split(r"(?<=[.!?])\s+", " ".join(words))
    while len(sentences) > 1 and count(" ".join(sentences)) > limit:
        sentences.pop()
    text = " ".join(sentences)
    if count(text) <= limit:
        return text
    words = text.split()
    return " ".join(words[: max(1, len(words) * limit // count(text))])


def trimmed(limit: int, count=None):
    """Column function of trim_text; count defaults to the number of words."""
    size = count or (lambda s: len(s.split()))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else trim_text(t, limit, size))
    return run
