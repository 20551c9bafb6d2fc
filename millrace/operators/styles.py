"""Renderings of one statement among notes, as records in the wild show it: a layout says how its lines look.

A rendering is seeded by its key, so it does not depend on partitions.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F


def _plain(t: str) -> str:
    return t


def _no_bar(t: str) -> str:
    return t.replace("|", "/")


def _quoted(t: str) -> str:
    return json.dumps(t, ensure_ascii=False)[1:-1]


def _cell(t: str) -> str:
    return '"' + t.replace('"', '""') + '"' if set(t) & set(',"\n') else t


class Layout(NamedTuple):
    """head, the statement's line, what stands between, note lines, tail; lines may use text, k (line number), name, code, time and level."""

    line: str
    note: str
    head: str = ""
    between: str | None = None
    tail: str = ""
    join: str = "\n"
    notes: tuple[int, int] = (4, 8)
    escape: Callable[[str], str] = _plain


_RULE = "+" + "-" * 10 + "+" + "-" * 42 + "+"
LAYOUTS = {
    "bullets": Layout("- {text}", "- {text}"),
    "numbered": Layout("{k}) {text}", "{k}) {text}"),
    "key_value": Layout("Action: {text}", "{name}: {text}", notes=(3, 3)),
    "json": Layout('"action": "{text}"', '"{name}": "{text}"', head="{{", tail="}}", join=", ", notes=(3, 3), escape=_quoted),
    "yaml": Layout('action: "{text}"', '- "{text}"', between="notes:", escape=_quoted),
    "log": Layout("{time} {level} {text}", "{time} {level} {text}", notes=(5, 10)),
    "sections": Layout("{text}", "{text}", head="## BLOCK-{code}\n", between="--", notes=(5, 9)),
    "tsv": Layout("action\t{text}", "note\t{text}", escape=lambda t: t.replace("\t", " ")),
    "md_table": Layout("| action | {text} |", "| note | {text} |", head="| field | value |\n|---|---|\n", escape=_no_bar),
    "csv": Layout("action,{text}", "note,{text}", head="field,value\n", escape=_cell),
    "pipe": Layout("{text}", "{text}", join=" | ", notes=(5, 9), escape=_no_bar),
    "ini": Layout("action={text}", "note{k}={text}", head="[record]\n"),
    "sql": Layout("'{text}'", "'{text}'", head="INSERT INTO log VALUES (", tail=");", join=", ", notes=(2, 2), escape=lambda t: t.replace("'", "''")),
    "mail": Layout("{text}", "{text}", head="Subject: record {code}\nX-Run: {code}\n\n"),
    "xml": Layout("  <action>{text}</action>", "  <note>{text}</note>", head="<record>\n", tail="\n</record>", notes=(5, 9), escape=html.escape),
    "latex": Layout("{text}", "{text} \\\\", head="\\section*{{Record}}\n", between="\\subsection*{{Notes}}", notes=(5, 9), escape=lambda t: re.sub(r"([#$%&_{}])", r"\\\1", t)),
    "markdown": Layout("* {text}", "> {text}"),
    "grid": Layout("| ACTION   | {text:<40} |", "| NOTE     | {text:<40} |", head=_RULE + "\n", tail="\n" + _RULE, notes=(5, 9), escape=_no_bar),
    "flow": Layout("{text}", "{text}", join=" -> ", notes=(5, 9)),
    "headers": Layout("{text}", "{text}", head="=== ACTION ===\n", between="=== NOTES ===", tail="\n=== END ===", notes=(5, 9)),
    "accordion": Layout("{text}", "{text}", head="[[Action]]\n", between="[[Notes]]", notes=(5, 9)),
}
NAMES = ("check", "note", "extra")
#: Notes by kind, as (least number in a rendering, phrases); none names a treatment.
NOTES = {
    "technical": (2, ("reads trimmed at quality 20", "adapter content below 1 %", "library rerun on lane 2", "index swap ruled out", "RIN above 8", "paired-end, 2 x 150", "counts checked twice", "duplicates marked")),
    "clinical": (2, ("vital signs stable", "consent on file", "follow-up visit planned", "imaging reviewed", "no fever noted", "weight unchanged", "family history recorded")),
    "administrative": (1, ("form B signed", "box 12, shelf 3", "shipment logged", "batch sheet attached", "barcode scanned")),
    "timing": (1, ("collected in the morning", "stored overnight", "run on a Tuesday", "thawed once", "handed over at noon")),
    "other": (1, ("see remark above", "label partly faded", "handwriting unclear", "as discussed", "pending review")),
}


def notes_for(rng: random.Random, forbidden: tuple[str, ...] = (), pools: dict[str, tuple[int, tuple[str, ...]]] | None = None) -> list[str]:
    """Shuffled notes of every kind, without those that name a forbidden term: a rendering speaks of one treatment only."""
    terms = [t.lower() for t in forbidden if t]
    out: list[str] = []
    for least, phrases in (NOTES if pools is None else pools).values():
        ok = [p for p in phrases if not any(t in p.lower() for t in terms)]
        out += rng.sample(ok, min(len(ok), rng.randint(least, least + 2)))
    rng.shuffle(out)
    return out


def varied(line: str, rng: random.Random, share: float) -> str:
    """line, each with that chance in capitals, in brackets and with dots behind it."""
    for change in (str.upper, "[{}]".format, "{} ...".format):
        if rng.random() < share:
            line = change(line)
    return line


def rendered(text: str, style: str, notes: list[str], rng: random.Random, share: float = 0.18) -> str:
    """text and some of the notes in a style; the statement itself is only escaped, never changed."""
    layout = LAYOUTS[style]

    def line(form: str, said: str, k: int) -> str:
        time = f"2024-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}Z"
        return form.format(text=layout.escape(said), k=k, name=NAMES[(k - 2) % len(NAMES)], code=rng.randint(1000, 9999), time=time, level=rng.choice(("INFO", "WARN", "DEBUG")))

    taken = notes[: rng.randint(*layout.notes)]
    lines = [line(layout.line, text, 1)] + ([layout.between.format()] if layout.between else [])
    lines += [line(layout.note, varied(n, rng, share), k) for k, n in enumerate(taken, 2)]
    return line(layout.head, "", 1) + layout.join.join(lines) + layout.tail.format()


def styles(names: tuple[str, ...] = tuple(LAYOUTS), seed: int = 42, forbidden: tuple[str, ...] = ()):
    """Column function (text, key): the text among notes in the style that the key's number picks; a null text or key stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(t, k):
            if t is None or pd.isna(k):
                return None
            rng = random.Random(f"{seed}:{int(k)}")
            return rendered(t, names[int(k) % len(names)], notes_for(rng, forbidden), rng)
        return pd.Series([one(t, k) for t, k in zip(texts, keys)], dtype=object)
    return run
