"""Benchmark decontamination by a generalised suffix automaton over the words of all test items.

Words are what is left of a text between ASCII bytes that are neither digits nor letters, A-Z lower-cased. The
automaton holds every run of words of every item. Training words stream through it, which gives at each word the
longest run of words ending there that some item holds; a run of window words, or the whole of a shorter item, is a hit.

The items reach the executors as one automaton per max_words item words; more items make more automata, each applied in
the same pass over a document, so what one task holds is bounded by the benchmark alone, never by the corpus.
Nothing is shuffled. Defined cases: null or wordless texts have no words and no hits; null or wordless items
are ignored; items with equal words all count; an empty benchmark hits nothing; other columns are carried by
remove_spans() and dropped by hits().
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, plain_names

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEEP or 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items that each state's runs occur in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.names = [k for k, _ in items]
        ends: list[tuple[int, int, int]] = []  # item, place, state
        for k, (_, ws) in enumerate(items):
            last = 0
            for p, w in enumerate(ws):
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((k, p, last))
        # in order of falling length, items go up the links; a state at window length tells the items of a window
        n = len(self.link)
        self.items: list[set[int] | None] = [None] * n
        for k, p, v in ends:
            if p + 1 < window:
                continue
            while self.len[self.link[v]] >= window:
                v = self.link[v]
            self.items[v] = (self.items[v] or set()) | {k}
        self.short: dict[tuple[int, int], set[int]] = {}  # (state, length) of whole items shorter than a window
        for k, (_, ws) in enumerate(items):
            if 0 < len(ws) < window:
                v = 0
                for w in ws:
                    v = self.next[v][self.ids[w]]
                self.short.setdefault((v, len(ws)), set()).add(k)
        self.window_of = [-1] * n  # state: its ancestor that holds runs of window words
        self.shorts: list[tuple[tuple[int, int, tuple[int, ...]], ...]] = [()] * n
        own: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        for (v, length), ks in self.short.items():
            own.setdefault(v, []).append((length, v, tuple(sorted(ks))))
        for v in sorted(range(n), key=self.len.__getitem__):
            up = self.link[v]
            if up >= 0:
                self.shorts[v] = self.shorts[up]
                if self.len[v] >= window:
                    self.window_of[v] = v if self.len[up] < window else self.window_of[up]
            if v in own:
                self.shorts[v] = self.shorts[v] + tuple(own[v])

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(hit word spans, items, longest run) of one document."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        shorts, window_of, items = self.shorts, self.window_of, self.items
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = run = longest = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                v = run = 0
                continue
            e = nxt[v]
            if c in e:
                v = e[c]
                run += 1
            else:
                while v >= 0 and c not in nxt[v]:
                    v = link[v]
                if v < 0:
                    v = run = 0
                    continue
                run = length[v] + 1
                v = nxt[v][c]
            if run > longest:
                longest = run
            if run >= window:
                spans.append((i + 1 - window, i + 1))
                found |= items[window_of[v]]
            if shorts[v]:
                for size, state, ks in shorts[v]:
                    if run >= size:
                        spans.append((i + 1 - size, i + 1))
                        found.update(ks)
        return merged(spans), found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Words of all items together that one call takes; automata of so many go to every executor (about 100 bytes a word).
MAX_BENCHMARK_WORDS = 8_000_000


def automata(benchmark: DataFrame, window: int, max_words: int = 2_000_000) -> list[SuffixAutomaton]:
    """Automata of all items; the benchmark is the one table that the driver reads whole, item by item.

    One of over MAX_BENCHMARK_WORDS words raises ValueError: call once for each part of it and merge the hits.
    """
    groups: list[list] = [[]]
    held = total = 0
    for key, text in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id").toLocalIterator():
        ws = words_of((text or "").encode())
        if not ws:
            continue
        if groups[-1] and held + len(ws) > max_words:
            groups.append([])
            held = 0
        groups[-1].append((key, ws))
        held += len(ws)
        total += len(ws)
        if total > MAX_BENCHMARK_WORDS:
            raise ValueError(f"the benchmark has over {MAX_BENCHMARK_WORDS} words")
    return [SuffixAutomaton(g, window) for g in groups if g]


def _scan(autos: list[SuffixAutomaton], words: list[bytes]) -> tuple[list[tuple[int, int]], list[str], int]:
    spans, names, longest = [], set(), 0
    for a in autos:
        s, found, n = a.scan(words)
        spans += s
        names |= {a.names[k] for k in found}
        longest = max(longest, n)
    return merged(spans) if len(autos) > 1 else spans, sorted(x for x in names if x is not None), longest


def _column(batch, k):
    return (b"" if not x.is_valid else x.as_buffer().to_pybytes() for x in batch.column(k).cast(pa.large_binary()))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_run and spans (word places) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window))

    def run(batches):
        autos = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for text in _column(part, 1):
                    ws = words_of(text)
                    spans, names, longest = _scan(autos, ws)
                    rows.append((len(ws), sum(b - a for a, b in spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(spans), longest, [{"start": a, "end": b} for a, b in spans]))
                cols = list(zip(*rows)) or [[]] * 7
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), span]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_run", "spans"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_run bigint, spans array<struct<start:int,end:int>>")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit spans, each replaced by one space; a document with over max_coverage of its words hit goes.

    All columns are kept; only text changes, and only in documents that are hit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window))
    place = docs.columns.index("text")

    def run(batches):
        autos = shared.value
        for batch in batches:
            keep, texts = [], []
            for text, value in zip(_column(batch, place), batch.column(place)):
                ws = words_of(text)
                spans = _scan(autos, ws)[0]
                ok = sum(b - a for a, b in spans) <= max_coverage * len(ws)
                keep.append(ok)
                if not ok:
                    continue
                if not spans:
                    texts.append(value.as_py())
                    continue
                at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
                cut, out = 0, []
                for a, b in spans:
                    out.append(text[cut: at[a][0]])
                    cut = at[b - 1][1]
                out.append(text[cut:])
                texts.append(b" ".join(out).decode("utf-8"))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.set_column(place, batch.schema.names[place], pa.array(texts, batch.schema.types[place]))

    plain = plain_names(docs, "text")
    return map_batches(plain, run, plain.schema).toDF(*docs.columns)
