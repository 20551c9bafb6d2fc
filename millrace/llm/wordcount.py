"""Token counts by a linear longest-match automaton.

A vocabulary trie gets failure links and, on each link, the number of tokens that following it pops (Song et al.,
2021). One pass over the bytes of a word then gives the number of greedy longest-match pieces, without building any.
Words are the pieces of the public byte-level pattern; a piece that begins with a space starts at the trie of all tokens,
and what remains after a match continues there too, as every single byte is a token and so nothing is unknown.
Each distinct piece of a block is counted once; a bounded cache per Python worker carries counts between blocks.

Defined cases: null and empty texts have 0 words and 0 tokens; repeated rows repeat; an empty table stays empty; other
columns are not carried. There is no shuffle and nothing reaches the driver.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import binary_parts, blocks_of, map_batches
from .wordsplit import Pieces

_CACHE = 1 << 19


class Automaton:
    """Trie of the tokens; fail[v] and pops[v]: where to go, and tokens completed, when no edge of v fits."""

    def __init__(self, tokens):
        self.edges: list[dict[int, int]] = [{}]
        final, depth, parent = [False], [0], [(0, 0)]
        for t in tokens:
            v = 0
            for c in t:
                w = self.edges[v].get(c)
                if w is None:
                    w = self.edges[v][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                    depth.append(depth[v] + 1)
                    parent.append((v, c))
                v = w
            final[v] = bool(t)
        n = len(self.edges)
        self.fail, self.pops = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            p, c = parent[v]
            if final[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, count = self.fail[p], self.pops[p]
            while z >= 0 and c not in self.edges[z]:
                count += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.edges[z][c], count

    def count(self, word: bytes) -> int | None:
        """Greedy longest-match pieces of word; None if they can't cover it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        v = total = 0
        for c in word:
            while (w := edges[v].get(c)) is None:
                if fail[v] < 0:
                    return None
                total += pops[v]
                v = fail[v]
            v = w
        while v:
            if fail[v] < 0:
                return None
            total += pops[v]
            v = fail[v]
        return total


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


@functools.cache
def _counted(path: str) -> dict[bytes, int]:
    return {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row; path is a tiktoken rank file that holds every single byte."""
    def run(batches):
        auto, cache = automaton(path), _counted(path)
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            for i, j in blocks_of(off, 4 << 20):
                pieces = Pieces(raw[off[i]: off[j]], off[i: j + 1] - off[i])
                sizes = np.empty(len(pieces.distinct), np.int64)
                for k, w in enumerate(pieces.distinct):
                    n = cache.get(w)
                    if n is None:
                        n = auto.count(w)
                        if n is None:
                            raise ValueError("the vocabulary does not hold every byte")
                        if len(cache) < _CACHE:
                            cache[w] = n
                    sizes[k] = n
                cuts = np.concatenate([pieces.doc_of_first[: j - i], [len(pieces.starts)]])
                sums = np.concatenate([[0], np.cumsum(sizes[pieces.index])]) if len(pieces.index) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cuts), pa.int64()), pa.array(np.diff(sums[cuts]), pa.int64())], names=["doc_id", "n_words", "n_tokens"])
    return map_batches(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), run, "doc_id bigint, n_words bigint, n_tokens bigint")
