"""Language identification by a linear-chain conditional random field over words.

Words are the runs of letters of a text, in chains of at most chain_words words. A word's features are hashed: prefixes,
suffixes, character n-grams, and its identity if it is in the lexicon (words met at least twice in training). Transition
weights are learned with the feature weights by maximum likelihood (forward-backward, full gradient, Adam). Training chains
join stretches of labelled documents, so that they switch language and the transitions are learned. Forward-backward
gives each word's posterior, and so its label; predict() can return the labelled spans of words. A document's language is the
one with the largest mean posterior, which is its score. Character n-grams are those of the whole word, however long.

The model is fitted on at most train_docs whole labelled documents, those with the smallest hashes of doc_id. All
documents are labelled whole; chains of many documents advance together in numpy. Emissions of distinct words are kept
in a bounded cache per Python worker. Nothing is shuffled.

Defined cases: a null or letterless text is "und" with score 0; without labelled documents everything is "und"; repeated
rows repeat; an empty table stays empty; predict() carries all columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import binary_parts, blocks_of, hash_sample, map_batches, plain_names
from .wordsplit import LETTER, Pieces, byte_classes

TRAIN_DOCS = 600
UNKNOWN = "und"
SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("lang", "string").add("words", "integer"))
_BITS = 17
_CACHE = 1 << 17


def letter_words(raw: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct pieces, index of the distinct word at each place, words of each document); only pieces of letters."""
    return placed_words(raw, off)[:3]


def placed_words(raw: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """letter_words(), and the first byte and the end of each word."""
    pieces = Pieces(raw, off)
    if not len(pieces.starts):
        none = np.zeros(0, np.int64)
        return [], none, np.zeros(len(off) - 1, np.int64), none, none
    first = pieces.starts + ((raw[pieces.starts] == 0x20) & (pieces.lengths > 1))
    letters = byte_classes(raw)[first] == LETTER
    sums = np.concatenate([[0], np.cumsum(letters)])
    cuts = np.concatenate([pieces.doc_of_first[: len(off) - 1], [len(pieces.starts)]])
    return pieces.distinct, pieces.index[letters], np.diff(sums[cuts]), first[letters], (pieces.starts + pieces.lengths)[letters]


class LanguageCRF:
    """The chain model: feature weights (2^_BITS, labels), transitions, lexicon."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << _BITS, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))
        self.lexicon: frozenset[bytes] = frozenset()

    def features(self, piece: bytes) -> list[int]:
        w = "^" + piece.decode("utf-8", "replace").strip().lower() + "$"
        b = w.encode()
        names = [b"p" + w[:k].encode() for k in (2, 3, 4)] + [b"s" + w[-k:].encode() for k in (2, 3, 4, 5)]
        names += [w[i: i + k].encode() for k in (2, 3) for i in range(max(1, len(w) - k + 1))]
        if b in self.lexicon:
            names.append(b"w" + b)
        crc, mask = zlib.crc32, (1 << _BITS) - 1
        return [crc(n) & mask for n in names]

    def emissions(self, pieces: list[bytes]) -> np.ndarray:
        if not pieces:
            return np.zeros((0, len(self.labels)))
        ids = [self.features(p) for p in pieces]
        starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]])
        return np.add.reduceat(self.weights[np.fromiter((x for i in ids for x in i), np.int64)], starts, axis=0)

    def posteriors(self, emit: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Posterior of each label at each place of chains laid one after the other; pairs: also summed transitions and log-likelihood's normaliser."""
        n, k = emit.shape
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # chains longer than t
        e = np.exp(emit - emit.max(axis=1, keepdims=True))
        step = np.exp(self.moves - self.moves.max()).astype(emit.dtype)
        alpha, out = np.empty((n, k), emit.dtype), np.empty((n, k), emit.dtype)
        a = None
        for t, m in enumerate(live):
            at = starts[:m] + t
            a = e[at] if t == 0 else (a[:m] @ step) * e[at]
            a /= a.sum(axis=1, keepdims=True)
            alpha[at] = a
        beta, moved = np.zeros((0, k), emit.dtype), np.zeros((k, k))
        for t in range(len(live) - 1, -1, -1):
            m = live[t]
            at = starts[:m] + t
            if t + 1 < len(live) and live[t + 1]:
                nxt = beta[: live[t + 1]] * e[at[: live[t + 1]] + 1]
                back = nxt @ step.T
                if pairs:
                    joint = alpha[at[: live[t + 1]]][:, :, None] * step * nxt[:, None, :]
                    moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                beta = np.concatenate([back / back.sum(axis=1, keepdims=True), np.ones((m - live[t + 1], k), emit.dtype)])
            else:
                beta = np.ones((m, k), emit.dtype)
            p = alpha[at] * beta
            out[at] = p / p.sum(axis=1, keepdims=True)
        return (out, moved) if pairs else out

    def fit(self, texts: list[str], langs: list[str], rounds: int = 30, rate: float = 0.15, decay: float = 1e-4, stretch: int = 32, per_chain: int = 4, seed: int = 7) -> LanguageCRF:
        blobs = [t.encode("utf-8", "replace") for t in texts]
        off = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        distinct, index, counts = letter_words(np.frombuffer(b"".join(blobs), np.uint8), off)
        if not len(index):
            return self
        tag = np.repeat([self.labels.index(x) for x in langs], counts)
        forms = [b"^" + p.decode("utf-8", "replace").strip().lower().encode() + b"$" for p in distinct]
        met: dict[bytes, int] = {}
        for f, n in zip(forms, np.bincount(index, minlength=len(distinct)).tolist()):
            met[f] = met.get(f, 0) + n
        self.lexicon = frozenset(f for f, n in met.items() if n >= 2)
        ids = [self.features(p) for p in distinct]
        sizes = np.array([len(i) for i in ids])
        flat, starts = np.fromiter((x for i in ids for x in i), np.int32), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        del ids, met
        doc_start = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.unique(np.concatenate([np.arange(a, b, stretch) for a, b in zip(doc_start, doc_start[1:])] + [[len(index)]])).astype(np.int64)
        turn = np.random.default_rng(seed).permutation(len(cuts) - 1)
        places = np.concatenate([np.arange(cuts[s], cuts[s + 1]) for s in turn])
        part = np.diff(cuts)[turn]
        lengths = np.add.reduceat(part, np.arange(0, len(part), per_chain))
        index, tag = index[places], tag[places]
        k, total = len(self.labels), len(index)
        truth = np.stack([np.bincount(index, tag == j, len(distinct)) for j in range(k)], 1)
        inner = np.ones(total, bool)
        inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
        gold_moves = np.zeros((k, k))
        np.add.at(gold_moves, (tag[:-1][inner[1:]], tag[1:][inner[1:]]), 1)
        m1 = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        m2 = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for r in range(1, rounds + 1):
            emit = np.add.reduceat(self.weights.astype(np.float32)[flat], starts, axis=0)
            post, moved = self.posteriors(emit[index], lengths, pairs=True)
            diff = truth - np.stack([np.bincount(index, post[:, j], len(distinct)) for j in range(k)], 1)
            grads = [np.stack([np.bincount(flat, np.repeat(diff[:, j], sizes), 1 << _BITS) for j in range(k)], 1) / total - decay * self.weights, (gold_moves - moved) / total - decay * self.moves]
            for p, g, a, b in zip((self.weights, self.moves), grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.02 * (g * g - b)
                p += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.98**r)) + 1e-8)
        return self


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, key: str = "doc_id") -> LanguageCRF:
    """Model from labelled(key, text, lang): at most train_docs whole documents, chosen by a hash of key."""
    known = labelled.where("lang is not null and text is not null").select(key, "text", "lang")
    rows = hash_sample(known, train_docs, key).select("text", "lang").collect()
    labels = sorted({r[1] for r in rows})
    return LanguageCRF(labels).fit([r[0] for r in rows], [r[1] for r in rows]) if labels else LanguageCRF([])


_CACHES: dict[int, tuple[dict[bytes, int], list]] = {}


def _cached_emissions(model: LanguageCRF, key: int, pieces: list[bytes]) -> np.ndarray:
    """Emissions of distinct pieces; the cache holds those of the model last used, _CACHE at most."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = ({}, [np.empty((_CACHE, len(model.labels)), np.float32)])
    known, (rows,) = _CACHES[key]
    at = np.fromiter((known.get(p, -1) for p in pieces), np.int64, len(pieces))
    new = np.flatnonzero(at < 0)
    out = np.empty((len(pieces), len(model.labels)), np.float32)
    out[at >= 0] = rows[at[at >= 0]]
    for part in np.split(new, range(1 << 13, len(new), 1 << 13)):  # features of many pieces take room
        out[part] = fresh = model.emissions([pieces[i] for i in part])
        held = len(known)
        room = min(len(part), _CACHE - held)
        rows[held: held + room] = fresh[:room]
        known.update(zip((pieces[i] for i in part[:room].tolist()), range(held, held + room)))
    return out


def _spans(model: LanguageCRF, raw: np.ndarray, off: np.ndarray, post: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Per text, its runs of words with one label, in characters."""
    label, doc = post.argmax(axis=1) if len(post) else np.zeros(0, np.int64), np.repeat(np.arange(len(counts)), counts)
    head = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(doc)) - 1 if len(head) else head
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = chars[off[doc[head]]]
    cells = [pa.array(chars[starts[head]] - base, pa.int32()), pa.array(chars[ends[last]] - base, pa.int32()), pa.array(model.labels, pa.string()).take(pa.array(label[head])), pa.array(last - head + 1, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[head], np.arange(len(counts) + 1)), pa.int32()), pa.StructArray.from_arrays(cells, names=["start", "end", "lang", "words"]))


def label_batch(model: LanguageCRF, raw: np.ndarray, off: np.ndarray, key: int, chain_words: int = 256, spans: bool = False):
    """(language, score, labelled spans or None) of each text."""
    docs = len(off) - 1
    if not model.labels or not docs:
        none = np.zeros(0, np.int64)
        return [UNKNOWN] * docs, np.zeros(docs), _spans(model, raw, off, none, np.zeros(docs, np.int64), none, none) if spans else None
    distinct, index, counts, firsts, lasts = placed_words(raw, off)
    used, place = np.unique(index, return_inverse=True)
    emit = _cached_emissions(model, key, [distinct[i] for i in used])[place].astype(np.float64)
    chains = -(-counts // chain_words)
    lengths = np.full(int(chains.sum()), chain_words, np.int64)
    ends = np.cumsum(chains)[counts > 0] - 1
    lengths[ends] = counts[counts > 0] - (chains[counts > 0] - 1) * chain_words
    post = model.posteriors(emit, lengths) if len(emit) else emit
    full = np.flatnonzero(counts)
    sums = np.add.reduceat(post, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0) / counts[full, None] if len(full) else post
    langs, scores = [UNKNOWN] * docs, np.zeros(docs)
    best = sums.argmax(axis=1) if len(full) else []
    for d, b in zip(full.tolist(), best):
        langs[d] = model.labels[b]
    if len(full):
        scores[full] = np.clip(sums.max(axis=1), 0, 1)
    return langs, scores, _spans(model, raw, off, post, counts, firsts, lasts) if spans else None


def predict(docs: DataFrame, model: LanguageCRF, to: tuple[str, str] = ("lang_pred", "score"), spans: str | None = None) -> DataFrame:
    """docs with language and score in the columns `to` (columns of these names are replaced); only text is looked at.

    spans names a column for the runs of words with one label: start and end in characters, language, number of words.
    """
    more = [spans] if spans else []
    docs = docs.drop(*to, *more)
    plain = plain_names(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        import secrets

        crf = shared.value
        key = getattr(crf, "key", None) or secrets.randbits(60)
        crf.key = key
        for batch in batches:
            raw, off = binary_parts(batch.column(place))
            for i, j in blocks_of(off, 1 << 20):
                langs, scores, found = label_batch(crf, raw[off[i]: off[j]], off[i: j + 1] - off[i], key, spans=bool(more))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([found] if more else [])], names=[*batch.schema.names, "lang_pred", "score", *(["spans"] if more else [])])

    schema = StructType(list(plain.schema.fields)).add("lang_pred", "string").add("score", "double")
    if more:
        schema = schema.add("spans", SPANS)
    return map_batches(plain, run, schema).toDF(*docs.columns, *to, *more)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
