"""The ten operators against brute force on small fixtures with edge rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe, common, decontam, langid, planes, pq, simhash, slots, suffixdedup, urlfilter, wordcount, wordsplit  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PASSAGE = "the quick brown fox jumps over the lazy dog while nine wizards watch from the hill"
TEXTS = [None, "", " ", "a", "!!! ...", PASSAGE, PASSAGE + " again", "x " + PASSAGE, PASSAGE, "Été à la plage, l'année's fin: 123 ²³ don't  \n\n stop", "don't we'll 'tis x's 's\t\tz", "ab" * 400,
         "日本語のテキスト、です。", "\x00 zero \x1f ", "naïve " * 200, "a\u2003b\u00a0c\u3000d \u200bzero", "one two three four", "one two three", "<|endoftext|> inside"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, PASSAGE), (None, "null id " + PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- pieces, BPE, counts ---

def pieces_of(texts):
    bs = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bs])]).astype(np.int64)
    p = wordsplit.Pieces(np.frombuffer(b"".join(bs), np.uint8), off)
    ends = [*p.doc_of_first.tolist()[: len(bs)], len(p.starts)]
    return [[p.distinct[k] for k in p.index[a:b]] for a, b in zip(ends, ends[1:])]


def test_pieces_equal_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    alphabet = ["a", "s", "'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "1", "é", "。", "!", "\u3000", "²", "😀", "\x85", "\u00a0", "ll", "d"]
    for _ in range(400):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        assert pieces_of(texts) == [[w.encode() for w in pattern.findall(t)] for t in texts]


def test_bpe_equals_the_library_and_round_trips(spark, docs, empty):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = sorted(((i, enc.encode_ordinary(t or "")) for i, t in DOCS), key=repr)
    encoded = bpe.encode(docs, RANKS)
    assert rows(encoded) == [(i, x) for i, x in want]
    assert rows(bpe.encode(docs, RANKS, long_piece=4, block_bytes=64)) == rows(encoded)
    assert rows(bpe.encode(docs, RANKS, block_bytes=64, row_words=3, scope_words=7)) == rows(encoded)
    assert rows(bpe.decode(encoded, RANKS)) == sorted(((i, bytearray((t or "").encode())) for i, t in DOCS), key=repr)
    digest = {(r[0], r[1], r[2], r[3]) for r in bpe.round_trip(docs, RANKS).collect()}
    assert digest == {(i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in ((d, enc.encode_ordinary(d[1] or "")) for d in DOCS)}
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_every_token_merges_to_itself():
    ranks = bpe.read_ranks(RANKS)
    assert all(bpe.heap_merge(t, ranks) == [r] for t, r in ranks.items())


def test_counts_equal_greedy_matching(spark, docs, empty):
    ranks = bpe.read_ranks(RANKS)

    def greedy(w):
        i = n = 0
        while i < len(w):
            j = len(w)
            while w[i:j] not in ranks:
                j -= 1
            i, n = j, n + 1
        return n
    want = sorted(((i, len(p), sum(map(greedy, p))) for (i, _), p in zip(DOCS, pieces_of([t or "" for _, t in DOCS]))), key=repr)
    assert rows(wordcount.count_tokens(docs, RANKS)) == want
    assert wordcount.count_tokens(empty, RANKS).count() == 0


def test_automaton_needs_cover():
    a = wordcount.Automaton([b"ab", b"abc", b"b", b"a"])
    assert [a.count(w) for w in (b"", b"ab", b"abab", b"abcab", b"abx", b"ba")] == [0, 1, 2, 2, None, 2]


# --- planes ---

def test_files_hold_ids_in_order(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = planes.write_and_read(docs.where("doc_id is not null"), public_tokenizers.path("byte_bpe_50k.json"), chunk_ids=16, file_ids=200, ranges=3).collect()
    by_id = {}
    for i, t in DOCS:
        if i is not None:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            by_id.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    at = 0
    got.sort(key=lambda r: r.start)
    for i in sorted(by_id):
        for n, crc in by_id[i]:
            r = got.pop(0)
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, n, crc)
            at += n
    assert not got
    assert planes.write_and_read(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plane_files_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 16, 100):
        ids = rng.integers(0, 50257, n).astype("<u2")
        cut = np.array([n // 2, n - n // 2])
        a, b, c = planes.unpack_file(planes.pack_file(ids, np.array([3, 9]), cut, 16), 2)
        assert a.tolist() == ids.tolist() and b.tolist() == [3, 9] and c.tolist() == cut.tolist()


# --- decontamination ---

def naive_hits(items, text, window=10):
    ws, hit, names = decontam.words_of((text or "").encode()), set(), set()
    for k, t in items:
        iw = decontam.words_of((t or "").encode())
        size = min(window, len(iw))
        for i in range(len(iw) - size + 1) if size else ():
            for j in range(len(ws) - size + 1):
                if ws[j: j + size] == iw[i: i + size]:
                    hit.update(range(j, j + size))
                    names.add(str(k))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_hits_equal_brute_force(spark, docs, empty):
    rng = random.Random(3)
    items = [(1, PASSAGE), (2, "Nine WIZARDS"), (3, None), (4, ""), (5, "nine wizards"), (10, " ".join(rng.choice("a b c".split()) for _ in range(40))), (11, "a b a b a b a b a b a b")]
    more = [(100 + i, " ".join(rng.choice("a b c nine wizards".split()) for _ in range(120))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = sorted(((i, *naive_hits(items, t)) for i, t in DOCS + more), key=repr)
    assert rows(decontam.hits(every, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert decontam.hits(empty, bench).count() == 0
    assert decontam.hits(every, bench.limit(0)).where("contaminated").count() == 0


def test_remove_spans_cuts_and_keeps(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "Before! " * 30 + PASSAGE.upper() + ", after."), (2, PASSAGE), (3, "clean text"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in decontam.remove_spans(d, bench).collect()}
    assert set(got) == {1, 3, 4} and "WIZARDS" not in got[1] and got[1].endswith(", after.") and got[3] == "clean text" and got[4] is None


# --- SimHash, suffixes, vectors ---

def test_simhash_equals_brute_force(spark, docs, empty):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(50)]
    base = [rng.choice(words) for _ in range(300)]
    more = []
    for i in range(120):
        b = list(base) if i % 2 else [rng.choice(words) for _ in range(60)]
        b[rng.randrange(len(b))] = "X%d" % i
        more.append((100 + i, " ".join(b)))
    every = docs.select("doc_id", "text").where("doc_id is not null").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    data = [(i, t) for i, t in DOCS if i is not None] + more
    fps = []
    for _, t in data:
        h = np.array(simhash.shingle_hashes((t or "").encode(), 4), np.uint64)
        bits = [(2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if len(h) else False for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if bits[b]))
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(data):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(data)), key=repr)
    assert rows(simhash.near_duplicates(every)) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_pigeonhole_loses_no_pair_and_splits_hot_groups(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 300:
        x = base
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint")
    edges = [(int(a) & (2**64 - 1), int(b) & (2**64 - 1)) for a, b in simhash.link_edges(df, 4, max_group=50).collect()]

    def groups(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(x for x in fps if find(x) == r) for r in map(find, fps)}
    assert groups(edges) == groups([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(300)], [(7, i) for i in range(200)] + [(500, 7), (600, 601)],
                                   [(i * 7919 % 401, i * 104729 % 397 - 50) for i in range(250)]])
def test_components_are_whole_and_their_plans_stay_small(spark, edges, monkeypatch):
    leaves = []

    def watched(df, name, write=common.written):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, name)

    monkeypatch.setattr(common, "written", watched)
    got = rows(common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")))
    root = {x: x for p in edges if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == sorted(root.items(), key=repr)
    assert max(leaves) <= 2


def test_plans_add_up():
    both = np.diag(np.full(64, 500.0)) + 250
    for n in (10**3, 10**6, 10**9):
        chosen = simhash.plan(n, both, 4)
        assert sum(t + 1 for _, t in chosen) == 5


def naive_spans(data, length=50):
    first = {}
    for d, t in sorted(((d if d is not None else -(2**63)), (t or "").encode()) for d, t in data):
        for s in range(len(t) - length + 1):
            first.setdefault(t[s: s + length], d)
    out = []
    for d, t in data:
        key, t = d if d is not None else -(2**63), (t or "").encode()
        m = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if first[t[s: s + length]] < key:
                m[s: s + length] = True
        m = m[: len(t)]
        out.append((d, len(t), int(m.sum()), int((m & ~np.append(False, m[:-1])).sum()) if len(m) else 0, hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
def test_spans_equal_brute_force(spark, docs, hot):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abcde é") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    more = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    assert rows(suffixdedup.spans(every, hot_docs=hot)) == naive_spans(DOCS + more)


def test_classes_of_prefixes_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        size = rng.randint(1, 6)
        texts = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(size, 30))) for _ in range(rng.randint(1, 8))})
        ids = np.array([rng.randint(0, 9) for _ in texts])
        least = {}
        for t, d in zip(texts, ids.tolist()):
            for s in range(len(t) - size + 1):
                least[t[s: s + size]] = min(d, least.get(t[s: s + size], 99))
        for t, v in zip(texts, suffixdedup.smallest_docs(texts, ids, size)):
            assert v.tolist() == [least[t[s: s + size]] for s in range(len(t) - size + 1)]


def test_judge_compares_a_text_under_every_key_it_comes_with():
    import pyarrow as pa

    rng = random.Random(8)
    t = bytes(rng.choice(b"abcdefgh") for _ in range(50))
    run = b"xyz" + t + b"uvw"

    def sent(grp, items):
        keys = np.array([k for k, _, _ in items], np.uint64)
        blob = suffixdedup._pack(np.diff(keys, prepend=np.uint64(0)), np.array([d for _, d, _ in items], np.int64), np.array([len(x) for _, _, x in items], np.int32), np.frombuffer(b"".join(x for _, _, x in items), np.uint8))
        return {"grp": grp, "n": len(items), "blob": blob}

    rows = [sent(0, [(1, 1, t), (2, 1, t)]), sent(1, [(2, 5, run)]), sent(2, [(1, 0, t)])]
    got = suffixdedup._judge(50)((pa.scalar(0),), pa.Table.from_pylist(rows, pa.schema([("grp", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])))
    docs = {r["grp"]: np.repeat(*suffixdedup._unpack(r["blob"], r["n"], np.int64, np.int32)[:2]).tolist() for r in got.to_pylist()}
    assert docs == {0: [0, 0], 1: [5, 5, 5, 0, 5, 5, 5], 2: [0]}


def test_remove_text_keeps_columns(spark, docs, empty):
    got = suffixdedup.remove_text(docs)
    assert got.columns == docs.columns and got.count() == len(DOCS)
    assert suffixdedup.spans(empty).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 16)), x[:20], np.full((30, 16), 1.0), np.full((5, 16), 2.0)]).astype(np.float32)
    data = [(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] * 16), (905, [None] + [1.0] * 15), (906, [1.0] * 3)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(3)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(u))])
    want = [(i, int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(u))] + [(i, 0, i, True) for i, _ in data[len(u):]]
    got = rows(pq.near_duplicates(df, chunk=32, block=64))
    assert got == sorted(want, key=repr)
    assert pq.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_a_large_group_keep_their_links(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    near = centre / np.linalg.norm(centre) + 0.25 * rng.normal(size=(1500, 32)) / np.sqrt(32)
    x = np.concatenate([rng.normal(size=(3000, 32)), near]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert want[3000:].mean() > 1000
    for kw in ({}, {"chunk": 64, "block": 200, "block_roots": 1}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(df, **kw).collect()}
        assert [got[i][0] for i in range(len(x))] == want.tolist()
        assert {got[i][1] for i in range(3000, len(x)) if want[i]} == {min(i for i in range(3000, len(x)) if want[i])}


# --- URLs, languages, slots ---

def test_url_parts_and_rules(spark):
    urls = ["http://A.example.NET/en/x?q=1", "https://example.com/de/", "https://badexample.com/de/", "http://x.org/fr", "http://x.org/fr/a#b", "ftp://net", None, "no scheme/net/", "http://h?x/y", "a://b://c/d", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    model, rates = urlfilter.fit(df.select("url", (F.col("page_id") % 2).alias("block")))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge(df, rules, model, rates).collect()}
    assert got == {0: ("a.example.net", "/en/x", "example.net/en/"), 1: ("example.com", "/de/", "example.com/de/"), 2: ("badexample.com", "/de/", None), 3: ("x.org", "/fr", None), 4: ("x.org", "/fr/a", "org/fr/"),
                   5: ("net", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("h", "", None), 9: ("b:", "//c/d", None), 10: ("", "", None)}


def test_url_query_equals_brute_force(spark):
    urls = [f"http{'s' * (i % 2)}://{'Shop' if i % 3 else 'net.spam'}{i % 7}.{h}/{'en/' * (i % 2)}a{i}" for i in range(120) for h in ("example.net", "x.net", "example.com", "site.org")] + [None, "", "plain"]
    df = spark.createDataFrame([(i, u, "extra", "x") for i, u in enumerate([*urls, urls[0]])], "page_id bigint, url string, host string, block_score string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    labelled = df.select("url", (F.col("page_id") % 2).alias("block"))
    model, rates = urlfilter.fit(labelled)
    got = {r.page_id: r for r in urlfilter.judge(df, rules, model, rates).collect()}
    for i, u in enumerate([*urls, urls[0]]):
        host = re.split(r"[/?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
        rest = re.sub(r"^[^/?#]*", "", u.split("://", 1)[1]) if u and "://" in u else ""
        path = re.split(r"[?#]", rest)[0]
        fits = [(len(r), r, v) for r, v in rules for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        score = float(model.predict(np.array([urlfilter.features(u, rates)], float))[0])
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "block" if score > 0.5 else "allow") and abs(got[i].block_score - score) < 1e-9
    assert urlfilter.judge(df.limit(0), rules, model, rates).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] > 0.3)).astype(float)
    m = urlfilter.BoostedTrees().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_languages_on_held_out_documents(spark):
    vocab = {"en": "the of and house water going".split(), "de": "der und haus wasser gehen ich".split(), "fr": "le et maison eau aller été".split()}
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), k) for i in range(300) for k in [rng.choice(list(vocab))]]
    df = spark.createDataFrame(data + [(900, None, "en"), (901, "123 !!", None), (902, "", "de")], "doc_id bigint, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert sum(got[i].lang_pred == k for i, _, k in data) >= 0.98 * len(data)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(df, langid.LanguageCRF([])).collect()} == {"und"}


def test_languages_of_word_spans_and_of_whole_long_runs(spark):
    vocab = {"en": "the of and house water going".split(), "de": "für und häuser wasser gehen ich".split()}
    rng = random.Random(3)
    words = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    data = [(i, words(k, 40), k) for i in range(200) for k in [rng.choice(list(vocab))]]
    model = langid.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"))
    de, en = words("de", 12), words("en", 12)
    some = spark.createDataFrame([(1, f"{de}. 12 {en}!"), (2, "12"), (3, None), (4, en)], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in langid.predict(some, model, spans="spans").collect()}
    at = len(de) + 5
    assert got == {1: [(0, len(de), "de", 12), (at, at + len(en), "en", 12)], 2: [], 3: [], 4: [(0, len(en), "en", 12)]}
    assert [r.spans for r in langid.predict(some, langid.LanguageCRF([]), spans="spans").collect()] == [[]] * 4
    assert {zlib.crc32(b"ab") & ((1 << 17) - 1), zlib.crc32(b"xab") & ((1 << 17) - 1)} <= set(model.features(("x" * 80 + "ab" + "x" * 80).encode()))


def test_marginals_equal_enumeration():
    from itertools import product

    m = langid.LanguageCRF(["a", "b"])
    m.moves = np.array([[0.5, -0.3], [0.1, 0.4]])
    e = np.array([[0.2, 0.1], [-0.5, 0.7], [1.0, 0.0]])
    p = np.zeros((3, 2))
    for path in product(range(2), repeat=3):
        w = np.exp(sum(e[t, y] for t, y in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            p[t, y] += w
    assert np.allclose(m.posteriors(e, np.array([3])), p / p.sum(axis=1, keepdims=True))


def test_slots_fill_shards_evenly(spark, docs, empty):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 as int))").alias("text"))
    got = slots.shard(d, 24).collect()
    size, places = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(size) == 24 and max(size.values()) <= 1.05 * min(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.shard(empty, 24).count() == 0
    assert slots.shard(docs, 4).count() == len(DOCS)


def test_growth_moves_slots_only_to_the_new_shard(spark, tmp_path):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    first = slots.deal(slots.slot_sizes(slots.with_slots(d, 256)), 4, 256)
    path = str(tmp_path / "map")
    slots.store(first, path)
    one = slots.load(spark, path, 1)
    slots.store(slots.grow(one), path)
    a, b = ({r.virtual_slot: r.shard for r in slots.load(spark, path, v).collect()} for v in (1, 2))
    assert len(a) == len(b) == 256 and all(b[s] in (a[s], 4) for s in a)
    size = {}
    for r in slots.load(spark, path, 2).collect():
        size[r.shard] = size.get(r.shard, 0) + r.bytes
    fair, most = sum(size.values()) / 5, max(r.bytes for r in one.collect())
    assert all(size[k] >= fair for k in range(4)) and fair - 4 * most <= size[4] <= fair


# --- pipeline ---

def test_pipeline_stages_keep_columns_and_act(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rng = random.Random(2)
    vocab = {"en": "the of and house water going home".split(), "de": "der und haus wasser gehen ich nicht".split()}
    data = []
    for i in range(60):
        k = rng.choice(list(vocab))
        data.append((i, " ".join(rng.choice(vocab[k]) + str(rng.randint(0, 30)).replace("0", "") for _ in range(80)), k, "s", 1, "x"))
    data += [(100, data[0][1], data[0][2], "s", 1, "x"), (101, "123", "en", "s", 1, "x"), (102, None, "en", "s", 1, "x"), (103, data[1][1] + " " + PASSAGE, "en", "s", 1, "x")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for name, stage in C.STAGES[:-1]:
        left = C.written(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert not {100, 101, 102} & set(texts) and len(texts) >= 58 and not any(PASSAGE in t for t in texts.values())
    assert C.run(spark, str(tmp_path)).count() == len(texts)


def test_pipeline_keeps_clean_rows_with_null_or_shared_ids(spark):
    import corpus_pipeline as C

    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    data = [(None, a), (None, b), (None, b), (1, c), (7, c), (7, d), (7, e), (7, e), (None, d), (9, f), (8, f), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3)
    got = C.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, a), (None, b), (1, c), (7, d), (7, e), (8, f), (None, None)], key=repr)


def test_pipeline_decodes_its_ids(spark, docs):
    import corpus_pipeline as C

    got = C.byte_bpe(spark, docs, "")
    plain = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, RANKS).collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in got.collect()} == plain
    assert rows(got.select("doc_id", "decoded_sha256")) == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in DOCS), key=repr)


def test_pipeline_carries_columns_of_any_name_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("the of and house water going home".split()) + rng.choice("abcdefgh") for _ in range(70)) for i in range(12)}
    names = ["__grp", "__kept_id", "__score", "grp_of_text", "digest_of_row", "kept_id", "predicted_lang", "predicted_score", "grp", "fp", "a.b"]
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    data = [(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in [*texts.items(), (None, texts[0]), (3, texts[3]), (50, None)]]
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows_in in (data, []):
        left = docs = spark.createDataFrame(rows_in, schema)
        for name, stage in C.STAGES[:-1]:
            left = C.written(stage(spark, left, str(tmp_path)), name)
            assert left.columns == docs.columns
        assert sorted((r.doc_id, r["__grp"], r["a.b"]) for r in left.collect()) == [(i, f"__grp{i}", f"a.b{i}") for i in (texts if rows_in else ())]
        assert C.STAGES[-1][1](spark, left, str(tmp_path)).count() == (len(texts) if rows_in else 0)
