"""Importance resampling, suffix-array dedup and phrase mining against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import phrases as mining
from quarry.llm import resampling, suffixes
from quarry.llm.common import Words

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, n_words string"


def lower(s):
    return (s or "").translate({i: i + 32 for i in range(65, 91)})


# Importance resampling

ODD = [None, "", " \t\n", "--- !!! ???", "É\x00é Öl\x7f 9a", "x" * 300 + " " + "é" * 400, "Word" * 50 + " tail"]
PROSE = [" ".join(R.choice(["the", "of", "Straße", "data", "42", "don't", "ça-va", "end."]) for _ in range(R.randint(5, 60))) for _ in range(60)]


def phrases(text, most):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("most_words", [1, 3])
def test_importance_resampling(spark, most_words):
    rows = [(i, t, "x", "clash") for i, t in enumerate(ODD + PROSE)] + [(None, PROSE[0], "x", "no id"), (3, PROSE[1], "x", "again"), (3, PROSE[1], "x", "again")]
    target = [(i, t) for i, t in enumerate(PROSE[:9] + [None])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = resampling.importance_resample(docs, spark.createDataFrame(target, "k long, text string"), most_words=most_words, buckets=97, percent=30)
    bucket = lambda t: [zlib.crc32(p.encode()) % 97 for p in phrases(t, most_words)[1]]
    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(bucket(r[1]))
    for r in target:
        t.update(bucket(r[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)]
    want = []
    for d, text, *_ in rows:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        b, weight = bucket(text), sum(gain[x] for x in bucket(text))
        want.append([d, len(phrases(text, 1)[0]), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: 30 * len(fit) // 100]):
        r[5] = k + 1
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_importance_scores_keep_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "user", "clash")], SCHEMA).withColumns({"_weighed": F.lit("user"), "WEIGHT": F.lit("old")})
    none = docs.limit(0)
    out = resampling.importance_scores(docs, none)
    assert out.columns == ["doc_id", "text", "lang", "_weighed", "n_words", "n_features", "weight", "score"]
    assert (r := out.first()).lang == r._weighed == "user" and r.n_features == 2
    assert resampling.importance_resample(none, docs).count() == 0
    assert resampling.importance_resample(docs, none).first().rank is None


def test_crc_of_long_and_short_ranges():
    hashing = resampling.PhraseBuckets(1 << 31)
    words = [b"a", b"abc", b"x" * 47, b"x" * 48, b"x" * 49, b"y" * 5000]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert hashing.crc(data, np.r_[0, end[:-1]], end).tolist() == [zlib.crc32(w) for w in words]


# Suffix-array dedup


def removed(texts, window):
    """Covered bytes of each text, by all windows of all texts."""
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return raw, out


def letters(n, seed, of="ab"):
    r = random.Random(seed)
    return "".join(r.choice(of) for _ in range(n))


BASE = letters(300, 1, "abcdefgh é")
SUFFIX_TEXTS = {
    "few letters": [letters(R.randint(0, 60), i) for i in range(40)],
    "periods": ["a" * 50, "a" * 11, "ab" * 30, "abc" * 20, "ba" * 7 + "c" + "ba" * 9, None, "", "a" * 12, "\x00" * 30, "\x00" * 13 + "b"],
    "copies": [BASE, BASE, BASE[:100] + "#" + BASE[100:], BASE[50:200], "x" + BASE[150:170] + "y", BASE[:11], BASE[:12]] + [letters(30, 50 + i, "klmnop") + BASE[100:120] + letters(30, 90 + i, "qrstuv") for i in range(30)],
    "nested": [letters(8, i, "xyz") + "common core of it" + letters(8, i // 3, "uvw") for i in range(40)],
}


@pytest.mark.parametrize("name", sorted(SUFFIX_TEXTS))
@pytest.mark.parametrize("crowd", [4096, 3])
def test_suffix_dedup(spark, name, crowd):
    texts, window = SUFFIX_TEXTS[name], 12
    raw, gone = removed(texts, window)
    docs = spark.createDataFrame([(i % 25, t, f"user {i}", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = suffixes.suffix_dedup(docs, window=window, crowd=crowd).collect()
    assert len(got) == len(texts)
    for r in got:
        i = int(r.lang.split()[1])
        edge = np.flatnonzero(np.diff(np.r_[0, gone[i].astype(int), 0])).reshape(-1, 2)
        assert [(s.start, s.end) for s in r.spans] == [tuple(x) for x in edge.tolist()], (name, i)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[i]), int(gone[i].sum()), len(edge)) and r.n_words == "clash"
        assert bytes(r.kept_bytes) == bytes(np.frombuffer(raw[i], np.uint8)[~gone[i]])


@pytest.mark.parametrize("name", sorted(SUFFIX_TEXTS))
def test_repeat_groups(spark, name):
    """Groups are equal strings with all their occurrences in the table, and cover what is removed."""
    texts, window = SUFFIX_TEXTS[name], 12
    raw, gone = removed(texts, window)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    ids = {(r.d1, r.d2): r.doc_id for r in docs.select("doc_id", *[c.alias(n) for c, n in zip(suffixes.row_ids("doc_id", "text"), ("d1", "d2"), strict=True)]).collect()}
    groups, seen = collections.defaultdict(set), [np.zeros(len(b), bool) for b in raw]
    for r in suffixes.repeat_groups(docs, window=window).collect():
        d = ids[r.d1, r.d2]
        groups[r.repeat].add((d, r.start))
        seen[d][r.start : r.end] = True
        assert r.end - r.start == r.n_bytes >= window
        groups[r.repeat, "s"].add(raw[d][r.start : r.end])
    assert all(a.tolist() == b.tolist() for a, b in zip(seen, gone, strict=True))
    for k in [k for k in groups if isinstance(k, int)]:
        (s,) = groups[k, "s"]
        assert len(groups[k]) > 1
        assert groups[k] == {(d, i) for d, b in enumerate(raw) for i in range(len(b) - len(s) + 1) if b[i : i + len(s)] == s}


def test_suffix_dedup_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.suffix_dedup(none).count() == 0 and suffixes.repeat_groups(none).count() == 0


def test_intervals_are_those_of_the_definition():
    strings = sorted(letters(R.randint(0, 6), i).encode() for i in range(60))
    shared = suffixes.prefix_lengths(np.zeros(60, np.int64), strings)
    want = set()
    for a in range(60):
        for b in range(a + 1, 60):
            n = shared[a + 1 : b + 1].min()
            if shared[a] < n and shared[b + 1] < n:
                want.add((n, a, b))
    assert set(suffixes.intervals(shared)) == want


def test_anchors_do_not_hang_on_the_size_of_parts():
    texts = [letters(3000, 1, "abc"), "", letters(500, 2), letters(40, 3)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    one, other = (suffixes.Rolling(40, size=s).anchors(data, at) for s in (1 << 18, 64))
    key = lambda x: sorted(zip(*[c.tolist() for c in x[2:]], strict=True))
    assert key(one) == key(other) and sum((one[4] - one[2] + 1).tolist()) == sum(max(0, len(t) - 39) for t in texts)
    assert Words.BASE % 2


# Phrase mining


def mined(rows, least, most_words=4, keep_share=80, most=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {g: a for g, a in own.items() if a >= least}
        longer = collections.Counter()
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], a)
        found = []
        for g, a in often.items():
            if len(g) > 1 and not (longer[g] and 100 * longer[g] >= keep_share * a):
                score, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def speech(seed, n=40):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "é\u00a0x", "data", "set", "machine", "learning", "\x00z", "in"]
    return "".join(r.choice([*words, "new york city of", "machine learning data set"]) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(n))


SPEECH = [(i, speech(i), [None, "en", "und", "fr"][i % 4], "x") for i in range(60)] + [(None, None, "en", "x"), (1, "", "en", "x"), (2, " \t,.;\n", "de", "x"), (3, speech(3), "en", "x"), (3, speech(3), "en", "x"), (4, "lone " * 3000, "fr", "x"), (5, "y" * 5000 + " " + speech(9, 2000), "en", "x")]


@pytest.mark.parametrize(("shard", "bits", "most_words"), [(1_500_000, 1 << 26, 4), (300, 1 << 26, 4), (300, 64, 3), (300, 1 << 12, 2)])
def test_collocations(spark, monkeypatch, shard, bits, most_words):
    """Also with many small shards, and with a filter so small that it lets everything pass."""
    monkeypatch.setattr(mining, "SHARD_WORDS", shard)
    monkeypatch.setattr(mining, "MERGED_NODES", shard)
    monkeypatch.setattr(mining, "PIECE_NODES", shard // 10)
    monkeypatch.setattr(mining, "RANGE_NODES", shard // 5)
    monkeypatch.setattr(mining, "FILTER_BITS", bits)
    docs = spark.createDataFrame(SPEECH, SCHEMA).withColumns({c: F.lit("user") for c in ("w1", "a", "n", "word", "h", "phrase")}).repartition(5)
    got = mining.top_phrases(mining.collocations(docs, least=5, most_words=most_words), most=40, salts=3)
    want = mined(SPEECH, 5, most_words, most=40)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want
    assert len(want) > 50 and len({r[0] for r in want}) == 3


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mining.top_phrases(mining.collocations(none)).count() == 0
    few = spark.createDataFrame([(1, "only one pair", "en", "x")], SCHEMA)
    assert mining.collocations(few).count() == 0


def test_walk_over_range_edges(spark, monkeypatch):
    """Counts above the first node of a range come from an earlier range."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(400)), "en", "x") for i in range(8)]
    monkeypatch.setattr(mining, "RANGE_NODES", 10)
    got = mining.top_phrases(mining.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), least=3)).collect()
    assert sorted(tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in got) == mined(rows, 3)


def test_places_of_edges():
    rng = np.random.default_rng(3)
    sort = lambda x: x[:, np.lexsort(x[::-1])]
    path, edges = sort(rng.integers(0, 3, (4, 200))), sort(rng.integers(0, 3, (4, 9)))
    want = [sum(tuple(p) < tuple(e) for p in path.T.tolist()) for e in edges.T.tolist()]
    assert mining.places_of(edges, path).tolist() == want and mining.places_of(edges[:, :0], path).tolist() == []
