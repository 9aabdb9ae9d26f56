"""Resampling against a plain version; the query against DuckDB is in test_oracles."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from fixtures_llm import PROSE, SF, TEXTS, empty_docs, odd_docs, rows, table

from netspark.llm import resampling
from netspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, ngrams):
    words = WORD.findall(lowered(text))
    return words, [" ".join(words[i:i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, settings):
    """(key, n_words, n_features, weight, score, rank) of (key, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % settings.buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, settings.ngrams)[1]) for texts in ([t for _, t in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + settings.buckets) / ((s[b] + 1) * (T + settings.buckets)))) for b in s}
    out = []
    for key, text in docs:
        words, found = features(text, settings.ngrams)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= settings.least_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for i, r in enumerate(fit[:settings.percent * len(fit) // 100]):
        r[5] = i + 1
    return out


def as_rows(df):
    return sorted((str(list(r.values())) for r in rows(df)))


@pytest.mark.parametrize("settings", [resampling.Settings(percent=50, least_words=2), resampling.Settings(ngrams=3, buckets=97, percent=100, least_words=0, seed=7),
                                      resampling.Settings(ngrams=2, percent=0)])
def test_odd_rows(spark, settings):
    target = [PROSE, None, "", "Wizards MIX potions", PROSE]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = as_rows(resampling.resample(odd_docs(spark), bench, settings))
    assert got == sorted(map(str, plain([(i, t) for i, t, _ in TEXTS], target, settings)))


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "text string")
    assert rows(resampling.resample(empty_docs(spark), bench)) == []
    settings = resampling.Settings(percent=100, least_words=1)
    assert as_rows(resampling.resample(odd_docs(spark), bench, settings)) == sorted(map(str, plain([(i, t) for i, t, _ in TEXTS], [], settings)))


def test_words_offsets_and_stretches(monkeypatch):
    split = resampling.splitter()
    texts = ["", "ÀB c1_d\x00é\x85x ", "é" * 40, "a" * 50 + " b", " ".join(f"w{i}é" for i in range(50)), "..a..b..", "\x7f~Z"]
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(resampling, "STRETCH", size)
        for text in texts:
            words, offsets = resampling.words_of(split, text)
            low = lowered(text)
            data = [w.encode("latin-1") for w in words]
            assert [d.decode() for d in data] == WORD.findall(low) and data == [low.encode()[a:b] for a, b in offsets]


def test_query_against_the_plain_version(spark):
    docs, target = [(r["doc_id"], r["text"]) for r in table("documents")], [r["text"] for r in table("benchmark")]
    want = [[r[0], *r[2:]] for r in plain(docs, target, resampling.Settings())]
    assert as_rows(QUERIES["op12_importance_resampling"](spark, SF)) == sorted(map(str, want))
