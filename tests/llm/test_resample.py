"""Importance resampling against plain counting, with n-grams over line ends, hot lines, nulls and ties."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import resample as R

DOCS = "doc_id long, text string, TEXT string, row string, digest string, weight string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def slow(docs, target, most, buckets, least=20, percent=10):
    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        words, found = features(text, most)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, weight + noise, len(words)])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = len(able) * percent // 100
    ranks = {id(x): i + 1 for i, x in enumerate(able[:drawn])}
    return sorted((str(x[0]), *x[1:4], ranks.get(id(x), 0)) for x in out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_equals_plain_counting(spark, most):
    rng = np.random.default_rng(most)
    words = ["Alpha", "be-ta", "café", "d4", "x_y", "日本", "THE", "a", " ", "\x85z", "q\rr", "..."]
    hot = "This very line stands in every text"

    def text():
        lines = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 6))]
        return "\n".join([*lines, hot, "", hot][: rng.integers(1, 9)])

    docs = [(i, text()) for i in range(150)] + [(None, text()), (900, None), (901, ""), (902, "\n\n"), (903, "one")]
    docs += [(5, "again and " * 20)] * 4 + [(None, "again and " * 20)]
    target = [text() for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(*d, "x", "y", "z", "w") for d in docs], DOCS).repartition(3)
    aim = spark.createDataFrame([(x, "t") for x in target], "text string, item string")
    got = R.resample(df, aim, most_words=most, buckets=97, percent=30)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    got = sorted((str(r[0]), *r[1:4], r[4] or 0) for r in got.collect())
    assert got == slow(docs, target, most, 97, percent=30)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).collect() == []
    got = R.resample(spark.createDataFrame([(1, "a b " * 10)], none.schema), none, percent=100).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in got] == [(1, 20, 1)]


def test_one_long_text(spark):
    docs = [(1, "long words here " * 40_000), (2, "short")]
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("long",)], "text string"), percent=100)
    assert sorted((str(r[0]), *r[1:4], r[4] or 0) for r in got.collect()) == slow(docs, ["long"], 1, 10_000, percent=100)
