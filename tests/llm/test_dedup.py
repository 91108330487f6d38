"""Exact dedup, SimHash near-dedup and components against brute force, with nulls, ties and clashing names."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as E
from tidemark.llm import simhash as S
from tidemark.llm.components import components

DOCS = "doc_id long, text string, TEXT string, chunk string, fp string, row string"


def rows(*pairs):
    return [(i, t, "x", "y", "z", "w") for i, t in pairs]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_exact_dedup_against_normalised_texts(spark):
    long = " ".join(f"word{i}" for i in range(4000))
    given = rows((5, "a  b"), (3, "a\tb"), (3, "a b"), (None, "a b"), (9, None), (8, ""), (7, " "), (6, long), (4, long + " "),
                 (2, long.replace(" ", "\n")), (None, "only"), (None, "only"))
    got = E.dedup(spark.createDataFrame(given, DOCS)).collect()
    assert len(got) == len(given)
    groups = {}
    for r in given:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    by_size = sorted((len(v), min((x for x in v if x is not None), default=-1)) for v in groups.values() for _ in v)
    assert sorted((r.group_size, -1 if r.keep_id is None else r.keep_id) for r in got) == by_size
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_cover_the_text_and_shift(spark):
    text = " ".join(f"some{i % 37}d word{i * i}" for i in range(3000))
    df = spark.createDataFrame([(text,), ("start " + text,), ("x" * 9000,), ("",)], "text string")
    cut = [r[0] for r in df.select(E.chunks_of(E.normalised(df["text"]))).collect()]
    assert ["".join(c) for c in cut] == [text, "start " + text, "x" * 9000, ""]
    assert len(set(cut[0]) & set(cut[1])) > len(cut[0]) - 3
    assert max(len(x) for c in cut for x in c) <= E.LONGEST


def test_identifiers_of_two_chunks_are_found(spark):
    df = spark.createDataFrame([("a b",), ("c d",), ("a  b",), (None,)], "text string")
    first_letter = lambda chunk, seed: F.unhex(F.lit("00")) if seed < 2 else E.chunk_id(chunk, seed)
    assert E.verified_seed(df) == 0 and E.verified_seed(df, identify=first_letter) == 2
    with pytest.raises(ValueError):
        E.verified_seed(df, identify=first_letter, most=2)
    assert sorted(r.chunk for r in E.chunk_table(df).collect()) == ["a b", "c d"]


def test_keep_first_keeps_columns_and_one_of_repeated_rows(spark):
    given = rows((1, "a b"), (1, "a b"), (2, "a  b"), (3, "c"), (None, "c"), (None, None), (None, ""))
    kept = E.keep_first(spark.createDataFrame(given, DOCS))
    assert kept.columns == ["doc_id", "text", "TEXT", "chunk", "fp", "row"]
    got = [tuple(r)[:2] for r in kept.collect()]
    assert sorted((str(i), (t or "").strip()) for i, t in got) == [("1", "a b"), ("3", "c"), ("None", "")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert E.dedup(none).count() == E.keep_first(none).count() == 0
    assert S.near_duplicates(none).count() == S.keep_one(none).count() == 0


@pytest.mark.parametrize("text", ["", None, "a", "a b", "A  b\nC d", " \x1c a", "É x ß y 日", "x " * 70_000])
def test_fingerprint(text):
    assert S.fingerprint(text or "") == slow_fingerprint(text)


def test_near_counts_hold_each_difference_once():
    near = S.near_counts(2)
    assert near[0] == (0, 0, 0, 0) and len(near) == 21
    assert all(tuple(-x for x in d) not in near for d in near[1:])


def test_links_join_what_is_near():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    x = np.unique(np.concatenate([x, x[:99] ^ np.uint64(5), x[:50] ^ np.uint64(1 << 40)]))
    a, b = S.links_within(x, x, 2)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    assert roots(x, [(p, q) for p, q in zip(a, b, strict=True)]) == roots(x, [(x[i], x[j]) for i, j in zip(*np.nonzero(near), strict=True)])


def roots(nodes, links):
    up = {int(n): int(n) for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        p, q = root(int(a)), root(int(b))
        up[max(p, q)] = min(p, q)
    return {n: root(n) for n in up}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, rng.integers(1, 400))) for _ in range(60)]
    texts = base + [t + " end" for t in base] + [t.replace("w1", "w2", 1) for t in base] + ["", None, "   ", base[0].upper()]
    given = [(None if i == 7 else 1000 - i, t) for i, t in enumerate(texts)] + [(1000, texts[0])]
    got = S.near_duplicates(spark.createDataFrame(rows(*given), DOCS)).collect()
    assert len(got) == len(given)
    prints = [slow_fingerprint(t) for _, t in given]
    up = roots(range(len(given)), [(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2])
    least = {}
    for i, (doc_id, _) in enumerate(given):
        if doc_id is not None:
            least[up[i]] = min(least.get(up[i], doc_id), doc_id)
    want = sorted((str(d), prints[i], str(least.get(up[i]))) for i, (d, _) in enumerate(given))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == want
    kept = S.keep_one(spark.createDataFrame(rows(*given), DOCS)).collect()
    keys = {(r.doc_id, r.text) for r in kept}
    assert {d for d, _ in keys} == {d for d in least.values()} | ({None} if up[7] not in least else set())


def test_a_large_tile_is_split(spark):
    prints = [(int(x),) for x in np.unique(np.random.default_rng(5).integers(0, 1 << 12, 900))]
    df = spark.createDataFrame(prints, "fp long")
    assert S.tiles(df, 16).selectExpr("max(size(prints))").first()[0] < 64
    got = {r.node: r.root for r in components(S.links(df, 2, 16)).collect()}
    nodes = [p for p, in prints]
    want = roots(nodes, [(p, q) for p in nodes for q in nodes if (p ^ q).bit_count() <= 2])
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_chains_hubs_loops_and_nulls(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(3, 3), (None, 4), (700, 701), (701, 700)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 560)} | {700: 700, 701: 700}
