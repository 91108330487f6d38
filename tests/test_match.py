"""Pruned block matching against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import similarity as M
from tidemark.operators import match, simjoin

WORDS = ["order", "orders", "customer", "custom", "price", "unit price", "prices", "region", "religion", "tide", "diet", "a", "email"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def noise(rng, n):
    return "".join(rng.choice("abcd_ é") for _ in range(rng.randint(1, n)))


def test_lcs_against_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = noise(rng, 30), noise(rng, 30)
        assert M.lcs_length(a, b) == lcs(a, b)


def test_indel_values():
    assert M.indel_ratio("", "x") == 0.0
    assert M.indel_ratio("abcd", "abed") == 0.75
    assert M.indel_ratio("abc", "abcd") == 0.86


def test_matcher_is_not_symmetric():
    assert M.matcher_ratio("tide", "diet") == 0.25
    assert M.matcher_ratio("diet", "tide") == 0.5


def test_bounds_hold():
    rng = random.Random(5)
    a, b = [noise(rng, 12) for _ in range(40)], [noise(rng, 12) for _ in range(40)]
    bound = M.multiset_bounds(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert M.matcher_ratio(x, y) <= bound[i, j] + 1e-12
            assert M.indel_ratio(x, y) <= bound[i, j] + 0.005


def test_native_bounds_hold(spark):
    rng = random.Random(6)
    rows = [(noise(rng, 12), noise(rng, 12)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", M.length_bound(F.col("a"), F.col("b")).alias("lb"), M.indel_bound(F.col("a"), F.col("b")).alias("ib"))
    for r in df.collect():
        assert M.matcher_ratio(r["a"], r["b"]) <= r["lb"] + 1e-12
        assert M.indel_ratio(r["a"], r["b"]) <= min(r["ib"], r["lb"] + 0.005) + 1e-12


def test_score_pairs(spark):
    df = spark.createDataFrame([("Tide", "diet"), ("tide", "DIET"), (None, "x")], "a string, b string")
    got = [r["score"] for r in M.score_pairs(df, "a", "b").orderBy(F.col("a").desc_nulls_last()).collect()]
    assert sorted(got, key=str) == [0.25, 0.25, None]


@pytest.mark.parametrize("kernel,floor,k", [("matcher", 0.3, 3), ("indel", 0.5, 2), ("indel", 0.6, 10)])
def test_fuzzy_topk(spark, kernel, floor, k):
    rng = random.Random(8)
    texts = WORDS + [noise(rng, 10) for _ in range(20)]
    # a third of all objects look the same
    objects = [(i, ["order"] if i % 3 == 0 else [rng.choice(WORDS), noise(rng, 8)]) for i in range(90)]
    got = match.fuzzy_topk(
        spark.createDataFrame([(x,) for x in texts], "q string"),
        spark.createDataFrame(objects, "object_id bigint, terms array<string>").select("object_id", F.array_sort(F.array_distinct("terms")).alias("terms")),
        k, floor, kernel)
    fn = M.KERNELS[kernel]
    want = set()
    for q in set(texts):
        scored = sorted((-max(fn(q, s) for s in t), i) for i, t in objects)
        want |= {(q, i, round(-s, 9)) for s, i in [x for x in scored if -x[0] > floor][:k]}
    assert {(r["q"], r["object_id"], round(r["score"], 9)) for r in got.collect()} == want


def brute(entity, kind, objects):
    out = []
    for typ, oid, name, terms, desc in objects:
        targets = rules.SEARCH_TARGETS.get(kind, rules.SEARCH_TARGETS_OTHER)
        if typ not in targets:
            continue
        name = name.lower()
        exact = 1.0 if entity == name or entity in terms else 0.0
        fuzzy = max(SequenceMatcher(None, entity, s).ratio() for s in [name, *terms])
        partial = 0.8 if entity in name or name in entity else 0.0
        if any(entity in s or s in entity for s in terms):
            partial = max(partial, 0.7)
        described = 0.6 if desc and entity in desc else 0.0
        top = exact or (fuzzy if fuzzy > partial else partial if partial > described else described)
        if top > 0.3:
            out.append((-round(top, 9), targets.index(typ), oid, typ))
    return [(typ, oid, -s) for s, _, oid, typ in sorted(out)[:20]]


def test_match_candidates(spark):
    rng = random.Random(11)
    objects = []
    for i in range(120):
        name = rng.choice(WORDS).replace(" ", "_") + ("" if i % 2 else f"_{rng.choice(WORDS)}")
        terms = sorted({name, name.replace("_", " "), name.replace("_", "")})
        objects.append((["table", "column", "dictionary_entry"][i % 3], i, name, terms, "the unit price of an order" if i % 4 == 0 else ""))
    entities = [(w, k) for w in WORDS for k in ("table", "column", "value", "business_term", "other")]
    got = match.match_candidates(
        spark.createDataFrame(entities, "entity string, entity_type string"),
        spark.createDataFrame(objects, "object_type string, object_id bigint, name string, terms array<string>, description string")).collect()
    for e, k in entities:
        mine = [(r["object_type"], r["object_id"], round(r["max_score"], 9)) for r in sorted(got, key=lambda r: r["rank"]) if (r["q"], r["kind"]) == (e, k)]
        assert mine == [(a, b, round(c, 9)) for a, b, c in brute(e, k, objects)], (e, k)


def test_dictionary_search(spark):
    entries = spark.createDataFrame(
        [(1, "Order", ["purchase"], None, "approved"), (2, "Orders", None, ["ord"], "draft"), (3, "Order", None, None, "archived")],
        "entry_id bigint, term string, synonyms array<string>, abbreviations array<string>, status string")
    q = spark.createDataFrame([(" ORD ",)], "query string")
    got = {r["entry_id"]: (round(r["score"], 4), r["match_type"]) for r in match.dictionary_search(q, entries).collect()}
    assert got == {2: (1.0, "exact"), 1: (0.75, "fuzzy")}


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.85])
def test_prefix_filter_loses_no_pair(spark, floor):
    rng = random.Random(int(floor * 100))
    texts = sorted({noise(rng, 14) for _ in range(60)} | set(WORDS) | {""})
    strings = sorted({noise(rng, 14) for _ in range(150)} | set(WORDS) | {"aaaa", "aaaaaaaaaaaa", "", "x"})
    q, s = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("q", texts), ("s", strings)))
    for kernel, fn in M.KERNELS.items():
        got = {(r["q"], r["s"]): r["score"] for r in simjoin.ratio_join(q, s, floor, kernel).collect()}
        assert got == {(a, b): fn(a, b) for a in texts for b in strings if a and b and fn(a, b) > floor}


def test_parts_of_strings(spark):
    rng = random.Random(4)
    texts = sorted({noise(rng, 6) for _ in range(80)})
    strings = sorted({noise(rng, 9) for _ in range(120)} | {""})
    q, s = (spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("q", texts), ("s", strings)))
    pairs = lambda df: sorted((r["q"], r["s"]) for r in df.collect())
    assert pairs(simjoin.containing(q, s)) == sorted((a, b) for a in texts for b in strings if a in b)
    assert pairs(simjoin.contained(q, s)) == sorted((a, b) for a in texts for b in strings if b in a)


def test_no_blocks_are_copied(spark, capsys):
    q = spark.createDataFrame([("order",)], "q string")
    o = spark.createDataFrame([(1, ["orders"])], "object_id bigint, terms array<string>")
    match.fuzzy_topk(q, o, 3, 0.5).explain()
    plan = capsys.readouterr().out
    assert "CoGroups" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranking_sees_all_candidates(spark):
    """Thirty objects with the best single score, and one that the weights put first."""
    objects = [("column", i, "price", ["price", f"price {i}"], "") for i in range(30)]
    objects.append(("column", 99, "price", ["price"], "the price of an order"))
    df = spark.createDataFrame(objects, "object_type string, object_id bigint, name string, terms array<string>, description string")
    e = spark.createDataFrame([(1, "price", "column", 0.3)], "entity_id bigint, entity string, entity_type string, confidence double")
    first = lambda k: [r["target_id"] for r in match.rank_mappings(e, match.match_candidates(e, df, k), 0.0)[0].collect()]
    assert first(None) == [99] and first(20) == [0]
