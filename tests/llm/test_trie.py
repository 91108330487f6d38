"""Prefix tries against a plain tree of dictionaries: bands, shards, hot prefixes, ties, nulls and long conversations."""

import hashlib
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import trie as T

TABLE = "CONV_ID string, conv_id long, turn long, role string, text string, a string, place int, n int"


def slow(rows, borrowed=6, stride=100):
    """The nodes of (conv_id, turn, role, text) rows by walking every rebuilt conversation."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members, last = {}, {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % borrowed
        lender = c - int(np.fmod(c, stride))
        path = tuple(turns.get(lender, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        last.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (min(c), len(p), min(members[p[:-1]]) if p else -1, len(c), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(last.get(p, [])))).encode()).hexdigest())
        for p, c in members.items()
    )


def run(spark, rows, **how):
    df = spark.createDataFrame([("x", c, t, r, x, "y", 7, 8) for c, t, r, x in rows], TABLE)
    got = T.prefix_trie(df, **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def some(rng, convs, most, words):
    return [
        (int(c), int(t) if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(words))
        for c in convs for t in range(rng.integers(1, most))
    ]


@pytest.mark.parametrize("how", [{}, {"deep": 8, "shard": 8}])
def test_nodes_equal_a_plain_tree(spark, how):
    rng = np.random.default_rng(len(how) * 10 + how.get("deep", 0))
    rows = some(rng, range(0, 240, 3), 9, ["a", "b", "", None, "longer text", "\U0001f600 x"])
    rows += [(c, t, "user", f"hello {t}") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(c, t, "user", f"hello {t}" if t < 5 else f"{c}") for c in range(340, 370) for t in range(7)]  # a hot prefix
    rows += [(700, t, "user", f"only {t % 3}") for t in range(23)] + [(705, t, "user", f"only {t % 3}") for t in range(23)]
    rows += [(None, 1, "user", "no conversation"), (800, None, None, None), (800, None, None, None), (-7, 1, "user", "minus")]
    rows += [rows[0]] * 3
    assert run(spark, rows, **how) == slow(rows)


def test_turnless_and_empty(spark):
    alone = [(c, 0, "user", "x") for c in range(1, 9)]  # of these some lend nothing and lose their only turn
    assert run(spark, alone) == slow(alone)
    only = [(c, 0, "user", "x") for c in range(1, 60) if crc32(str(c).encode()) % 6]
    assert run(spark, only) == slow(only) and len(slow(only)) == 1
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_wrong_sizes_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [], deep=3)
    with pytest.raises(ValueError):
        run(spark, [], deep=8, shard=4)


def test_double_array_holds_what_was_added():
    rng = np.random.default_rng(1)
    trie, kept = T.DoubleArray(2), {}
    states = [0, 1]
    for _ in range(40):
        parents = sorted({int(s) for s in rng.choice(states, 3)} - {p for p, _ in kept})
        pairs = [(p, int(t)) for p in parents for t in sorted(set(rng.integers(0, 500, rng.integers(1, 9)).tolist()))]
        if pairs:
            p, t = (np.array(x) for x in zip(*pairs, strict=True))
            trie.add(p, t)
            found = trie.step(p, t)
            assert (found >= 0).all()
            kept |= dict(zip(pairs, found.tolist(), strict=True))
            states += found.tolist()
    assert len(set(kept.values())) == len(kept)
    for state in states:
        found = trie.step(np.full(500, state), np.arange(500))
        assert {t: int(f) for t, f in enumerate(found) if f >= 0} == {t: f for (p, t), f in kept.items() if p == state}
