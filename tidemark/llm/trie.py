"""Prefix tries of conversations: double arrays per prefix shard, shared upper nodes merged over the whole table.

A node is a sequence of turns that a conversation starts with. Its key is 128 bits: the exclusive-or of the hashes
of (place, turn) along it. Distinct sequences are dealt to shards by a prefix that is long enough for a shard to
stay small; nodes below that prefix lie in one shard and are finished there, those on it are merged by key.
Conversations are cut into bands of DEEP turns, so that no sequence is held whole; the lowest band comes first and
hands what it adds up to to the ends of the band above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.order import in_order
from tidemark.llm.shared import pick, written

#: A conversation borrows crc32 % BORROWED first turns of the one whose id is a multiple of STRIDE.
BORROWED, STRIDE = 6, 100
#: Turns in a band, and in a shard (one sequence always fits); ids in a row while the ends of a node are joined.
DEEP, SHARD, CHUNK_BITS = 4096, 4096, 16
FREE, ROOT = -1, -2
PIECES = (
    "k1 long, k2 long, u1 long, u2 long, level int, depth long, shared boolean, n_convs long, conv_id long, parent long, size long, "
    "kids long, leaves long, saved long, up1 array<long>, up2 array<long>"
)


class DoubleArray:
    """A trie over dense turn ids: the child of state s by turn t is BASE[s] + t, if CHECK there is s."""

    def __init__(self, roots: int, capacity: int = 1024):
        self.base = np.zeros(max(capacity, roots), dtype=np.int64)
        self.check = np.full(max(capacity, roots), FREE, dtype=np.int64)
        self.check[:roots] = ROOT

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))
            self.check = np.concatenate((self.check, np.full(more, FREE, dtype=np.int64)))

    def add(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Children of states that have none yet: distinct (parent, turn) pairs, by parent, then turn."""
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        last = np.append(first[1:], len(parents))
        for i in sorted(np.flatnonzero(last - first > 1).tolist(), key=lambda i: first[i] - last[i]):
            self._fit(int(parents[first[i]]), turns[first[i] : last[i]])
        lone = first[last - first == 1]  # these fit anywhere
        self._reach(len(lone) + int((self.check != FREE).sum()))
        free = np.flatnonzero(self.check == FREE)[: len(lone)]
        self.base[parents[lone]] = free - turns[lone]
        self.check[free] = parents[lone]

    def _fit(self, parent: int, turns: np.ndarray, tries: int = 64) -> None:
        for start in [*np.flatnonzero(self.check == FREE)[:tries].tolist(), len(self.check)]:
            at = start - turns[0] + turns
            self._reach(int(at[-1]) + 1)
            if (self.check[at] == FREE).all():
                break
        self.base[parent] = start - turns[0]
        self.check[at] = parent

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of states by turns; -1 where there is none."""
        at = self.base[states] + turns
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def _flat(column: pd.Series, dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.asarray(x, dtype=dtype) for x in column]) if len(column) else np.zeros(0, dtype=dtype)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.empty(len(a), dtype=[("a", np.int64), ("b", np.int64)])
    pairs["a"], pairs["b"] = a, b
    return np.unique(pairs, return_inverse=True)[1]


def shard_nodes(pdf: pd.DataFrame, deep: int) -> pd.DataFrame:
    """The nodes of a shard's sequences, see PIECES.

    n_convs, kids, leaves and saved of a node that is not shared are final; of a shared one they are this shard's
    part, where the last three add up what lies below it in this shard alone, without itself.
    """
    count, sizes = len(pdf), np.array([len(x) for x in pdf["a"]])
    off = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    turns = _dense(_flat(pdf["a"]), _flat(pdf["b"]))
    start = _dense(pdf["p1"].to_numpy(), pdf["p2"].to_numpy())
    trie = DoubleArray(int(start.max()) + 1, 2 * len(turns) + 2)

    def levels(grow: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        state, alive, level = start.copy(), np.flatnonzero(sizes > 0), 0
        while len(alive):
            turn = turns[off[alive] + level]
            if grow:
                order = np.lexsort((turn, state[alive]))
                p, t = state[alive][order], turn[order]
                new = np.concatenate(([True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])))
                trie.add(p[new], t[new])
            state[alive] = trie.step(state[alive], turn)
            yield alive, state[alive]
            level += 1
            alive = alive[sizes[alive] > level]

    for _ in levels(grow=True):
        pass
    slots = len(trie.check)
    n, kids, leaves, saved = (np.zeros(slots, dtype=np.int64) for _ in range(4))
    least = np.full(slots, np.iinfo(np.int64).max)
    some, height = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    members, lowest = pdf["n"].to_numpy(), pdf["least"].to_numpy()
    steps = [start, *(s for _, s in levels(grow=False))]
    rows = [np.arange(count), *(r for r, _ in levels(grow=False))]
    for level, (row, state) in enumerate(zip(rows, steps, strict=True)):
        np.add.at(n, state, members[row])
        np.minimum.at(least, state, lowest[row])
        some[state], height[state] = row, level
    below, limit = pdf["tail_kids"].to_numpy(), pdf["s"].to_numpy()
    ends = np.flatnonzero(sizes == deep)
    if len(ends):
        last = steps[deep][np.searchsorted(rows[deep], ends)]
        kids[last], leaves[last], saved[last] = below[ends], pdf["tail_leaves"].to_numpy()[ends], pdf["tail_saved"].to_numpy()[ends]
    shared = height <= limit[some]
    size = np.concatenate((_flat(pdf["size"]), [0]))
    length = np.where(height > 0, size[np.minimum(off[some] + np.maximum(height, 1) - 1, len(size) - 1)], 0)
    nodes = [np.unique(s) for s in steps]
    for level in range(len(nodes) - 1, 0, -1):
        at = nodes[level][~shared[nodes[level]]]
        leaves[at] += kids[at] == 0
        saved[at] += (n[at] - 1) * length[at]
        for total, part in ((kids, np.ones(len(at), dtype=np.int64)), (leaves, leaves[at]), (saved, saved[at])):
            np.add.at(total, trie.check[at], part)

    at = np.concatenate(nodes)
    row, level = some[at], height[at]
    p = [pdf[c].to_numpy() for c in ("p1", "p2")]
    keys = []
    for x, own in zip(("x1", "x2"), p, strict=True):
        whole = np.concatenate(([0], np.bitwise_xor.accumulate(_flat(pdf[x]))))
        keys.append([own[r] ^ whole[off[r]] ^ whole[off[r] : off[r] + sizes[r] + 1] for r in range(count)])
    key = [np.array([k[r][d] for r, d in zip(row, level, strict=True)], dtype=np.int64) for k in keys]
    up = [[k[r][:d] if s else None for r, d, s in zip(row, level, shared[at], strict=True)] for k in keys]
    parent_key = [[int(k[r][d - 1]) if d else None for r, d in zip(row, level, strict=True)] for k in keys]
    over = np.where(level > 0, trie.check[at], at)
    band = pdf["band"].to_numpy()[row]
    door = (level == 0) & (band > 0)  # the start of a lower band is counted where it ends the band above
    known = (level > 0) & ~shared[over]
    whole = lambda values, there: pd.Series(values, dtype="Int64").where(there)
    return pd.DataFrame({
        "k1": key[0], "k2": key[1], "u1": pd.Series(parent_key[0], dtype="Int64"), "u2": pd.Series(parent_key[1], dtype="Int64"),
        "level": level.astype(np.int32), "depth": band * deep + level, "shared": shared[at], "n_convs": np.where(door, 0, n[at]),
        "conv_id": whole(least[at], ~door), "parent": whole(least[over], known), "size": length[at],
        "kids": kids[at], "leaves": leaves[at], "saved": saved[at], "up1": up[0], "up2": up[1],
    })


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b (128 bits of role and text) and size (code points) of every turn."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")}).withColumns({
        "a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "text", "role"), "size": F.char_length("text").cast("long"),
    })
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = in_order(rows, order, "turns", ["conv_id", "a", "b", "size"])
    first = rows.groupBy("conv_id").agg(F.min("__at").alias("first"))
    return rows.join(first, "conv_id").withColumn("place", F.col("__at") - F.col("first") + 1).drop("__at", "first")


def rebuilt(turns: DataFrame, borrowed: int = BORROWED, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """The ids of all conversations, and conv_id, place, a, b, size of their turns after the exchange of heads."""
    code = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": code % borrowed, "lender": F.col("conv_id") - F.col("conv_id") % stride,
    })
    convs = written(convs, "conversations")
    lenders = convs.where("conv_id = lender").select("lender", F.col("n").alias("has"))
    convs = convs.join(lenders, "lender", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("place > h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("head")).drop("h", "head")
    lent = turns.where((F.col("conv_id") % stride == 0) & (F.col("place") < borrowed)).withColumnRenamed("conv_id", "lender")
    heads = convs.select("conv_id", "lender", "head").join(lent, "lender").where("place <= head")
    return convs.select("conv_id"), own.unionByName(heads.select(*own.columns))


def bands_of(turns: DataFrame, deep: int) -> DataFrame:
    """conv_id, band, the turns of the band (a, b, x1, x2, size), its key e1, e2 and that of all before it p1, p2."""
    hashed = turns.withColumns({"x1": F.xxhash64(F.lit(3), "place", "a", "b"), "x2": F.xxhash64(F.lit(4), "place", "b", "a")})
    band = F.floor((F.col("place") - 1) / deep).cast("long").alias("band")
    columns = ("a", "b", "x1", "x2", "size")
    rows = hashed.groupBy("conv_id", band).agg(
        F.array_sort(F.collect_list(F.struct("place", *columns))).alias("path"), F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2")
    )
    rows = written(rows.select("conv_id", "band", *[F.col(f"path.{c}").alias(c) for c in columns], "e1", "e2"), "bands")
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.select("conv_id", "band", "e1", "e2")
    parts = parts.join(parts.where("band = 1").select("conv_id"), "conv_id", "left_semi")  # longer than a band
    starts = parts.select("conv_id", "band", *[F.bit_xor(f"e{i}").over(before).alias(f"p{i}") for i in (1, 2)]).where("band > 0")
    first = rows.where("band = 0").withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    return first.unionByName(rows.where("band > 0").join(starts, ["conv_id", "band"]))


def key_at(place: Column) -> list[Column]:
    """The key of a sequence's first turns."""
    x = lambda i: F.aggregate(F.slice(f"x{i}", 1, place), F.col(f"p{i}"), lambda k, v: k.bitwiseXOR(v))
    return [x(1), x(2)]


def sharded(bands: DataFrame, shard: int, deep: int) -> DataFrame:
    """The distinct sequences with n (conversations), least (conv_id), s (turns that name the shard) and shard.

    s is the first of 1, 2, 4, ... at which the sequences that agree so far have no more than `shard` turns together;
    it is the same for all sequences that agree further, so nodes deeper than s lie in one shard.
    """
    same = ("p1", "p2", "band", "a", "b", "x1", "x2", "size")
    paths = bands.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    paths = written(paths.withColumn("id", F.monotonically_increasing_id()).withColumn("turns", F.size("a").cast("long")), "paths")
    ladder = F.array(*[F.lit(1 << i) for i in range(deep.bit_length())])
    rungs = paths.withColumn("t", F.explode(F.filter(ladder, lambda t: t <= F.col("turns"))))
    k1, k2 = key_at(F.col("t"))
    rungs = rungs.select("id", "t", "turns", k1.alias("k1"), k2.alias("k2"))
    heavy = rungs.groupBy("t", "k1", "k2").agg(F.sum("turns").alias("all")).where(F.col("all") > shard).drop("all")
    least = rungs.join(heavy, ["t", "k1", "k2"]).groupBy("id").agg((2 * F.max("t")).alias("s"))
    shards = max(1, -(-(paths.agg(F.sum("turns")).head()[0] or 0) // shard))
    paths = paths.join(least, "id", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    name = F.xxhash64(*key_at(F.least(F.col("s"), F.col("turns").cast("int"))))
    return written(paths.withColumn("shard", F.pmod(name, F.lit(shards))).drop("id", "turns"), "shards")


def merged(pieces: DataFrame) -> DataFrame:
    """Shared nodes, each once, with what lies below them in all shards: PIECES without up1 and up2."""
    key = ["k1", "k2"]
    same = [F.first(c).alias(c) for c in ("u1", "u2", "level", "depth", "size", "up1", "up2")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "kids", "leaves", "saved")]
    nodes = pieces.groupBy(*key).agg(*same, *sums, F.min("conv_id").alias("conv_id"))
    nodes = written(nodes, "shared-nodes")
    under = nodes.where("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(under, key, "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    own = F.col("conv_id").isNotNull()
    parts = nodes.select(
        F.explode(F.arrays_zip(F.concat("up1", F.array("k1")).alias("k1"), F.concat("up2", F.array("k2")).alias("k2"))).alias("to"),
        (F.col("leaves") + F.when(own & (F.col("kids") == 0), 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + F.when(own, (F.col("n_convs") - 1) * F.col("size")).otherwise(0)).alias("saved"),
    )
    totals = parts.groupBy(F.col("to.k1").alias("k1"), F.col("to.k2").alias("k2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return nodes.drop("up1", "up2", "leaves", "saved").join(totals, key)


def ends_of(convs: DataFrame, bands: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of every node at which a conversation ends.

    The ids are joined by ranges of CHUNK_BITS bits first; a node's ranges are then hashed one after the other, in
    their order, so that the ids of a hot node are never held together.
    """
    last = bands.groupBy("conv_id").agg(F.bit_xor("e1").alias("k1"), F.bit_xor("e2").alias("k2"))
    zero = F.lit(0).cast("long")
    rows = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    rows = rows.groupBy("k1", "k2", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
                if now == (k1, k2):
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    rows = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return rows.mapInPandas(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, borrowed: int = BORROWED, stride: int = STRIDE, shard: int = SHARD, deep: int = DEEP
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns go by turn, null first, then by role and text; a null role or text counts as empty. Rows with a null
    conv_id belong to no conversation. Repeated rows are turns of their own. Of a negative conv_id the remainder
    keeps the sign. An empty table gives no node; other columns are ignored. shard must be at least deep, and deep
    a power of two.
    """
    if shard < deep or deep & (deep - 1):
        raise ValueError("shard must be at least deep, and deep a power of two")
    convs, turns = rebuilt(written(turns_of(conversations), "turn-places"), borrowed, stride)
    bands = written(bands_of(turns, deep), "band-keys")
    paths = sharded(bands, shard, deep)
    last = bands.agg(F.max("band")).head()[0]
    kinds = ("tail_kids", "tail_leaves", "tail_saved")
    tails, found = None, []
    run = lambda pdf: shard_nodes(pdf, deep)
    zeros = {c: F.lit(0).cast("long") for c in kinds}
    for band in range(last if last is not None else -1, -1, -1):
        rows = paths.where(F.col("band") == band)
        if tails is None:
            rows = rows.withColumns(zeros)
        else:
            k1, k2 = key_at(F.size("a"))
            rows = rows.withColumns({"k1": k1, "k2": k2}).join(tails, ["k1", "k2"], "left").drop("k1", "k2").fillna(0, list(kinds))
        pieces = written(rows.groupBy("shard").applyInPandas(run, PIECES), "pieces")
        upper = pieces.where("shared")
        if not band:
            upper = upper.unionByName(_turnless(convs, bands, pieces))
        upper = written(merged(upper), "merged")
        tails = upper.where("conv_id is null").select("k1", "k2", *[F.col(c.removeprefix("tail_")).alias(c) for c in kinds])
        upper = upper.where("conv_id is not null").withColumn("parent", F.lit(None).cast("long")).withColumn("shared", F.lit(True))
        found.append(pieces.where("not shared").drop("up1", "up2").unionByName(upper.select(*pieces.drop("up1", "up2").columns)))
    if not found:
        found = [written(merged(_turnless(convs, bands, None)), "merged").withColumns({"parent": F.lit(None).cast("long"), "shared": F.lit(True)})]
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    above = nodes.where(F.col("shared") | (F.col("level") == deep)).select(
        F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("above")
    )
    known = nodes.where("parent is not null").withColumn("above", F.col("parent"))
    rest = nodes.where("parent is null").join(above, ["u1", "u2"], "left").select(*known.columns)
    out = known.unionByName(rest).join(ends_of(convs, bands), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _turnless(convs: DataFrame, bands: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """Conversations without turns as one more part of the root; no row if there is none."""
    rows = convs.join(bands.where("band = 0").select("conv_id"), "conv_id", "left_anti")
    rows = rows.groupBy(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = rows.withColumns({
        "u1": none, "u2": none, "level": F.lit(0), "depth": zero, "shared": F.lit(True), "parent": none, "size": zero, "kids": zero,
        "leaves": zero, "saved": zero, "up1": F.array().cast("array<long>"), "up2": F.array().cast("array<long>"),
    })
    return rows.select(*[c.split()[0] for c in PIECES.split(", ")])


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
