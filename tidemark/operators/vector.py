"""Vectors: norms, similarity, exact and approximate nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.blocks import BLOCK_ROWS, block_topk, keep_topk

ROUNDING = 1e-6  # scores have six decimals
METRICS = ("cosine", "l2", "dot")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def euclidean(a, b) -> Column:
    sq = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def similarity(a, b, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "euclidean":
        return 1.0 / (1.0 + euclidean(a, b))
    if metric == "dot":
        return dot(a, b)
    raise ValueError(f"unsupported similarity metric: {metric}")


def embed_norms(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.withColumns({"norm": F.round(norm(vector), 3), "dimension": F.size(vector)})


def _matrix(col: pd.Series, unit: bool) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in col])
    if unit:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = m / n
    return m


def _scorer(k: int, metric: str, min_score: float | None, exclude_self: bool, block_rows: int = BLOCK_ROWS):
    """Best ``k`` of every query; ``block_rows`` of each side are scored at once, which bounds the memory.

    Scores are ranked on six decimals, ties by id, so that the same rows win everywhere. Only what reaches the
    k-th best score of the pieces before it is rounded and ranked.
    """
    floor = -np.inf if min_score is None else min_score

    def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "l2":
            d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)
            return 1.0 / (1.0 + np.sqrt(d2))
        return a @ b.T

    def best(a: np.ndarray, qids: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kth = np.full(len(qids), floor)
        held = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        for at in range(0, len(ids), block_rows):
            s = scores(a, b[at:at + block_rows])
            if exclude_self:
                s[qids[:, None] == ids[None, at:at + block_rows]] = np.nan
            cut = kth - ROUNDING
            if at == 0 and s.shape[1] > k:
                # a score that is no number ranks below all
                cut = np.maximum(cut, np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k] - ROUNDING)
            rows, cols = np.nonzero(s >= cut[:, None])
            found = np.round(s[rows, cols], 6)
            live = found >= floor
            if not live.any():
                continue
            rows, cols, found = (np.concatenate([x, y[live]]) for x, y in zip(held, (rows, cols + at, found)))
            order = np.lexsort((cols, -found, rows))
            rows, cols, found = rows[order], cols[order], found[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = rank == k - 1
            kth[rows[last]] = found[last]
            held = rows[rank < k], cols[rank < k], found[rank < k]
        return held

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(q["qv"], metric == "cosine"), _matrix(c["cv"], metric == "cosine")
        qids, ids = q["qid"].to_numpy(), c["cid"].to_numpy()
        order = np.argsort(ids, kind="stable")
        b, ids = b[order], ids[order]
        out = []
        for at in range(0, len(qids), block_rows):
            some = qids[at:at + block_rows]
            rows, cols, found = best(a[at:at + block_rows], some, b, ids)
            out.append(pd.DataFrame({"qid": some[rows], "cid": ids[cols], "score": found}))
        return pd.concat(out, ignore_index=True)

    return score


def _pruner(k: int):
    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["score", "cid"], ascending=[False, True], kind="stable").groupby("qid", sort=False).head(k)

    return prune


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has no null in it; the others cannot be scored."""
    return df.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull()))


def topk(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine",
         min_score: float | None = None, exclude_self: bool = False, **block_sizes) -> DataFrame:
    """Exact nearest neighbours. ``queries``: qid, qv; ``corpus``: cid, cv. Gives qid, cid, score, rank.

    Rows with a null vector are left out. ``small_queries=True`` says that the queries fit a broadcast.

    ``l2`` orders by distance, nearest first, with score 1/(1+d).
    """
    if metric not in METRICS:
        raise ValueError(f"unsupported similarity metric: {metric}")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"
    left, right = usable(queries.select("qid", "qv"), "qv"), usable(corpus.select("cid", "cv"), "cv")
    local = block_topk(left, right, "qid", "cid",
                       _scorer(k, metric, min_score, exclude_self, block_sizes.get("block_rows", BLOCK_ROWS)), schema, _pruner(k), **block_sizes)
    return keep_topk(local, ["qid"], [F.desc("score"), F.col("cid")], k)


def train_cells(corpus: DataFrame, n_cells: int, seed: int = 7) -> np.ndarray:
    """Cell centres by distributed k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = corpus.select(array_to_vector(l2_normalize("cv")).alias("features")).where("features IS NOT NULL")
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(data)
    return np.array(model.clusterCenters())


def assign_cells(df: DataFrame, vector: str, centres: np.ndarray, n: int = 1) -> DataFrame:
    """Add one row per nearest cell (``n`` of them), as column ``cell``. The centres travel once per executor."""
    held = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        # the nearest centre to v has the largest v.c - |c|^2 / 2: means of unit vectors are shorter than 1
        s = _matrix(v, True) @ held.value.T - 0.5 * (held.value**2).sum(axis=1)
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :n].astype("int32")))

    return df.withColumn("cell", F.explode(nearest(vector)))


def cell_meetings(left: DataFrame, right: DataFrame, score, schema: str, block_rows: int) -> DataFrame:
    """``score(left part, right part)`` for all parts of both sides that share a cell.

    A side of a cell has as many parts, by a hash of the id, as its own count asks for. ``left``: qid, cell;
    ``right``: cid, cell. Only the counts per cell come to the driver.
    """
    def parts(df: DataFrame):
        counts = {r["cell"]: -(-r["count"] // block_rows) for r in df.groupBy("cell").count().collect()}
        table = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]) if counts else F.create_map().cast("map<int,int>")
        return F.coalesce(table[F.col("cell")].cast("int"), F.lit(1))

    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_left, of_right = parts(left), parts(right)
    left = left.withColumn("lp", own("qid", of_left)).withColumn("rp", every(of_right))
    right = right.withColumn("rp", own("cid", of_right)).withColumn("lp", every(of_left))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame() if a.empty or b.empty else score(a, b)

    keys = ["cell", "lp", "rp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def ivf_topk(queries: DataFrame, corpus: DataFrame, centres: np.ndarray, k: int = 10, n_probe: int = 10,
             block_rows: int = 20000) -> DataFrame:
    """Approximate cosine neighbours: score only the ``n_probe`` nearest cells of each query; all cells are exact.

    Both sides of a cell are split by a hash of the id into as many parts as their own counts ask for, so a
    cell with a third of the corpus or of the queries is scored on many tasks, none with more than about
    ``block_rows`` rows of a side. Only the counts per cell come to the driver.
    """
    queries, corpus = usable(queries, "qv"), usable(corpus, "cv")
    right = assign_cells(corpus.select("cid", "cv"), "cv", centres)
    left = assign_cells(queries.select("qid", "qv"), "qv", centres, n_probe)

    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"
    local = cell_meetings(left, right, _scorer(k, "cosine", None, False), schema, block_rows)
    return keep_topk(local, ["qid"], [F.desc("score"), F.col("cid")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hits = exact.select("qid", "cid").join(found.select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
    return hits.agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
