"""A saved index for cosine search: cells of near vectors, short codes for the first pass, whole vectors for the last.

Rows lie in one Parquet table partitioned by cell: id, code, vector. A search reads the ids and codes of the cells
that its queries probe, keeps the ``depth`` best of each query by code, and ranks those by their whole vectors.
Centres and code books are fitted on a bounded sample (``FIT_ROWS`` rows with the smallest hashes of their id) and
every row is indexed. How many cells to probe and how deep to rank is measured when the index is built: exact
neighbours of ``TRIAL_ROWS`` sampled rows among *all* rows must be found up to the asked share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.blocks import keep_topk
from tidemark.operators.vector import _matrix, _scorer, cell_meetings, norm, similarity, topk, usable

FIT_ROWS = 16384     # rows that centres and code books are fitted on, at most
TRIAL_ROWS = 256     # sampled queries that set the number of probes and the depth
MOST_CELLS = 4096
CODE_VALUES = 256    # values of one byte of a code
CODE_BYTES = 16
ROWS_A_FILE = 1_000_000
QUERIES_AT_ONCE = 64


def k_means(x: np.ndarray, n: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of at most ``n`` groups of rows; an empty group keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(centres))
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def by_distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Larger is nearer: x.c - |c|^2 / 2."""
    return x @ centres.T - 0.5 * (centres**2).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (8 << 20) // max(1, len(centres)))
    parts = [by_distance(x[i:i + step], centres).argmax(axis=1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=int)


class Coder:
    """Centres, and per slice of the dimensions a book of at most 256 typical differences from the centre."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        ends = np.cumsum([b.shape[1] for b in books])
        self.slices = [slice(e - b.shape[1], e) for e, b in zip(ends, books)]

    @classmethod
    def fit(cls, x: np.ndarray, n_cells: int, code_bytes: int, seed: int) -> Coder:
        centres = k_means(x, n_cells, seed)
        rest = x - centres[nearest(x, centres)]
        cuts = np.array_split(np.arange(x.shape[1]), min(code_bytes, x.shape[1]))
        return cls(centres, [k_means(rest[:, c], CODE_VALUES, seed + 1 + i) for i, c in enumerate(cuts)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        code = [nearest(rest[:, s], b) for s, b in zip(self.slices, self.books)]
        return cell, np.stack(code, axis=1).astype("uint8")

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of queries and coded rows of one cell."""
        out = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for i, (s, b) in enumerate(zip(self.slices, self.books)):
            out += (queries[:, s] @ b.T)[:, codes[:, i]]
        return out

    def rows(self) -> list[tuple]:
        return [("centre", 0, i, v.tolist()) for i, v in enumerate(self.centres)] + [
            ("book", j, i, v.tolist()) for j, b in enumerate(self.books) for i, v in enumerate(b)]

    @classmethod
    def of(cls, rows) -> Coder:
        rows = sorted(rows, key=lambda r: (r["kind"], r["slice"], r["place"]))
        centres = np.array([r["value"] for r in rows if r["kind"] == "centre"])
        n = 1 + max(r["slice"] for r in rows)
        return cls(centres, [np.array([r["value"] for r in rows if r["kind"] == "book" and r["slice"] == j]) for j in range(n)])


MODEL = "kind string, slice int, place int, value array<double>"


def sampled(corpus: DataFrame, n: int, total: int, salt: int) -> DataFrame:
    """``n`` of ``total`` rows: those with the smallest salted hashes of their id. A hash bound goes before the sort."""
    key = F.xxhash64("cid", F.lit(salt))
    if total > 4 * n:
        corpus = corpus.where(key < int(-(2**63) + 2**64 * 2 * n / total))
    return corpus.orderBy(key, "cid").limit(n)


def build(corpus: DataFrame, path: str, n_cells: int | None = None, code_bytes: int = CODE_BYTES, k: int = 10,
          target: float = 0.95, most_depth: int = 64, seed: int = 7) -> dict[str, str]:
    """Write the index of ``corpus`` (cid, cv) below ``path``; returns its metadata, which goes last.

    All vectors have one length, else an error. Rows without a usable vector (null, a null in it, all zero) have no
    cosine and are left out, as in exact search. ``n_cells`` is the square root of the number of rows unless given.
    The smallest number of probes whose cells hold (1 + target) / 2 of the exact ``k`` neighbours of the sampled
    rows is kept, then the smallest depth, up to ``most_depth`` times ``k``, that finds ``target`` of them; the share
    that is reached stands in the metadata. An empty corpus gives an index that finds nothing.
    """
    spark = corpus.sparkSession
    rows = usable(corpus.select("cid", "cv"), "cv").where(norm("cv") > 0)
    meta = {"type": "vector", "k": k, "n_cells": 0, "n_probe": 0, "depth": 0, "recall": 1.0, "dimension": 0, "rows": 0}
    lengths = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("cv")).alias("lo"), F.max(F.size("cv")).alias("hi")).first()
    n = lengths["n"]
    if n == 0:
        return finish(spark, path, meta)
    if lengths["lo"] != lengths["hi"]:
        raise ValueError(f"vectors have {lengths['lo']} to {lengths['hi']} dimensions")
    sample = _matrix(sampled(rows, FIT_ROWS, n, 1).toPandas()["cv"], True)
    coder = Coder.fit(sample, min(n_cells or max(1, round(n ** 0.5)), MOST_CELLS), code_bytes, seed)
    # a cell's number of files by its share of the sample, so that a hot cell is many and a small one is one
    share = np.bincount(nearest(sample, coder.centres), minlength=len(coder.centres)) / len(sample)
    files = np.maximum(1, np.ceil(share * n / ROWS_A_FILE)).astype("int32")
    held = spark.sparkContext.broadcast((coder, files))

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                coder, files = held.value
                cell, code = coder.encode(_matrix(pdf["cv"], True))
                yield pdf.assign(cell=cell.astype("int32"), code=[c.tobytes() for c in code], files=files[cell])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"cid {kinds['cid']}, cv {kinds['cv']}, cell int, code binary, files int"
    coded = rows.mapInPandas(encode, schema).repartition(F.col("cell"), F.pmod(F.xxhash64("cid"), F.col("files")))
    coded.drop("files").write.mode("overwrite").partitionBy("cell").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{path}/rows")
    spark.createDataFrame(coder.rows(), MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    meta.update(n_cells=len(coder.centres), dimension=lengths["lo"], rows=n)
    stored = spark.read.parquet(f"{path}/rows")
    return finish(spark, path, {**meta, **measure(stored, coder, rows, n, k, target, most_depth)})


def finish(spark: SparkSession, path: str, meta: dict) -> dict[str, str]:
    row = {name: str(v) for name, v in meta.items()}
    schema = ", ".join(f"{name} string" for name in row)
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return row


def measure(stored: DataFrame, coder: Coder, rows: DataFrame, n: int, k: int, target: float, most_depth: int) -> dict:
    """Probes and depth that find ``target`` of the exact neighbours of sampled rows; only histograms are collected.

    A row is not counted as its own neighbour: that one is always found.
    """
    trial = sampled(rows, TRIAL_ROWS, n, 2).select(F.col("cid").alias("qid"), F.col("cv").alias("qv"))
    exact = topk(trial, rows, k, exclude_self=True, small_queries=True).select("qid", "cid")
    n_cells = len(coder.centres)
    order = probes(trial, coder, n_cells).select("qid", "cell", "place")
    held = exact.join(stored.select("cid", "cell"), "cid").join(order, ["qid", "cell"])
    at = {r["place"]: r["count"] for r in held.groupBy("place").count().collect()}
    total = sum(at.values())
    n_probe = smallest(at, total, (1 + target) / 2, n_cells)
    found = first_pass(stored, trial, coder, n_probe, k * most_depth)
    at = {r["rank"]: r["count"] for r in exact.join(found, ["qid", "cid"]).groupBy("rank").count().collect()}
    depth = max(k, smallest(at, total, target, k * most_depth))
    return {"n_probe": n_probe, "depth": depth, "recall": round(sum(n for p, n in at.items() if p <= depth) / max(total, 1), 4)}


def smallest(at: dict[int, int], total: int, share: float, most: int) -> int:
    """The smallest place up to which ``share`` of ``total`` lie."""
    seen = 0
    for place in sorted(at):
        seen += at[place]
        if seen >= share * total:
            return place
    return most


def probes(queries: DataFrame, coder: Coder, n: int) -> DataFrame:
    """One row per query and probed cell, with its place (1 is the nearest)."""
    held = queries.sparkSession.sparkContext.broadcast(coder.centres)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(-by_distance(_matrix(v, True), held.value), axis=1, kind="stable")[:, :n].astype("int32")))

    return queries.select("qid", "qv", F.posexplode(cells("qv")).alias("place", "cell")).withColumn("place", F.col("place") + 1)


def code_scorer(held, depth: int):
    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        coder, cell = held.value, int(c["cell"].iat[0])
        codes = np.frombuffer(b"".join(c["code"]), dtype="uint8").reshape(len(c), -1)
        ids = c["cid"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], codes[order]
        unit, out = _matrix(q["qv"], True), []
        for start in range(0, len(q), QUERIES_AT_ONCE):
            s = np.round(coder.scores(unit[start:start + QUERIES_AT_ONCE], cell, codes), 9)
            for qid, row in zip(q["qid"].iloc[start:start + QUERIES_AT_ONCE], s):
                top = np.argsort(-row, kind="stable")[:depth]
                out.append(pd.DataFrame({"qid": qid, "cid": ids[top], "cell": cell, "score": row[top]}))
        return pd.concat(out, ignore_index=True)

    return score


def first_pass(rows: DataFrame, queries: DataFrame, coder: Coder, n_probe: int, depth: int, block_rows: int = 20000) -> DataFrame:
    """qid, cid, cell, rank of the ``depth`` best rows of a query by code, from its ``n_probe`` nearest cells."""
    left = probes(queries, coder, n_probe).drop("place")
    right = in_cells(rows, left).select("cid", "cell", "code")
    held = rows.sparkSession.sparkContext.broadcast(coder)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"qid {kind(queries, 'qid')}, cid {kind(rows, 'cid')}, cell int, score double"
    local = cell_meetings(left, right, code_scorer(held, depth), schema, block_rows)
    return keep_topk(local, ["qid"], [F.desc("score"), F.col("cid")], depth).drop("score")


def in_cells(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked cells: the list, at most MOST_CELLS numbers, cuts the scan to their folders."""
    cells = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
    return rows.where(F.col("cell").isin(cells) if cells else F.lit(False))


def load(spark: SparkSession, path: str) -> tuple[dict[str, str], Coder | None, DataFrame | None]:
    meta = spark.read.json(f"{path}/metadata").first().asDict()
    if meta["n_cells"] == "0":
        return meta, None, None
    return meta, Coder.of(spark.read.schema(MODEL).parquet(f"{path}/model").collect()), spark.read.parquet(f"{path}/rows")


def search(queries: DataFrame, path: str, k: int = 10, n_probe: int | None = None, depth: int | None = None,
           min_score: float | None = None, exact: bool = False, block_rows: int = 20000) -> DataFrame:
    """Nearest rows of ``queries`` (qid, qv) by cosine from the index below ``path``: qid, cid, score, rank.

    ``n_probe`` and ``depth`` are those that were measured at the build unless given; a ``k`` above the one they were
    measured for deepens the ranking in proportion. ``exact`` scores the whole vectors of all cells instead. Scores
    are those of the whole vectors in either case, rounded to six decimals, ties by id. Queries without a usable
    vector have no rows. Ids are meant to be unique; rows that share one are all ranked. Vectors of another length are an error.
    """
    meta, coder, rows = load(queries.sparkSession, path)
    queries = usable(queries.select("qid", "qv"), "qv").where(norm("qv") > 0)
    if coder is None:
        return queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, cid bigint, score double, rank int")
    best = [F.desc("score"), F.col("cid")]
    if exact:
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        left = probes(queries, coder, len(coder.centres)).drop("place")
        scored = cell_meetings(left, rows.select("cid", "cell", "cv"), _scorer(k, "cosine", None, False),
                               f"qid {kind(queries, 'qid')}, cid {kind(rows, 'cid')}, score double", block_rows)
    else:
        deep = depth or max(k, -(-int(meta["depth"]) * max(k, int(meta["k"])) // int(meta["k"])))
        found = first_pass(rows, queries, coder, n_probe or int(meta["n_probe"]), deep, block_rows).select("qid", "cell", "cid").distinct()
        scored = found.join(rows.select("cell", "cid", "cv"), ["cell", "cid"]).join(queries, "qid").select(
            "qid", "cid", F.round(similarity("qv", "cv"), 6).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return keep_topk(scored, ["qid"], best, k)
