"""Exact top-k over two tables by block scoring.

Every (query, candidate) score is needed for an exact answer, but no pair is ever a row: rows are
hashed into blocks of bounded size, two blocks meet in one task, and only the best ``k`` per query
of that meeting leave it. A window then keeps the best ``k`` over all meetings. Blocks follow a hash
of the id, so they are even whatever the data looks like. Queries that the caller declares small are
instead shipped to the candidates' own partitions, which then do not move at all.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SMALL_SIDE_ROWS = 2048
SMALL_SIDE_BYTES = 64 << 20
BLOCK_ROWS = 4096  # rows of a side that are scored at once
MEET_ROWS = 32768  # rows of a side that meet in one task

Scorer = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def block_topk(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, score: Scorer,
               schema: str, prune: Callable[[pd.DataFrame], pd.DataFrame], small_queries: bool = False, block_rows: int = BLOCK_ROWS, rebalance: bool = False) -> DataFrame:
    """Apply ``score(query_block, corpus_block)`` to all block pairs; it returns its local best.

    ``small_queries`` broadcasts the query side; more than SMALL_SIDE_ROWS rows or SMALL_SIDE_BYTES are
    an error then, not another plan. ``prune`` cuts the union of two local results back to the best per
    query, so a partition emits one result however many batches it reads. Up to MEET_ROWS of a side meet in one
    task, less where that leaves cores without work, but not less than ``block_rows``, which ``score`` takes at
    once: a row is copied once per meeting of its side, so small meetings would copy most. ``rebalance`` spreads a corpus of few rows that are
    costly to score over all cores.
    """
    if small_queries:
        head = queries.limit(SMALL_SIDE_ROWS + 1).toPandas()
        if len(head) > SMALL_SIDE_ROWS or head.memory_usage(deep=True).sum() > SMALL_SIDE_BYTES:
            raise ValueError("the query side is too large for a broadcast")
        spark = queries.sparkSession
        held = spark.sparkContext.broadcast(head)

        def scan(batches):
            best = None
            for pdf in batches:
                if len(pdf) and len(held.value):
                    local = score(held.value, pdf)
                    best = local if best is None else prune(pd.concat([best, local], ignore_index=True))
            if best is not None:
                yield best

        if rebalance:
            corpus = corpus.repartition(spark.sparkContext.defaultParallelism, corpus_id)
        return corpus.mapInPandas(scan, schema)
    n_queries, n_corpus = queries.count(), corpus.count()
    side = ceil((2 * queries.sparkSession.sparkContext.defaultParallelism) ** 0.5)
    parts = lambda n: max(1, ceil(n / MEET_ROWS), min(ceil(n / block_rows), side))
    qb, cb = parts(n_queries), parts(n_corpus)
    if rebalance:
        cb = max(cb, min(n_corpus, queries.sparkSession.sparkContext.defaultParallelism))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_qb", block(query_id, qb)).withColumn("_cb", every(cb))
    right = corpus.withColumn("_cb", block(corpus_id, cb)).withColumn("_qb", every(qb))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame()
        return score(a, b)

    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(meet, schema)


def keep_topk(scored: DataFrame, partition: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
