"""A catalog that runs along with a stream: every micro-batch adds its column states to those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.states import catalog, merge_states, partial_states


def catalog_stream(stream: DataFrame, out: str, checkpoint: str, table: str):
    """Start the stream; returns the query. State ``n`` below ``out`` covers all rows up to micro-batch ``n``.

    A state is made from the one before it and the batch alone; earlier rows are never read again. A batch that
    runs again after a failure overwrites its own state, so no row counts twice. An empty batch adds none.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        states = partial_states(batch, table)
        before = state_at(spark, out, batch_id - 1, states) if batch_id else None
        if before is not None:
            states = states.unionByName(before)
        merge_states(states).coalesce(1).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the complete states, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def state_at(spark: SparkSession, out: str, version: int | None = None, like: DataFrame | None = None) -> DataFrame | None:
    """The newest state up to ``version``; None where there is none."""
    known = [v for v in versions(spark, out) if version is None or v <= version]
    if not known:
        return None
    reader = spark.read.schema(like.schema) if like is not None else spark.read
    return reader.parquet(f"{out}/version={known[-1]}")


def catalog_at(spark: SparkSession, out: str, version: int | None = None) -> DataFrame | None:
    """The catalog after micro-batch ``version``, or after the last one; None before the first."""
    states = state_at(spark, out, version)
    return None if states is None else catalog(states)


def history(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows, nulls and distinct values of every column after each micro-batch, to see a source drift."""
    known = versions(spark, out)
    if not known:
        return None
    states = spark.read.option("basePath", out).parquet(*[f"{out}/version={v}" for v in known])
    seen = F.when(F.col("present") > 0, F.hll_sketch_estimate("values")).otherwise(F.lit(0)).cast("bigint")
    return states.select("version", "table", "column", "rows", (F.col("rows") - F.col("present")).alias("null_count"), seen.alias("distinct_count"))
