"""New files to cleaned rows, profiles and vectors, each file once."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.clean import apply_types, decide_types, rename_clean
from tidemark.operators.embed import HashEmbedder, embed_batch
from tidemark.operators.profile import profile_columns

TASK_ROWS = 100_000  # rows that one task profiles and embeds


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a scan on as many tasks as their number asks for: splits are cut by bytes, and packed rows are short."""
    n = ceil(rows.count() / TASK_ROWS)
    return rows.repartition(n, F.xxhash64(*[f"`{c}`" for c in rows.columns])) if n > rows.rdd.getNumPartitions() else rows


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, table: str, text: str | None = None, key: str | None = None,
                  types: dict[str, str] | None = None, factory=HashEmbedder):
    """Start the stream; returns the query. Outputs go below ``out`` in one folder per micro-batch.

    Every batch overwrites its own folders, so a batch that is run again after a failure leaves no
    copies. ``types`` pins the column types; without it each batch decides, which is only safe when
    batches look alike.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        clean = rename_clean(batch)
        clean = apply_types(clean, types if types is not None else decide_types(clean))
        where = lambda part: f"{out}/{part}/batch={batch_id}"
        clean.write.mode("overwrite").parquet(where("rows"))
        written = dealt(batch.sparkSession.read.parquet(where("rows")))
        profile_columns(written, table).write.mode("overwrite").parquet(where("profiles"))
        if text and key:
            objects = written.select(F.col(key).alias("object_id"), F.col(text).alias("text")).dropDuplicates(["object_id"])
            if batch_id > 0:
                seen = _earlier(batch.sparkSession, f"{out}/vectors", batch_id)
                if seen is not None:
                    objects = objects.join(seen.select("object_id"), "object_id", "left_anti")
            embed_batch(objects, factory).write.mode("overwrite").parquet(where("vectors"))

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(path).where(F.col("batch") < batch_id)
    except Exception as ex:  # noqa: BLE001 - nothing has been written yet
        if "PATH_NOT_FOUND" in str(ex) or "UNABLE_TO_INFER_SCHEMA" in str(ex):
            return None
        raise
