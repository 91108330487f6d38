"""What the operators of this package share: the shared folder, written tables and safe column picking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a local session gets a folder of its own, the same one as long as it runs; a cluster without
    it is an error, since a machine-local folder would lose what other executors wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-llm-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, stable rows, survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """new=old columns by exact name, whatever else df holds (also names that differ in case only)."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed c0, c1, ... so that added columns cannot clash; and the old names."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def without(df: DataFrame, gone: DataFrame, doc_id: str, text_key: Column, name: str) -> DataFrame:
    """df, whose columns are c0, c1, ..., without the documents listed in gone (id, key, once).

    text_key names a row's text. A listed document goes with all its rows; with once, one row of it stays.
    The rows are first met by 64-bit marks of the list, the narrowest table that can tell most rows apart, so
    that Spark can broadcast it while it is small. Only rows with a mark are then compared by id and key, and
    only they move.
    """
    mark = F.xxhash64(F.col(doc_id), F.col("__key"))
    gone = written(gone.select(F.col("id").alias("__id"), F.col("key").alias("__gone"), F.col("once").alias("__once")), name)
    marks = gone.select(F.xxhash64("__id", "__gone").alias("__mark")).distinct()
    rows = df.withColumn("__key", text_key).withColumn("__mark", mark)
    marks = written(marks, f"{name}-marks")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone"))
    stay = rows.join(marks, "__mark", "left_anti").select(*df.columns)
    met = rows.join(marks, "__mark", "left_semi").join(gone, same, "left")
    other = met.where("__gone IS NULL").select(*df.columns)
    once = met.where("__once").dropDuplicates([doc_id, "__key"]).select(*df.columns)
    return stay.union(other).union(once)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
