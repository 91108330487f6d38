"""Embedding life cycle: create in batches, add what is missing, replace, delete, break down."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

BATCH = 32
KEYS = ["project_id", "object_type", "object_id", "model_name"]


class HashEmbedder:
    """Signed feature hashing of character trigrams and words into a unit vector.

    Deterministic and needs no model file. Swap in any object with ``encode(list[str]) -> 2-D array``.
    """

    MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _trigrams(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        if len(codes) < 3:
            return np.zeros(0, dtype=np.uint64)
        h = codes[:-2] * self.MIX[0] + codes[1:-1] * self.MIX[1] + codes[2:] * self.MIX[2]
        h ^= h >> np.uint64(29)
        return (h * self.MIX[1]) >> np.uint64(16)

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            hashes = np.concatenate([
                np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)),
                self._trigrams(f" {' '.join(words)} "),
            ])
            sign = np.where((hashes >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
            out[i] = np.bincount((hashes % np.uint64(self.dim)).astype(np.int64), weights=sign, minlength=self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)


def encode_all(model, texts: list[str]) -> tuple[list[list[float] | None], list[str | None]]:
    """(vectors, errors), one of the two per text."""
    plain = lambda vecs: [np.asarray(v, dtype=np.float32).tolist() for v in vecs]
    try:
        return plain(model.encode(texts)), [None] * len(texts)
    except Exception as ex:  # noqa: BLE001 - whatever a model raises is told per row
        if len(texts) == 1:
            return [None], [f"{type(ex).__name__}: {ex}"]
    each = [encode_all(model, [x]) for x in texts]
    return [v for vecs, _ in each for v in vecs], [e for _, errors in each for e in errors]


def embed_batch(objects: DataFrame, factory: Callable[[], object] = HashEmbedder, model_name: str = "hash-64",
                text: str = "text", batch: int = BATCH) -> DataFrame:
    """Add ``model_name``, ``vector`` and ``embed_error``. The model is built once per task.

    A batch that fails is tried again row by row; a text that fails alone stays with a null vector and
    the error's text, so no row is lost.
    """
    added = [T.StructField("model_name", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
             T.StructField("embed_error", T.StringType())]
    schema = T.StructType(objects.schema.fields + added)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                vecs, errors = encode_all(model, part[text].fillna("").tolist())
                yield part.assign(model_name=model_name, vector=vecs, embed_error=errors)

    return objects.mapInPandas(run, schema)


def missing_objects(objects: DataFrame, stored: DataFrame, model_name: str) -> DataFrame:
    """Objects without a stored vector of this model: the anti-join comes before any embedding work."""
    keys = ["project_id", "object_type", "object_id"]
    return objects.join(stored.where(F.col("model_name") == model_name).select(*keys), keys, "left_anti")


def embed_incremental(objects: DataFrame, stored: DataFrame, factory=HashEmbedder, model_name: str = "hash-64",
                      overwrite: bool = False) -> DataFrame:
    """The full table after a run: stored vectors plus those that were missing (or all, anew)."""
    todo = objects if overwrite else missing_objects(objects, stored, model_name)
    fresh = embed_batch(todo, factory, model_name).select(*KEYS, "vector")
    return replace_scope(stored.select(*KEYS, "vector"), fresh) if overwrite else stored.select(*KEYS, "vector").unionByName(fresh)


def replace_scope(stored: DataFrame, fresh: DataFrame, scope: list[str] = KEYS) -> DataFrame:
    """``fresh`` takes the place of every stored row in its scope, so a rerun adds no copies."""
    touched = fresh.select(*scope).distinct()
    return stored.join(touched, scope, "left_anti").unionByName(fresh)


def delete_scope(stored: DataFrame, project_id: int, object_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row count of deleted ones)."""
    gone = F.col("project_id") == project_id
    if object_type:
        gone = gone & (F.col("object_type") == object_type)
    return stored.where(~gone), stored.agg(F.count_if(gone).alias("deleted"))


def breakdown(stored: DataFrame) -> DataFrame:
    """Counts by model, by type, by both, and in all, in one pass."""
    sets = stored.groupingSets(
        [[], ["model_name"], ["object_type"], ["model_name", "object_type"]], "model_name", "object_type")
    return sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")).select(
        F.coalesce("model_name", F.lit("*")).alias("model_name"),
        F.coalesce("object_type", F.lit("*")).alias("object_type"), "level", "n")


def index_scope(stored: DataFrame, project_id: int | None = None, object_types: list[str] | None = None,
                model_name: str | None = None) -> DataFrame:
    """Embeddings an index covers; plain predicates that reach the Parquet scan."""
    out = stored
    if project_id is not None:
        out = out.where(F.col("project_id") == project_id)
    if object_types:
        out = out.where(F.col("object_type").isin(*object_types))
    if model_name:
        out = out.where(F.col("model_name") == model_name)
    return out
