"""Training rows from labelled documents: a bounded sample of distinct rows, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import pick, written


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def share_of(n: int, most: int) -> int:
    """Millionths to draw of n rows so that about `most` are drawn."""
    return 1_000_000 if n <= most else int(1_000_000 * most / n)


def sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int, salt: int) -> DataFrame:
    """doc_id, text, label, weight of the training rows: labelled ones that are not held out, repeats as weights.

    Ids are drawn first, by a hash, then the distinct rows that they have: at most about max_train. So neither a
    repeated row nor an id that a third of all rows have brings more. Null ids and labels are left out, a null
    text counts as empty.
    """
    known = pick(labels, doc_id="doc_id", label=label).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("times"))
    known = written(known, f"{label}-labels")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000))
    most = share_of(known.count(), max_train)
    texts = pick(docs, doc_id="doc_id", text="text").where(draw < most).where(~held_out(F.col("doc_id")))
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.join(known.where(draw < most), "doc_id")
    rows = written(rows.select("doc_id", "text", "label", (F.col("n") * F.col("times")).alias("weight")), f"{label}-rows")
    again = F.pmod(F.xxhash64("doc_id", "text", "label", F.lit(salt + 1)), F.lit(1_000_000))
    return rows.where(again < share_of(rows.count(), max_train))
