"""Inverted-index retrieval: TF-IDF and BM25 as joins over postings."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark import rules
from tidemark.functions.text import ngrams, tokens
from tidemark.operators import segments as S
from tidemark.operators.blocks import keep_topk
from tidemark.sources.scratch import stored

HOT_DOCS = 1 << 20  # documents of a term that meet in one task
SENT_TERMS = 100_000  # a vocabulary capped to so many terms is sent to the texts, up to so many query terms to an index
COUNTED_ROWS = 64  # texts whose words are Python strings together

def terms_of(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None) -> DataFrame:
    """(doc, term), one row per occurrence."""
    out = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc"), F.explode(ngrams(tokens(text, stop_words), n_max)).alias("term"))
    return out.where("term IS NOT NULL")


def count_terms(terms: DataFrame) -> DataFrame:
    """(doc, term, tf). Counted map-side first, so one row per distinct term of a text is shuffled."""
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None) -> DataFrame:
    return count_terms(terms_of(docs, doc_id, text, n_max, stop_words))


def n_docs(docs: DataFrame):
    """Number of documents as a scalar subquery."""
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def hot_terms(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None, limit: int = HOT_DOCS) -> list[str]:
    """Terms of more than ``limit`` texts; a table of no more rows has none and is only counted.

    A sequence is as frequent as its rarest word at most, so only sequences of frequent words are counted. What
    reaches the driver is at most the number of term rows over ``limit``.
    """
    if docs.limit(limit + 1).count() <= limit:
        return []

    def over(grams: DataFrame) -> list[str]:
        return [r["term"] for r in grams.groupBy("term").count().where(F.col("count") > limit).select("term").collect()]

    t = docs.where(F.col(doc_id).isNotNull()).select(tokens(text, stop_words).alias("t"))
    found = over(t.select(F.explode(F.array_distinct("t")).alias("term")))
    if n_max > 1 and found:
        grams = t.select(F.explode(F.array_distinct(ngrams(F.col("t"), n_max))).alias("term")).where(F.contains("term", F.lit(" ")))
        found += over(grams.where(F.forall(F.split("term", " "), lambda w: w.isin(*found))))
    return found


def tfidf_postings(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(term, doc, tf, idf), one row per term of a text, in order of the term inside a partition.

    Terms are counted in the row of their text; then postings move once, by term. The documents of a term are
    counted where they meet. A term of more than ``hot_docs`` texts is split by a hash of the document.
    """
    rows = row_terms(docs, doc_id, text, stop_words, n_max=n_max).select("term", "doc", "tf")
    hot = hot_terms(docs, doc_id, text, n_max, stop_words, hot_docs)
    keys, df = ["term"], F.count(F.lit(1))
    if hot:
        parts = F.ceil(n_docs(docs) / F.lit(hot_docs))
        rows = rows.withColumn("part", F.when(F.col("term").isin(*hot), F.pmod(F.xxhash64("doc"), parts)).otherwise(F.lit(0).cast("bigint")))
        keys.append("part")
    met = rows.repartition(*keys).withColumn("df", df.over(Window.partitionBy(*keys)))
    if hot:
        whole = rows.where(F.col("term").isin(*hot)).groupBy("term").agg(df.alias("whole"))
        met = met.join(F.broadcast(whole), "term", "left").withColumn("df", F.coalesce("whole", "df"))
    return met.select("term", "doc", "tf", idf_of(n_docs(docs)).alias("idf"))


def idf_of(n) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0


def tfidf_norms(postings: DataFrame) -> DataFrame:
    """(doc, norm) of ``tfidf_postings``; squares are added per task before they move, and no term moves."""
    w = F.col("tf") * F.col("idf")
    return postings.groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def asked_vocabulary(postings: DataFrame, queries: DataFrame, query_id: str, text: str, n_max: int = 2, stop_words=None) -> DataFrame:
    """(term, idf) of the terms that queries ask for."""
    asked = terms_of(queries, query_id, text, n_max, stop_words).select("term").distinct()
    return postings.join(asked, "term", "left_semi").select("term", "idf").distinct()


def asked_weights(postings: DataFrame, norms: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(doc, term, weight) of the terms that queries ask for, as ``tfidf_build`` has them."""
    wanted = postings.join(query_terms.select("term").distinct(), "term", "left_semi")
    return wanted.join(norms, "doc").select("doc", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def tfidf_build(docs: DataFrame, doc_id: str, text: str, max_features: int | None = None,
                n_max: int = 2, stop_words=None) -> tuple[DataFrame, DataFrame]:
    """(postings: doc, term, weight; vocabulary: term, df, idf). Rows of a document have unit norm.

    All terms are kept; then texts are counted and weighed in segments, which move once: the counts of their
    terms and the weights read the same exchange. Or with
    ``max_features`` the most frequent ones are, ties by term: then only totals of terms are shuffled before the
    terms outside are dropped, and the vocabulary, bounded by the parameter, is sent to the texts up to SENT_TERMS
    terms. An index to search is ``tfidf_index``.
    """
    if not max_features:
        index = S.segments(docs, doc_id, text, n_max, stop_words).repartition("segment")
        vocab = S.vocabulary(index).select("term", "df", idf_of(n_docs(docs)).alias("idf"))
        return S.weights(index, S.document_counts(index), docs.count()), vocab
    rows = row_terms(docs, doc_id, text, stop_words, n_max=n_max)
    totals = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    totals = totals.orderBy(F.desc("total"), "term").limit(max_features)
    vocab = totals.select("term", "df", idf_of(n_docs(docs)).alias("idf"))
    raw = rows.join(F.broadcast(vocab) if max_features <= SENT_TERMS else vocab, "term")
    return unit_weights(raw.select("doc", "term", (F.col("tf") * F.col("idf")).alias("w")), "doc", "weight"), vocab


def tfidf_index(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None) -> dict:
    """Parts of an index to save (``sinks.save_index``): packed postings, the texts of each term, documents with their norms.

    The parts hold what ``tfidf_postings`` and ``tfidf_norms`` hold, without a row per posting.
    """
    return {"postings": S.segments(docs, doc_id, text, n_max, stop_words),
            "counts": lambda saved: S.document_counts(saved["postings"]),
            "documents": lambda saved: S.norms(saved["postings"], saved["counts"], docs.count())}


def index_norms(index: dict[str, DataFrame]) -> DataFrame:
    """(doc, norm) of a saved ``tfidf_index``."""
    return index["documents"].select(F.explode(F.arrays_zip("ids", "norms")).alias("x")).select(F.col("x.ids").alias("doc"), F.col("x.norms").alias("norm"))


class Asked:
    """What queries ask of a saved ``tfidf_index``: their terms and, where these are few, the postings of those, stored.

    More than ``limit`` query terms are not sent to the index: its rows are joined with them.
    """

    def __init__(self, index: dict[str, DataFrame], queries: DataFrame, query_id: str, text: str, n_max: int = 2, stop_words=None, limit: int = SENT_TERMS):
        self.index, self.spark = index, queries.sparkSession
        rows = term_counts(queries, query_id, text, n_max, stop_words)
        self.n_texts = index["documents"].agg(F.max("texts")).first()[0] or 0
        held = rows.limit(limit + 1).collect()
        self.sent = len(held) <= limit
        if not self.sent:
            vocab = S.vocabulary(index["postings"]).join(rows.select("term").distinct(), "term", "left_semi")
            self.vocab = vocab.select("term", idf_of(F.lit(self.n_texts)).alias("idf"))
            return
        terms = sorted({r["term"] for r in held})
        self.rows = stored(S.asked_rows(index["postings"], terms), "asked")
        df = S.asked_counts(self.rows)
        self.places = {t: i for i, t in enumerate(terms) if i in df}
        found = self.spark.createDataFrame([(t, df[i]) for t, i in self.places.items()], "term string, df bigint")
        self.vocab = found.select("term", idf_of(F.lit(self.n_texts)).alias("idf"))

    def search(self, query_terms: DataFrame, k: int = 10, min_score: float | None = rules.SEARCH_MIN_SCORE) -> DataFrame:
        """(query, doc, score, rank) like ``tfidf_search``, of (query, term, qw) by ``tfidf_queries`` with ``vocab``."""
        if not self.sent:
            postings = S.weights(self.index["postings"], self.index["counts"], self.n_texts)
            return tfidf_search(postings, query_terms, k, min_score)
        asked = query_terms.join(self.vocab, "term").select("query", "term", (F.col("qw") * F.col("idf")).alias("w"))
        queries: dict = {}
        for r in asked.collect():  # at most SENT_TERMS
            queries.setdefault(r["query"], []).append((self.places[r["term"]], r["w"]))
        names = self.spark.createDataFrame(list(enumerate(queries)), f"at int, query {query_terms.schema['query'].dataType.simpleString()}")
        hits = S.best(self.rows, self.index["documents"], list(queries.values()), k, min_score).join(names, "at")
        return keep_topk(hits.select("query", "doc", "score"), ["query"], [F.desc("score"), F.col("doc")], k)


def unit_weights(raw: DataFrame, key: str, out: str) -> DataFrame:
    """Scale the weights of each ``key`` to unit length: one shuffle, no join.

    A group is the distinct vocabulary terms of one text, so its size is bounded by the vocabulary.
    """
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias(out))


def with_idf(query_terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query, term, qw) for postings that lack their idf."""
    return query_terms.join(vocab, "term").select("query", "term", (F.col("qw") * F.col("idf")).alias("qw"))


def tfidf_queries(queries: DataFrame, query_id: str, text: str, vocab: DataFrame, n_max: int = 2, stop_words=None) -> DataFrame:
    """(query, term, qw): query texts in the space of an index."""
    counts = term_counts(queries, query_id, text, n_max, stop_words).withColumnRenamed("doc", "query")
    raw = counts.join(vocab, "term").select("query", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return unit_weights(raw, "query", "qw")


def tfidf_search(postings: DataFrame, query_terms: DataFrame, k: int = 10, min_score: float | None = rules.SEARCH_MIN_SCORE) -> DataFrame:
    """(query, doc, score, rank). Scores are summed map-side; with ``min_score`` None only zeros drop.

    Postings are cut to the terms that queries ask for before they meet the queries. Both joins are plain
    equi-joins on scans, so Spark broadcasts the query terms where they are small and splits hot terms
    where they are not.
    """
    wanted = postings.join(query_terms.select("term").distinct(), "term", "left_semi")
    hits = query_terms.join(wanted, "term").groupBy("query", "doc").agg(
        F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    hits = hits.where(F.col("score") > 0 if min_score is None else F.col("score") >= min_score)
    return keep_topk(hits, ["query"], [F.desc("score"), F.col("doc")], k)


def bm25_build(docs: DataFrame, doc_id: str, text: str, k1: float = rules.BM25_K1, b: float = rules.BM25_B,
               stop_words=None) -> DataFrame:
    """(doc, term, weight) with the whole document part of BM25 precomputed."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    impacts = bm25_impacts(rows, docs, doc_id, text, k1, b, stop_words)
    idf = bm25_idf(docs, doc_id, text, stop_words)
    return impacts.join(idf, "term").select("doc", "term", (F.col("idf") * F.col("weight")).alias("weight"))


def row_terms(docs: DataFrame, doc_id: str, text: str, stop_words=None, keep: tuple[str, ...] = (), n_max: int = 1) -> DataFrame:
    """(doc, *keep, term, tf, dl): terms of 1..n_max words counted inside the row of their text, which moves nothing.

    ``dl`` is the number of words. Texts whose id repeats count as one text, as in ``term_counts``; only they are
    shuffled. ``keep`` are columns that the id decides. One look at the ids tells whether any repeats.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), *keep, tokens(text, stop_words).alias("t"))
    rows = rows.where(F.size("t") > 0)
    repeated = docs.groupBy(F.col(doc_id).alias("doc")).count().where("count > 1 AND doc IS NOT NULL").select("doc")
    if repeated.isEmpty():
        return _counted(rows, n_max)
    many = rows.join(repeated, "doc", "left_semi")
    sizes = many.groupBy("doc").agg(F.sum(F.size("t")).cast("int").alias("dl"))
    many = many.select("doc", *keep, F.explode(ngrams(F.col("t"), n_max)).alias("term"))
    many = many.groupBy("doc", *keep, "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).join(sizes, "doc")
    return _counted(rows.join(repeated, "doc", "left_anti"), n_max).unionByName(many)


def _counted(rows: DataFrame, n_max: int) -> DataFrame:
    """The distinct terms of the last column, an array of words, with their counts; other columns are repeated."""
    others = [f for f in rows.schema.fields if f.name != "t"]

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                at, terms, tfs, sizes = [], [], [], []
                for i, words in enumerate(part.column("t").to_pylist()):
                    found = Counter(words)
                    for n in range(2, n_max + 1):
                        found.update(map(" ".join, zip(*[words[k:] for k in range(n)])))
                    at += [i] * len(found)
                    terms += found
                    tfs += found.values()
                    sizes += [len(words)] * len(found)
                kept = [part.column(f.name).take(pa.array(at, pa.int32())) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(sizes, pa.int32())],
                                                 [*[f.name for f in others], "term", "tf", "dl"])

    out = T.StructType([*others, *[T.StructField(n, t) for n, t in (("term", T.StringType()), ("tf", T.IntegerType()), ("dl", T.IntegerType()))]])
    return rows.mapInArrow(count, out)


def bm25_impacts(rows: DataFrame, docs: DataFrame, doc_id: str, text: str, k1: float = rules.BM25_K1, b: float = rules.BM25_B,
                 stop_words=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *keep, term, weight): the part of BM25 that the document decides; the idf belongs to the query.

    ``rows`` (doc, text, *keep) are the texts of ``docs`` that are wanted, lengths are compared with the mean of ``docs``.
    """
    lengths = docs.select(F.when(F.col(doc_id).isNotNull(), F.size(tokens(text, stop_words))).alias("dl"))
    # size of a null text is null or -1, by the session's settings
    mean = lengths.agg((F.sum(F.greatest("dl", F.lit(0))) / F.count(F.lit(1))).alias("m")).scalar()
    return row_terms(rows, "doc", "text", stop_words, keep).select("doc", *keep, "term", bm25_part(mean, k1, b).alias("weight"))


def bm25_part(mean, k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> Column:
    """What tf and dl, the length of a text, give to a BM25 score."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))


def bm25_idf(docs: DataFrame, doc_id: str, text: str, stop_words=None) -> DataFrame:
    """(term, idf); totals of a term are combined before they are shuffled."""
    df = row_terms(docs, doc_id, text, stop_words).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", F.log(1.0 + (n_docs(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_queries(queries: DataFrame, query_id: str, text: str, idf: DataFrame, stop_words=None) -> DataFrame:
    """(query, term, qw): each distinct term of a query weighs its idf; the postings are ``bm25_impacts``."""
    counts = term_counts(queries, query_id, text, 1, stop_words)
    return counts.join(idf, "term").select(F.col("doc").alias("query"), "term", F.col("idf").alias("qw"))


def bm25_search(postings: DataFrame, queries: DataFrame, query_id: str, text: str, k: int = 10, stop_words=None) -> DataFrame:
    q = term_counts(queries, query_id, text, 1, stop_words).select(F.col("doc").alias("query"), "term")
    wanted = postings.join(q.select("term").distinct(), "term", "left_semi")
    hits = q.join(wanted, "term").groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score"))
    return keep_topk(hits.where("score > 0"), ["query"], [F.desc("score"), F.col("doc")], k)
