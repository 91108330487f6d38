"""Object texts, embeddings, indexes and search."""

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as X
from tidemark.operators import blockmax as BM, embed as E, lexical as L, retrieve as R, vector as V, vector_index as VI
from tidemark.plans.columns import sql_list
from tidemark.plans.indexes import saved_folder, saved_index
from tidemark.plans.registry import ORACLES, query
from tidemark.sources.scratch import scratch_dir

# --- object texts -------------------------------------------------------------------------
_NAMES10 = """SELECT table_id, string_agg(name, ', ' ORDER BY pos) AS names FROM
    (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos) AS rn FROM cat_columns) WHERE rn <= 10 GROUP BY 1"""
_TABLE_SHORT = f"""SELECT t.table_id, concat_ws(' ', t.name, CASE WHEN display_name <> t.name THEN display_name END,
    description, CASE WHEN names IS NOT NULL THEN 'Columns: ' || names END) AS text
    FROM cat_tables t LEFT JOIN ({_NAMES10}) n ON n.table_id = t.table_id"""
_COLUMN_SHORT = """SELECT column_id, concat_ws(' ', c.name, CASE WHEN c.display_name <> c.name THEN c.display_name END, c.description,
    'Table: ' || t.name, 'Type: ' || data_type, CASE WHEN business_category IS NOT NULL THEN 'Category: ' || business_category END,
    CASE WHEN len(sample_values) > 0 THEN 'Examples: ' || array_to_string(sample_values[1:5], ', ') END) AS text
    FROM cat_columns c JOIN cat_tables t ON c.table_id = t.table_id"""
_ENTRY_SHORT = """SELECT entry_id, concat_ws(' ', term, definition, CASE WHEN len(synonyms) > 0 THEN 'Synonyms: ' || array_to_string(synonyms, ', ') END,
    CASE WHEN len(abbreviations) > 0 THEN 'Abbreviations: ' || array_to_string(abbreviations, ', ') END,
    CASE WHEN domain IS NOT NULL THEN 'Domain: ' || domain END) AS text, status FROM cat_entries"""


@query("table_text", _TABLE_SHORT)
def table_text(t):
    return X.table_text(t.cat_tables, t.cat_columns)


@query(
    "table_text_full",
    """SELECT t.table_id, concat_ws(' | ', t.name, CASE WHEN display_name <> t.name THEN display_name END, description, names) AS text
       FROM cat_tables t LEFT JOIN (SELECT table_id, string_agg(name, ' ' ORDER BY pos) AS names FROM cat_columns GROUP BY 1) n
         ON n.table_id = t.table_id""",
)
def table_text_full(t):
    return X.table_text(t.cat_tables, t.cat_columns, "full")


@query("column_text", _COLUMN_SHORT)
def column_text(t):
    return X.column_text(t.cat_columns, t.cat_tables)


@query(
    "column_text_full",
    """SELECT column_id, concat_ws(' | ', name, CASE WHEN display_name <> name THEN display_name END, description, data_type,
         CASE WHEN len(sample_values) > 0 THEN array_to_string(sample_values[1:5], ' ') END) AS text FROM cat_columns""",
)
def column_text_full(t):
    return X.column_text(t.cat_columns, t.cat_tables, "full")


@query("dictionary_text", f"SELECT entry_id, text FROM ({_ENTRY_SHORT})")
def dictionary_text(t):
    return X.dictionary_text(t.cat_entries)


@query(
    "dictionary_text_full",
    """SELECT entry_id, concat_ws(' | ', term, definition, array_to_string(synonyms, ' | '), array_to_string(abbreviations, ' | '), context) AS text
       FROM cat_entries""",
)
def dictionary_text_full(t):
    return X.dictionary_text(t.cat_entries, "full")


@query(
    "collect_objects",
    f"""SELECT 'table' AS object_type, table_id AS object_id, text FROM ({_TABLE_SHORT})
        UNION ALL SELECT 'column', column_id, text FROM ({_COLUMN_SHORT})
        UNION ALL SELECT 'dictionary_entry', entry_id, text FROM ({_ENTRY_SHORT}) WHERE status <> 'archived'""",
)
def collect_objects(t):
    return X.collect_objects(t.cat_tables, t.cat_columns, t.cat_entries).select("object_type", "object_id", "text")


# --- embedding life cycle -----------------------------------------------------------------
@query("embed_batch")
def embed_batch(t):
    objects = t.spread("documents", "doc_id", "text").withColumnRenamed("doc_id", "object_id")
    return E.embed_batch(objects).select("object_id", "model_name", "vector")


def objects_of(t):
    """One object per stored vector and as many again that have none, under ids below zero."""
    base = t.cat_embeddings.select("project_id", "object_type", "object_id")
    new = base.withColumn("object_id", -1 - F.col("object_id"))
    return base.unionByName(new).withColumn("text", F.concat_ws(" ", "object_type", F.col("object_id").cast("string")))


_OBJECTS = """objects AS (SELECT project_id, object_type, object_id FROM cat_embeddings
    UNION ALL SELECT project_id, object_type, -1 - object_id FROM cat_embeddings)"""


@query(
    "embed_incremental",
    f"""WITH {_OBJECTS} SELECT project_id, object_type, object_id, model_name FROM cat_embeddings
        UNION ALL SELECT project_id, object_type, object_id, 'hash-64' FROM objects o WHERE NOT EXISTS (
          SELECT 1 FROM cat_embeddings e WHERE e.model_name = 'hash-64' AND e.project_id = o.project_id
            AND e.object_type = o.object_type AND e.object_id = o.object_id)""",
)
def embed_incremental(t):
    return E.embed_incremental(objects_of(t), t.cat_embeddings).select(*E.KEYS)


@query(
    "embed_replace",
    """SELECT project_id, object_type, object_id, model_name, list_sum(vector::DOUBLE[]) IS NOT NULL AS has_vector FROM cat_embeddings""",
)
def embed_replace(t):
    fresh = E.embed_batch(objects_of(t).where("object_id >= 0"), model_name="hash-64")
    stored = t.cat_embeddings.select(*E.KEYS, "vector")
    same = fresh.select(*E.KEYS, "vector").join(stored.where("model_name = 'hash-64'").select(*E.KEYS), E.KEYS, "left_semi")
    return E.replace_scope(stored, same).select(*E.KEYS, F.col("vector").isNotNull().alias("has_vector"))


@query(
    "embed_delete",
    """SELECT embedding_id, (SELECT count(*) FROM cat_embeddings WHERE project_id = 3 AND object_type = 'column') AS deleted
       FROM cat_embeddings WHERE NOT (project_id = 3 AND object_type = 'column')""",
)
def embed_delete(t):
    kept, deleted = E.delete_scope(t.cat_embeddings, 3, "column")
    return kept.select("embedding_id", deleted.scalar().alias("deleted"))


@query("embed_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 3) AS norm, len(embedding)::INTEGER AS dimension FROM embeddings")
def embed_norms(t):
    return V.embed_norms(t.embeddings, "embedding").select("vec_id", "norm", "dimension")


@query(
    "l2_normalize",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
       SELECT vec_id, round(v[1] / n, 6) AS first_value, round(v[64] / n, 6) AS last_value, 1.0::DOUBLE AS norm FROM n""",
)
def l2_normalize(t):
    u = t.embeddings.select("vec_id", V.l2_normalize("embedding").alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first_value"),
                    F.round(F.element_at("u", -1), 6).alias("last_value"), F.round(V.norm("u"), 6).alias("norm"))


@query(
    "vector_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
         round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS euclidean,
         round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_similarity(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", *[F.round(V.similarity("x", "y", m), 6).alias(m) for m in ("cosine", "euclidean", "dot")])


@query(
    "embed_breakdown",
    """SELECT coalesce(model_name, '*') AS model_name, coalesce(object_type, '*') AS object_type,
         grouping(model_name, object_type)::BIGINT AS level, count(*) AS n FROM cat_embeddings
       GROUP BY GROUPING SETS ((), (model_name), (object_type), (model_name, object_type))""",
)
def embed_breakdown(t):
    return E.breakdown(t.cat_embeddings)


@query("index_scope", "SELECT embedding_id FROM cat_embeddings WHERE project_id = 2 AND object_type IN ('table', 'column') AND model_name = 'mini-64'")
def index_scope(t):
    return E.index_scope(t.cat_embeddings, 2, ["table", "column"], "mini-64").select("embedding_id")


# --- vector search ------------------------------------------------------------------------
# the query vectors are those of the benchmark items
def query_vectors(t):
    return t.embeddings.join(t.benchmark, F.col("vec_id") == F.col("item_id")).select(
        F.col("item_id").alias("qid"), F.col("embedding").alias("qv"))


def corpus_vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cv"))


_SEM = """qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings JOIN benchmark ON vec_id = item_id),
    sem_all AS (SELECT qid, vec_id AS cid, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings),
    sem AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid)::INTEGER AS rank FROM sem_all)"""


@query("vector_topk_cosine", f"WITH {_SEM} SELECT qid, cid, score, rank FROM sem WHERE rank <= 10 AND score >= 0.1")
def vector_topk_cosine(t):
    return V.topk(query_vectors(t), corpus_vectors(t), 10, min_score=rules.SEARCH_MIN_SCORE)


@query(
    "vector_topk_l2",
    """WITH qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings JOIN benchmark ON vec_id = item_id),
         s AS (SELECT qid, vec_id AS cid, round(1 / (1 + list_distance(qv, embedding::DOUBLE[])), 6) AS score FROM qv, embeddings),
         r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid)::INTEGER AS rank FROM s)
       SELECT qid, cid, score, rank FROM r WHERE rank <= 10""",
)
def vector_topk_l2(t):
    return V.topk(query_vectors(t), corpus_vectors(t), 10, "l2")


_SELF = """WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS cid,
      round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid)::INTEGER AS rank FROM s)"""


def all_vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


@query("similar_objects", _SELF.format(where="WHERE a.vec_id <> b.vec_id") + " SELECT qid, cid, score, rank FROM r WHERE rank <= 10")
def similar_objects(t):
    return V.topk(all_vectors(t), corpus_vectors(t), 10, exclude_self=True)


@query("similar_objects_drop_first", _SELF.format(where="") + " SELECT qid, cid, score, (rank - 1)::INTEGER AS rank FROM r WHERE rank BETWEEN 2 AND 6")
def similar_objects_drop_first(t):
    # block sizes are set low here so that the many-queries path is the one that is checked
    ranked = V.topk(all_vectors(t), corpus_vectors(t), 6, block_rows=200)
    return R.drop_first(ranked, 5)


def vector_index(t):
    """The saved index of all vectors. Its probes and depth are measured for 0.97 of the exact ten neighbours."""
    return saved_folder(t, "vector", lambda t, to: VI.build(corpus_vectors(t), to, target=0.97), "embeddings")


@query("ann_ivf_topk")
def ann_ivf_topk(t):
    return VI.search(query_vectors(t), vector_index(t), 10)


_EXACT10 = f"WITH {_SEM} SELECT qid, cid, score, rank FROM sem WHERE rank <= 10"


@query("ann_ivf_all_cells", _EXACT10)
def ann_ivf_all_cells(t):
    """Every cell probed: the same as exact search. Small parts, so that split cells are what is checked."""
    corpus = corpus_vectors(t)
    return V.ivf_topk(query_vectors(t), corpus, V.train_cells(corpus, 16), 10, n_probe=16, block_rows=40)


@query("vector_index_exact", _EXACT10)
def vector_index_exact(t):
    """The saved index with all cells and whole vectors: the same as exact search."""
    return VI.search(query_vectors(t), vector_index(t), 10, exact=True, block_rows=40)


@query(
    "vector_index_rows",
    """SELECT vec_id AS cid, len(embedding)::INTEGER AS dimension, 16 AS code_bytes, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 3) AS norm
       FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0""",
)
def vector_index_rows(t):
    """Builds an index anew and reads all its rows back: none is left out, none is changed."""
    path = f"{scratch_dir(t.spark, 'index')}/vector"
    VI.build(corpus_vectors(t), path, target=0.97)
    rows = t.spark.read.parquet(f"{path}/rows")
    return rows.select("cid", F.size("cv").alias("dimension"), F.length("code").alias("code_bytes"), F.round(V.norm("cv"), 3).alias("norm"))


@query("ann_recall", "SELECT true AS reached")
def ann_recall(t):
    """Whether the search that is registered as ann_ivf_topk finds at least 0.95 of the exact neighbours."""
    exact = V.topk(query_vectors(t), corpus_vectors(t), 10)
    return V.recall(ann_ivf_topk(t), exact).select((F.col("recall") >= 0.95).alias("reached"))


@query("ann_report")
def ann_report(t):
    """The recall of ann_ivf_topk and the settings that were measured when its index was built."""
    meta = t.spark.read.json(f"{vector_index(t)}/metadata").select(
        *[F.col(c).cast("int").alias(c) for c in ("rows", "n_cells", "n_probe", "depth")], F.col("recall").cast("double").alias("recall_at_build"))
    found = V.recall(ann_ivf_topk(t), V.topk(query_vectors(t), corpus_vectors(t), 10))
    return meta.join(found.withColumnRenamed("recall", "recall_of_queries"))


# --- keyword search -----------------------------------------------------------------------
_STOP = sql_list(rules.KEY_TERM_STOP_WORDS)


def _terms(src, key):
    toks = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))"
    return f"""SELECT {key} AS id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
        FROM (SELECT {key}, {toks} AS t FROM {src})"""


_TFIDF = f"""dc AS (SELECT id, term, count(*) AS tf FROM ({_terms('documents', 'doc_id')}) GROUP BY ALL),
    vocab AS (SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1 AS idf FROM
      (SELECT term, sum(tf) AS total, count(*) AS df FROM dc GROUP BY 1)),
    dw AS (SELECT id, term, tf * idf AS w FROM dc JOIN vocab USING (term)),
    dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
    postings AS (SELECT id AS doc, term, w / norm AS weight FROM dw JOIN dn USING (id))"""
_KW = f"""{_TFIDF}, qc AS (SELECT id, term, count(*) AS tf FROM ({_terms('benchmark', 'item_id')}) GROUP BY ALL),
    qw AS (SELECT id, term, tf * idf AS w FROM qc JOIN vocab USING (term)),
    qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
    kw_all AS (SELECT q.id AS query, p.doc, round(sum(q.w / n.norm * p.weight), 6) AS score
      FROM qw q JOIN qn n ON q.id = n.id JOIN postings p ON p.term = q.term GROUP BY ALL),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank FROM kw_all WHERE score > 0)"""


def tfidf_parts(t):
    return L.tfidf_index(t.spread("documents", "doc_id", "text"), "doc_id", "text")


def bm25_parts(t):
    """Postings stay where their text is, in order of the term; the idf belongs to the query."""
    docs = t.spread("documents", "doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("doc"), "text")
    return {"postings": L.bm25_impacts(rows, docs, "doc_id", "text").sortWithinPartitions("term"),
            "idf": L.bm25_idf(docs, "doc_id", "text")}


def tfidf_hits(index, queries, query_id, text, k, min_score=None):
    """A search over the saved parts of a TF-IDF index."""
    asked = L.Asked(index, queries, query_id, text)
    return asked.search(L.tfidf_queries(queries, query_id, text, asked.vocab), k, min_score)


def bm25_hits(index, queries, query_id, text, k):
    return L.tfidf_search(index["postings"], L.bm25_queries(queries, query_id, text, index["idf"]), k, None)


def keyword_hits(t, k, min_score=None):
    return tfidf_hits(saved_index(t, "tfidf", tfidf_parts), t.benchmark, "item_id", "text", k, min_score)


_TFIDF_BUILD = f"WITH {_TFIDF} SELECT doc, term, round(weight, 6) AS weight FROM postings"


@query("tfidf_build", _TFIDF_BUILD)
def tfidf_build(t):
    postings, _ = L.tfidf_build(t.spread("documents", "doc_id", "text"), "doc_id", "text")
    return postings.select("doc", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_build_capped", _TFIDF_BUILD.replace("FROM dc GROUP BY 1)", f"FROM dc GROUP BY 1 ORDER BY total DESC, term LIMIT {rules.TFIDF_MAX_FEATURES})"))
def tfidf_build_capped(t):
    postings, _ = L.tfidf_build(t.spread("documents", "doc_id", "text"), "doc_id", "text", rules.TFIDF_MAX_FEATURES)
    return postings.select("doc", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_search", f"WITH {_KW} SELECT query, doc, score, rank FROM kw WHERE rank <= 10 AND score >= 0.1")
def tfidf_search(t):
    return keyword_hits(t, 10, rules.SEARCH_MIN_SCORE)


@query("tfidf_search_positive", f"WITH {_KW} SELECT query, doc, score, rank FROM kw WHERE rank <= 10")
def tfidf_search_positive(t):
    return keyword_hits(t, 10)


def _unigrams(src, key):
    return f"""SELECT id, term, count(*) AS tf FROM (SELECT {key} AS id,
        unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS term FROM {src}) GROUP BY ALL"""


_BM25 = f"""WITH c AS ({_unigrams('documents', 'doc_id')}), q AS ({_unigrams('benchmark', 'item_id')}),
         l AS (SELECT id, sum(tf)::DOUBLE AS dl FROM c GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
         g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM c)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
         s AS (SELECT q.id AS query, c.id AS doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * c.tf * 2.2::DOUBLE
                / (c.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
               FROM q JOIN c ON q.term = c.term JOIN d ON d.term = c.term JOIN l ON l.id = c.id, g GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT query, doc, score, rank FROM r WHERE rank <= 10"""


@query("bm25_search", _BM25)
def bm25_search(t):
    return bm25_hits(saved_index(t, "bm25", bm25_parts), t.benchmark, "item_id", "text", 10)


def write_blocks(t, kind, folder):
    docs = t.spread("documents", "doc_id", "text")
    if kind == "tfidf":
        BM.write_index(BM.tfidf_index(docs, "doc_id", "text", L.index_norms(saved_index(t, "tfidf", tfidf_parts))), f"{folder}/blocks")
        return
    index, idf = BM.bm25_index(docs, "doc_id", "text")
    BM.write_index(index, f"{folder}/blocks")
    idf.write.parquet(f"{folder}/idf")


def block_search(t, kind, floor=None, k=10):
    """A search with bounds over the saved blocks of ``kind``."""
    folder = saved_folder(t, f"{kind}_blocks", lambda t, to: write_blocks(t, kind, to), "documents")
    if kind == "tfidf":
        vocab = L.Asked(saved_index(t, "tfidf", tfidf_parts), t.benchmark, "item_id", "text").vocab
        asked = L.with_idf(L.tfidf_queries(t.benchmark, "item_id", "text", vocab), vocab)
    else:
        asked = L.bm25_queries(t.benchmark, "item_id", "text", t.spark.read.parquet(f"{folder}/idf"))
    doc_type = t.documents.schema["doc_id"].dataType.simpleString()
    return BM.Search(BM.read_index(t.spark, f"{folder}/blocks", doc_type), asked, k, floor)


@query("tfidf_search_blocks", ORACLES["tfidf_search"])
def tfidf_search_blocks(t):
    return block_search(t, "tfidf", rules.SEARCH_MIN_SCORE).top()


@query("tfidf_search_blocks_positive", ORACLES["tfidf_search_positive"])
def tfidf_search_blocks_positive(t):
    return block_search(t, "tfidf").top()


@query("bm25_search_blocks", _BM25)
def bm25_search_blocks(t):
    return block_search(t, "bm25").top()


@query("keyword_read")
def keyword_read(t):
    """Postings of each query's terms and how many of them a search with the usual lowest score reads."""
    return block_search(t, "tfidf", rules.SEARCH_MIN_SCORE).read()


# --- fusion -------------------------------------------------------------------------------
def semantic_list(t, k):
    hits = V.topk(query_vectors(t), corpus_vectors(t), k)
    return hits.select(F.col("qid").alias("query"), F.lit("document").alias("object_type"),
                       F.col("cid").alias("object_id"), "score", F.lit("semantic").alias("method"))


def keyword_list(t, k):
    return keyword_hits(t, k).select("query", F.lit("document").alias("object_type"),
                                     F.col("doc").alias("object_id"), "score", F.lit("keyword").alias("method"))


@query(
    "hybrid_fuse",
    f"""WITH {_SEM}, {_KW},
         f AS (SELECT coalesce(s.qid, w.query) AS query, 'document' AS object_type, coalesce(s.cid, w.doc) AS object_id,
                 coalesce(s.score, 0) AS semantic_score, coalesce(w.score, 0) AS keyword_score,
                 round(0.7::DOUBLE * coalesce(s.score, 0) + 0.3::DOUBLE * coalesce(w.score, 0), 8) AS score
               FROM (SELECT * FROM sem WHERE rank <= 20) s FULL JOIN (SELECT * FROM kw WHERE rank <= 20) w ON s.qid = w.query AND s.cid = w.doc),
         r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, object_id)::INTEGER AS rank FROM f)
        SELECT query, object_type, object_id, semantic_score, keyword_score, score, rank FROM r WHERE rank <= 10""",
)
def hybrid_fuse(t):
    return R.hybrid_fuse(semantic_list(t, 20), keyword_list(t, 20), 10)


def _merged(where):
    return f"""WITH {_SEM}, {_KW},
         u AS (SELECT qid AS query, cid AS object_id, score, 'semantic' AS method FROM sem WHERE rank <= 10
               UNION ALL SELECT query, doc, score, 'keyword' FROM kw WHERE rank <= 10),
         m AS (SELECT query, 'document' AS object_type, object_id, max(score) AS score, arg_max(method, (score, method)) AS method FROM u {where} GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, object_id)::INTEGER AS rank FROM m)
        SELECT query, object_type, object_id, score, method, rank FROM r WHERE rank <= 10"""


@query("merge_results", _merged(""))
def merge_results(t):
    return R.merge_results([semantic_list(t, 10), keyword_list(t, 10)])


@query("search_threshold_inside", _merged("WHERE score >= 0.3"))
def search_threshold_inside(t):
    return R.search_threshold([semantic_list(t, 10), keyword_list(t, 10)], 0.3, "inside")


@query("search_threshold_after", _merged("") + " AND score >= 0.3")
def search_threshold_after(t):
    return R.search_threshold([semantic_list(t, 10), keyword_list(t, 10)], 0.3, "after")


_ROUTE = """SELECT index_id, type, CASE WHEN type = 'faiss' THEN 'semantic' ELSE 'keyword' END AS method
    FROM cat_indexes WHERE status = 'ready'"""


@query("index_route", _ROUTE)
def index_route(t):
    return R.index_route(t.cat_indexes).select("index_id", "type", "method")


@query("index_route_keyword", _ROUTE + " AND type <> 'faiss'")
def index_route_keyword(t):
    return R.index_route(t.cat_indexes, "keyword").select("index_id", "type", "method")


# results to enrich: every event as a hit on an object of one of the kinds, some of them gone
HITS = """
    SELECT event_id AS hit_id, CASE event_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'column' ELSE 'dictionary_entry' END AS object_type,
           CASE event_id % 3 WHEN 1 THEN event_id ELSE user_id * (event_id % 50) END AS object_id FROM {events}"""


@query(
    "enrich_results",
    f"""WITH h AS ({HITS.replace('{events}', 'events')})
        SELECT hit_id, h.object_type, h.object_id,
          coalesce(t.display_name, t.name, c.display_name, c.name, e.term, '') AS object_name,
          coalesce(t.row_count::VARCHAR, c.data_type, CASE WHEN length(e.definition) > 200 THEN left(e.definition, 200) || '...' ELSE e.definition END, '') AS detail
        FROM h LEFT JOIN cat_tables t ON h.object_type = 'table' AND t.table_id = h.object_id
        LEFT JOIN cat_columns c ON h.object_type = 'column' AND c.column_id = h.object_id
        LEFT JOIN cat_entries e ON h.object_type = 'dictionary_entry' AND e.entry_id = h.object_id""",
)
def enrich_results(t):
    out = R.enrich(t.sql(HITS), t.cat_tables, t.cat_columns, t.cat_entries)
    g = lambda k: F.get_json_object("context", f"$.{k}")
    return out.select("hit_id", "object_type", "object_id", "object_name",
                      F.coalesce(g("row_count"), g("data_type"), g("definition"), F.lit("")).alias("detail"))


# --- one search from request to log ---------------------------------------------------------
def search_all(t):
    """Every benchmark item as a request of a project, by the ready indexes of that project."""
    requests = t.benchmark.join(query_vectors(t), F.col("item_id") == F.col("qid"), "left").select(
        F.col("item_id").alias("query"), (F.col("item_id") % 25).alias("project_id"), "text", "qv")
    kinds = t.cat_embeddings.select("object_type", "object_id")

    def semantic(asked):
        vectors = asked.where("qv IS NOT NULL").select(F.col("query").alias("qid"), "qv")
        hits = VI.search(vectors, vector_index(t), 10, exact=True)
        return hits.join(kinds, F.col("cid") == F.col("object_id")).select(F.col("qid").alias("query"), "object_type", "object_id", "score")

    def words(hits):
        return hits.select("query", F.lit("document").alias("object_type"), F.col("doc").alias("object_id"), "score")

    def tfidf(asked):
        return words(tfidf_hits(saved_index(t, "tfidf", tfidf_parts), asked, "query", "text", 10, rules.SEARCH_MIN_SCORE))

    def bm25(asked):
        return words(bm25_hits(saved_index(t, "bm25", bm25_parts), asked, "query", "text", 10))

    engines = {"faiss": semantic, "tfidf": tfidf, "bm25": bm25}
    return R.search(requests, t.cat_indexes, engines, t.cat_tables, t.cat_columns, t.cat_entries)


_FOUND = f"""WITH {_SEM}, {_KW}, bm AS ({_BM25}),
    req AS (SELECT item_id AS query, (item_id % 25)::BIGINT AS project_id FROM benchmark),
    ready AS (SELECT project_id, type, count(DISTINCT index_id) AS n FROM cat_indexes WHERE status = 'ready' GROUP BY ALL),
    go AS (SELECT query, type FROM req JOIN ready USING (project_id)),
    u AS (SELECT go.query, e.object_type, e.object_id, score, 'semantic' AS method FROM go JOIN sem ON qid = go.query JOIN cat_embeddings e ON e.object_id = cid WHERE type = 'faiss' AND rank <= 10
      UNION ALL SELECT go.query, 'document', doc, score, 'keyword' FROM go JOIN kw ON kw.query = go.query WHERE type = 'tfidf' AND rank <= 10
      UNION ALL SELECT go.query, 'document', doc, score, 'keyword' FROM go JOIN bm ON bm.query = go.query WHERE type = 'bm25'),
    m AS (SELECT query, object_type, object_id, max(score) AS score, arg_max(method, (score, method)) AS method FROM u GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, object_type, object_id)::INTEGER AS rank FROM m),
    res AS (SELECT * FROM ranked WHERE rank <= 10 AND score >= 0.1)"""


@query(
    "search_end_to_end",
    f"""{_FOUND} SELECT query, res.object_type, res.object_id, score, method, rank,
          coalesce(t.display_name, t.name, c.display_name, c.name, e.term, '') AS object_name,
          coalesce(t.row_count::VARCHAR, c.data_type, e.category, '') AS detail
        FROM res LEFT JOIN cat_tables t ON res.object_type = 'table' AND t.table_id = res.object_id
        LEFT JOIN cat_columns c ON res.object_type = 'column' AND c.column_id = res.object_id
        LEFT JOIN cat_entries e ON res.object_type = 'dictionary_entry' AND e.entry_id = res.object_id""",
)
def search_end_to_end(t):
    """Routed, searched by each index's own method, merged, cut, named."""
    g = lambda k: F.get_json_object("context", f"$.{k}")
    return search_all(t)[0].withColumn("detail", F.coalesce(g("row_count"), g("data_type"), g("category"), F.lit(""))).drop("context")


@query(
    "search_end_to_end_log",
    f"""{_FOUND} SELECT query, project_id, (SELECT count(*) FROM res WHERE res.query = req.query) AS results_count,
          (SELECT coalesce(sum(n), 0)::BIGINT FROM ready WHERE ready.project_id = req.project_id) AS indexes_used FROM req""",
)
def search_end_to_end_log(t):
    """The log of the same searches: requests without an index or a hit too."""
    return search_all(t)[1]


@query(
    "browse_category",
    """(SELECT 'table' AS object_type, table_id AS object_id, name AS text, 1.0::DOUBLE AS score FROM cat_tables ORDER BY table_id LIMIT 10)
       UNION ALL (SELECT 'column', column_id, name, 1.0::DOUBLE FROM cat_columns ORDER BY column_id LIMIT 10)
       UNION ALL (SELECT 'dictionary_entry', entry_id, term, 1.0::DOUBLE FROM cat_entries WHERE status <> 'archived' ORDER BY entry_id LIMIT 10)""",
)
def browse_category(t):
    live = t.cat_entries.where("status <> 'archived'")
    parts = [
        R.browse("table", t.cat_tables, "table_id", "name", ["name", "row_count"]),
        R.browse("column", t.cat_columns, "column_id", "name", ["name", "data_type", "business_category"]),
        R.browse("dictionary_entry", live, "entry_id", "term", ["term", "definition", "category", "domain"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("metadata")


@query(
    "suggest_names",
    """SELECT name FROM (SELECT name FROM cat_tables UNION SELECT name FROM cat_columns UNION SELECT term FROM cat_entries)
       WHERE contains(lower(name), 'ord') ORDER BY name LIMIT 5""",
)
def suggest_names(t):
    return R.suggest_names([t.cat_tables.select("name"), t.cat_columns.select("name"), t.cat_entries.select(F.col("term").alias("name"))], "Ord")


def _suggest_sql(part, n):
    return f"""SELECT prio, oid, text, type, description, category FROM (
        (SELECT 0 AS prio, entry_id AS oid, term AS text, 'dictionary_term' AS type,
            CASE WHEN length(definition) > 100 THEN left(definition, 100) || '...' ELSE definition END AS description, category
         FROM cat_entries WHERE term ILIKE '%{part}%' ORDER BY entry_id LIMIT {n})
        UNION ALL (SELECT 1, table_id, coalesce(display_name, name), 'table', 'Table with ' || row_count || ' rows', 'data_source'
         FROM cat_tables WHERE name ILIKE '%{part}%' ORDER BY table_id LIMIT {n})
        UNION ALL (SELECT 2, column_id, coalesce(display_name, name), 'column', data_type || ' column', 'data_field'
         FROM cat_columns WHERE name ILIKE '%{part}%' ORDER BY column_id LIMIT {n})) ORDER BY prio, oid LIMIT {n}"""


@query("suggest_prioritized", _suggest_sql("cust", 20))
def suggest_prioritized(t):
    return R.suggest_prioritized(t.cat_entries, t.cat_tables, t.cat_columns, "cust", 20)


@query("suggest_prioritized_tables", _suggest_sql("blue_bolt_sales", 20))
def suggest_prioritized_tables(t):
    return R.suggest_prioritized(t.cat_entries, t.cat_tables, t.cat_columns, "blue_bolt_sales", 20)


@query("search_log_append", f"WITH {_KW} SELECT item_id AS query, count(doc) AS results_count FROM benchmark LEFT JOIN (SELECT * FROM kw WHERE rank <= 10) k ON k.query = item_id GROUP BY 1")
def search_log_append(t):
    queries = t.benchmark.select(F.col("item_id").alias("query"))
    rows = R.search_log_rows(keyword_hits(t, 10), queries, F.current_timestamp(), F.lit(0.0))
    return rows.select("query", "results_count")


NOW = "2024-01-25 12:00:00"
_RECENT = f"created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND created_at <= TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "search_stats",
    f"""SELECT project_id, count(*) AS total_searches, round(avg(search_time_ms)::DECIMAL(28,9), 2)::DOUBLE AS avg_search_time,
          round(avg(results_count)::DECIMAL(28,9), 1)::DOUBLE AS avg_results_count FROM search_log WHERE {_RECENT} GROUP BY 1""",
)
def search_stats(t):
    return R.search_stats(t.search_log, now(), 20)


@query(
    "popular_queries",
    f"""WITH c AS (SELECT project_id, query, count(*) AS n FROM search_log WHERE {_RECENT} GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, query)::INTEGER AS rank FROM c)
        SELECT project_id, query, n, rank FROM r WHERE rank <= 10""",
)
def popular_queries(t):
    return R.popular_queries(t.search_log, now(), 20)


@query(
    "search_trends",
    "SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS searches, round(avg(search_time_ms)::DECIMAL(28,9), 2)::DOUBLE AS avg_ms FROM search_log GROUP BY 1",
)
def search_trends(t):
    return R.search_trends(t.search_log)


@query(
    "index_status",
    """SELECT project_id, count(*) AS total_indexes, count(*) FILTER (status = 'ready') AS ready_indexes,
         count(*) FILTER (status = 'building') AS building_indexes, count(*) FILTER (status = 'error') AS error_indexes,
         sum(total_objects)::BIGINT AS total_objects, sum(indexed_objects)::BIGINT AS indexed_objects FROM cat_indexes GROUP BY 1""",
)
def index_status(t):
    return R.index_status(t.cat_indexes)
