"""TF-IDF index in segments: the postings of about a million words of whole texts, packed where the texts lie.

A segment is cut by a hash of the term into shards; a row is one segment and shard, its terms with their postings
as compressed arrays. Postings are never moved as rows. Only the distinct terms of the segments meet, shard by
shard, to count the texts of a term, and only these counts go back. As a segment holds whole texts, norms and the
scores of a search are complete inside it, and what leaves it is the best k documents of a query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import ngrams, tokens

SEGMENT_TERMS = 1 << 20  # words of a segment; a longer text is a segment of its own
SHARD_CHARS = 1 << 23  # characters of text for each shard of the terms

PACKED = ["lengths", "chars", "ns", "ords", "tfs"]


# --- packed arrays ------------------------------------------------------------------------
def pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least zero in as few bytes as the largest needs, compressed."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    raw = values.astype(kind).tobytes()
    return bytes([kind.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: pa.Scalar) -> np.ndarray:
    held = packed.as_buffer()
    head = held[:9].to_pybytes()
    return np.frombuffer(pa.decompress(held[9:], int.from_bytes(head[1:], "little"), "zstd"), f"u{head[0]}")


def pack_terms(terms: pa.Array) -> tuple[bytes, bytes]:
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1]
    chars = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return pack(np.diff(offsets)), pack(chars)


def unpack_terms(lengths: pa.Scalar, chars: pa.Scalar) -> pa.Array:
    ends = np.cumsum(unpack(lengths), dtype=np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(unpack(chars)))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


# --- one segment --------------------------------------------------------------------------
def _grouped(codes: np.ndarray, docs: np.ndarray, n_docs: int, limit: int):
    """(distinct codes, texts of each, text and tf of each posting) of codes below ``limit``, in order of code and text."""
    values = None
    if limit * n_docs >= 1 << 63:
        values, codes = np.unique(codes, return_inverse=True)
    keys = codes * n_docs  # in place from here on: these are the longest arrays of a segment
    keys += docs
    keys.sort()
    first = _changes(keys)
    tfs, keys = np.diff(first, append=len(keys)).astype(np.int32), keys[first]
    ords = (keys % n_docs).astype(np.int32)
    keys //= n_docs
    first = _changes(keys)
    distinct = keys[first]
    return distinct if values is None else values[distinct], np.diff(first, append=len(keys)), ords, tfs


def _changes(values: np.ndarray) -> np.ndarray:
    """The places in sorted values where another value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hash(words: pa.Array) -> np.ndarray:
    """64 bits of each word, from its bytes and their places; words are not empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    sizes = np.diff(offsets)
    power = np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64).cumprod()
    chars = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    return _mixed(np.add.reduceat(chars * power[_spans(np.zeros(len(sizes), np.int64), sizes.astype(np.int64))], starts))


def _hash_on(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence and one more word; it wraps around 64 bits."""
    return _mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def _counted_texts(texts: pa.ListArray, n_max: int):
    """(terms, their hashes, texts of each, ordinal and tf of each posting) of texts as arrays of words."""
    at = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
    coded = texts.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(order), np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    word, size = rank[coded.indices.to_numpy()], len(words)
    del coded
    word_hash = _word_hash(words)
    names, hashes, out, end, codes, limit = words, word_hash, [], np.arange(len(word), dtype=np.int32), word.astype(np.int64), size
    for n in range(1, n_max + 1):
        if n > 1:
            on = end[end + 1 < len(word)]
            codes = codes[:len(on)][stay := at[on + 1] == at[on]] * size
            end = on[stay] + 1
            codes, limit = codes + word[end], len(names) * size
        distinct, ns, ords, tfs = _grouped(codes, at[end], len(texts), limit)
        if n > 1:
            before, last = np.divmod(distinct, size)
            names = pc.binary_join_element_wise(names.take(pa.array(before)), words.take(pa.array(last)), " ")
            hashes = _hash_on(hashes[before], word_hash[last])
            if n < n_max:
                codes = np.searchsorted(distinct, codes)
        out.append((names, hashes, ns, ords, tfs))
    return pa.concat_arrays([o[0] for o in out]), *[np.concatenate([o[i] for o in out]) for i in range(1, 5)]


def _counted_rows(docs: pa.Array, terms: pa.Array, tf: np.ndarray):
    """The same from rows (doc, term, tf), the rows of a document one after the other; and the documents."""
    coded = docs.dictionary_encode()
    named = terms.dictionary_encode()
    names = named.dictionary
    order = np.lexsort((coded.indices.to_numpy(), named.indices.to_numpy()))
    words = pc.split_pattern(names, " ")
    sizes, word_hash = pc.list_value_length(words).to_numpy(), _word_hash(words.flatten())
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    hashes = word_hash[first]
    for n in range(1, sizes.max()):
        longer = sizes > n
        hashes[longer] = _hash_on(hashes[longer], word_hash[first[longer] + n])
    ns = np.bincount(named.indices.to_numpy(), minlength=len(names))
    return (names, hashes, ns, coded.indices.to_numpy()[order], tf[order]), coded.dictionary


def _rows_of(counted, ids: pa.Array, shards: int) -> pa.RecordBatch:
    """The rows of a segment, which is named by its first document; the first row holds the ids of all."""
    names, hashes, ns, ords, tfs = counted
    shard = (hashes % np.uint64(shards)).astype(np.int64 if shards > 1 << 16 else np.uint16)  # short ones sort in linear time
    order = np.argsort(shard, kind="stable")
    at = _spans((np.cumsum(ns) - ns)[order], ns[order])
    names, shard, ns, ords, tfs = names.take(pa.array(order)), shard[order], ns[order], ords[at], tfs[at]
    held = np.unique(shard)
    cuts, ends = np.searchsorted(shard, held), np.append(0, np.cumsum(ns))
    columns = [[] for _ in range(5)]
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        found = (*pack_terms(names.slice(a, b - a)), pack(ns[a:b]), *[pack(x[ends[a]:ends[b]]) for x in (ords, tfs)])
        for column, value in zip(columns, found):
            column.append(value)
    listed = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * len(held)], pa.int32()), ids, mask=pa.array([i > 0 for i in range(len(held))]))
    arrays = [ids.take(pa.array([0] * len(held))), pa.array(held, pa.int32()), *[pa.array(c, pa.binary()) for c in columns], listed]
    return pa.RecordBatch.from_arrays(arrays, ["segment", "shard", *PACKED, "ids"])


# --- build --------------------------------------------------------------------------------
def segments(docs: DataFrame, doc_id: str, text: str, n_max: int = 2, stop_words=None, segment_terms: int = SEGMENT_TERMS,
             shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(segment, shard, packed terms and postings, ids): all terms of 1..n_max words of all texts.

    Texts are counted where they lie. Texts whose id repeats count as one text; only they are shuffled. One look
    at the texts tells their size, which gives the number of shards, one at the ids whether any repeats. No document
    is in two segments. To be stored before two jobs read it; the readers of one job may share an exchange of it.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    shards = max(1, ceil(chars / shard_chars))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), tokens(text, stop_words).alias("t"))
    kind = rows.schema["doc"].dataType.simpleString()
    out = f"segment {kind}, shard int, {', '.join(f'{c} binary' for c in PACKED)}, ids array<{kind}>"

    def of_texts(batches):
        held, size = [], 0

        def close():
            whole = pa.Table.from_batches(held)
            counted = _counted_texts(whole.column("t").combine_chunks(), n_max)
            return _rows_of(counted, whole.column("doc").combine_chunks(), shards)

        for batch in batches:  # texts without words are left out here, as a filter before would find the words twice
            full = pc.fill_null(pc.greater(pc.list_value_length(batch.column("t")), 0), False)
            batch = batch if pc.all(full).as_py() else batch.filter(full)
            ends, start = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)), 0
            while start < len(ends):
                before = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, before + segment_terms - size, "right"))
                stop = max(stop, start if held else start + 1)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1]) - before
                if stop < len(ends):
                    yield close()
                    held, size = [], 0
                start = stop
        if held:
            yield close()

    def of_rows(batches):
        held = None

        def close(part):
            part = part.combine_chunks()
            column = lambda name: pa.concat_arrays(part.column(name).chunks)
            return _rows_of(*_counted_rows(column("doc"), column("term"), column("tf").to_numpy(zero_copy_only=False)), shards)

        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if held.num_rows < segment_terms:
                continue
            docs = pc.dictionary_encode(held.column("doc").combine_chunks()).indices.to_numpy()
            if last := int(np.searchsorted(docs, docs[-1])):  # the last document may go on
                yield close(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield close(held)

    repeated = docs.groupBy(F.col(doc_id).alias("doc")).count().where("count > 1 AND doc IS NOT NULL").select("doc")
    if repeated.isEmpty():
        return rows.mapInArrow(of_texts, out)
    many = rows.join(repeated, "doc", "left_semi").select("doc", F.explode(ngrams(F.col("t"), n_max)).alias("term"))
    many = many.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).repartition("doc").sortWithinPartitions("doc")
    return rows.join(repeated, "doc", "left_anti").mapInArrow(of_texts, out).unionByName(many.mapInArrow(of_rows, out))


def document_counts(index: DataFrame) -> DataFrame:
    """(segment, shard, df): for each term of a row of the index the number of texts that hold it."""
    def count(found: pa.Table) -> pa.Table:
        terms = [unpack_terms(a, b) for a, b in zip(found.column("lengths"), found.column("chars"))]
        coded = pa.concat_arrays(terms).dictionary_encode().indices.to_numpy()
        df = np.bincount(coded, np.concatenate([unpack(n) for n in found.column("ns")])).astype(np.int64)[coded]
        back = [pack(x) for x in np.split(df, np.cumsum([len(t) for t in terms])[:-1])]
        return pa.table({"segment": found.column("segment"), "shard": found.column("shard"), "df": pa.array(back, pa.binary())})

    return _terms_only(index).groupBy("shard").applyInArrow(count, f"segment {_kind(index)}, shard int, df binary")


def _terms_only(index: DataFrame) -> DataFrame:
    """The columns that the counts need. A cut that Spark can't see through, so that an exchange below is the same for all readers."""
    names = ["segment", "shard", "lengths", "chars", "ns"]
    return index.mapInArrow(lambda batches: (b.select(names) for b in batches), f"segment {_kind(index)}, shard int, lengths binary, chars binary, ns binary")


def _kind(index: DataFrame) -> str:
    return index.schema["segment"].dataType.simpleString()


def _with_idf(left: pa.Table, right: pa.Table, n_texts: int):
    """(row of left, idf of its terms) for each row of a segment."""
    counts = dict(zip(right.column("shard").to_pylist(), right.column("df")))
    for row in range(left.num_rows):
        df = unpack(counts[left.column("shard")[row].as_py()])
        yield row, np.log((1.0 + n_texts) / (1.0 + df)) + 1.0


def _ids(left: pa.Table) -> pa.Array:
    return next(x for x in left.column("ids") if x.is_valid).values


def _norms(left: pa.Table, right: pa.Table, n_texts: int, n_docs: int) -> np.ndarray:
    total = np.zeros(n_docs)
    for row, idf in _with_idf(left, right, n_texts):
        w = unpack(left.column("tfs")[row]) * np.repeat(idf, unpack(left.column("ns")[row]))
        total += np.bincount(unpack(left.column("ords")[row]), w * w, n_docs)
    return np.sqrt(total)


def norms(index: DataFrame, counts: DataFrame, n_texts: int) -> DataFrame:
    """(segment, ids, norms, texts): the documents of each segment with the lengths of their vectors."""
    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = _ids(left)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({"segment": left.column("segment").slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                         "norms": one(_norms(left, right, n_texts, len(ids)), pa.float64()), "texts": pa.array([n_texts], pa.int64())})

    rows = index.select("segment", "shard", "ns", "ords", "tfs", "ids")
    out = f"segment {_kind(index)}, ids array<{_kind(index)}>, norms array<double>, texts bigint"
    return rows.groupBy("segment").cogroup(counts.groupBy("segment")).applyInArrow(measure, out)


def weights(index: DataFrame, counts: DataFrame, n_texts: int) -> DataFrame:
    """(doc, term, weight), one row per term of a text; the rows of a document have unit norm."""
    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = _ids(left)
        lengths = _norms(left, right, n_texts, len(ids))
        out = [pa.table({"doc": ids.slice(0, 0), "term": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})]
        for row, idf in _with_idf(left, right, n_texts):
            ns, ords, tfs = (unpack(left.column(c)[row]) for c in ("ns", "ords", "tfs"))
            terms = unpack_terms(left.column("lengths")[row], left.column("chars")[row])
            out.append(pa.table({"doc": ids.take(pa.array(ords)), "term": terms.take(pa.array(np.repeat(np.arange(len(ns)), ns))),
                                 "weight": tfs * np.repeat(idf, ns) / lengths[ords]}))
        return pa.concat_tables(out)

    schema = f"doc {_kind(index)}, term string, weight double"
    return index.groupBy("segment").cogroup(counts.groupBy("segment")).applyInArrow(spell, schema)


# --- search -------------------------------------------------------------------------------
def vocabulary(index: DataFrame) -> DataFrame:
    """(term, df); a term is one row per segment before its texts are summed."""
    def spell(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                terms = unpack_terms(batch.column("lengths")[row], batch.column("chars")[row])
                yield pa.RecordBatch.from_arrays([terms, pa.array(unpack(batch.column("ns")[row]).astype(np.int64))], ["term", "n"])

    rows = index.select("lengths", "chars", "ns").mapInArrow(spell, "term string, n bigint")
    return rows.groupBy("term").agg(F.sum("n").alias("df"))


def asked_rows(index: DataFrame, terms: list[str]) -> DataFrame:
    """(segment, at, ns, ords, tfs): the postings of terms, which are named by their place in ``terms``."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def cut(batches):
        names = pa.array(sent.value, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                place = pc.index_in(unpack_terms(batch.column("lengths")[row], batch.column("chars")[row]), value_set=names)
                held = pc.is_valid(place).to_numpy(zero_copy_only=False)
                if not held.any():
                    continue
                ns = unpack(batch.column("ns")[row]).astype(np.int64)
                spans = _spans((np.cumsum(ns) - ns)[held], ns[held])
                ords, tfs = (pack(unpack(batch.column(c)[row])[spans]) for c in ("ords", "tfs"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("segment").slice(row, 1), pa.array([place.drop_null().to_numpy()], pa.list_(pa.int32())),
                     pa.array([ns[held]], pa.list_(pa.int64())), pa.array([ords], pa.binary()), pa.array([tfs], pa.binary())],
                    ["segment", "at", "ns", "ords", "tfs"])

    rows = index.select("segment", "lengths", "chars", "ns", "ords", "tfs")
    return rows.mapInArrow(cut, f"segment {_kind(index)}, at array<int>, ns array<bigint>, ords binary, tfs binary")


def asked_counts(asked: DataFrame) -> dict[int, int]:
    """The number of texts by the place of the term; at most as many as terms were asked for."""
    rows = asked.select(F.explode(F.arrays_zip("at", "ns")).alias("x")).groupBy("x.at").agg(F.sum("x.ns").alias("df"))
    return {r["at"]: r["df"] for r in rows.collect()}


def best(asked: DataFrame, documents: DataFrame, queries: list[list[tuple[int, float]]], k: int, min_score: float | None) -> DataFrame:
    """(at, doc, score): for each query, named by its place, the best k documents of each segment and maybe more.

    A query is the places of its terms in ``asked`` with what one occurrence of the term adds to the score of a
    text before its norm. Postings of the asked terms meet by segment; the scores of a text are whole there.
    """
    sent = asked.sparkSession.sparkContext.broadcast([(np.array([t for t, _ in q], np.int64), np.array([w for _, w in q])) for q in queries])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lengths = _ids(right), right.column("norms")[0].values.to_numpy()
        column = lambda name: np.concatenate([np.empty(0, np.int64), *[unpack(x) for x in left.column(name)]])
        terms, ns = (np.concatenate([np.empty(0, np.int64), *[x.values.to_numpy() for x in left.column(c)]]).astype(np.int64) for c in ("at", "ns"))
        ords, tfs, first = column("ords").astype(np.int64), column("tfs").astype(np.float64), np.cumsum(ns) - ns
        place = {t: (a, a + n) for t, a, n in zip(terms.tolist(), first.tolist(), ns.tolist())}
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at, (asks, adds) in enumerate(sent.value if len(terms) else []):
            total = np.zeros(len(ids))
            for t, w in zip(asks.tolist(), adds.tolist()):
                a, b = place.get(t, (0, 0))
                total[ords[a:b]] += w * tfs[a:b]
            total = np.floor(total / lengths * 1e6 + 0.5) / 1e6
            hits = np.flatnonzero(total > 0 if min_score is None else total >= min_score)
            if len(hits) > k:
                kth = np.partition(total[hits], len(hits) - k)[len(hits) - k]
                hits = hits[total[hits] >= kth]
                hits = hits[np.lexsort((rank[hits], -total[hits]))[:k]]
            out.append((np.full(len(hits), at), hits, total[hits]))
        at, hits, total = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.table({"at": pa.array(at, pa.int32()), "doc": ids.take(pa.array(hits)), "score": total})

    schema = f"at int, doc {_kind(documents)}, score double"
    return asked.groupBy("segment").cogroup(documents.groupBy("segment")).applyInArrow(score, schema)
