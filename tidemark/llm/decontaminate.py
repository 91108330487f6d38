"""Benchmark decontamination: a prefix-filtered join of item windows with the words of documents.

A window is 13 consecutive words of an item (a shorter item is one window). A document that holds a window
holds every shingle of it, so the rarest one over the whole corpus is a sufficient prefix: a document position
is a candidate only where that shingle stands. Length and position bounds drop candidates that would reach
over either end of the document; the rest are compared word by word, then byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import documents, numbered, pick, written
from tidemark.llm.words import blocks, bounds, grams, hashes

WINDOW, SHINGLE = 13, 3
#: UTF-8 bytes of item texts in one broadcast index; a larger benchmark is taken in several blocks.
BLOCK_BYTES = 16 << 20
_WORD = np.zeros(256, dtype=np.int8)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FOUND = "n_words long, spans array<int>, items array<string>"


@dataclass
class Words:
    """The words of some texts: bytes, bounds, hashes, and the text each word is in."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    def joined(self, first: int, count: int) -> bytes:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[first : first + count], self.ends[first : first + count], strict=True))


def words_of(texts: list[bytes]) -> Words:
    raw = b"\n".join(texts).translate(_LOWER)
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = bounds(data, _WORD)
    closes = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    h = hashes(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return Words(raw, starts, ends, h, np.searchsorted(closes, starts, side="right"))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within one text, and the number of their first word."""
    g = grams(words.hash, n)
    at = np.flatnonzero(words.text[: len(g)] == words.text[n - 1 : n - 1 + len(g)])
    return g[at], at


@dataclass
class Windows:
    """Distinct windows of a block of items: their words' hashes, their text, and the items that hold them."""

    hash: list[np.ndarray]
    text: list[bytes]
    items: list[list[str]]

    def shingle(self, w: int) -> int:
        return min(SHINGLE, len(self.hash[w]))


def windows_of(items: list[tuple[str, str]], window: int = WINDOW) -> Windows:
    where: dict[bytes, int] = {}
    out = Windows([], [], [])
    for item_id, text in items:
        words = words_of([(text or "").encode()])
        n = len(words.starts)
        for first in range(max(0, n - window) + 1 if n else 0):
            size = min(window, n)
            body = words.joined(first, size)
            w = where.setdefault(body, len(out.text))
            if w == len(out.text):
                out.hash.append(words.hash[first : first + size])
                out.text.append(body)
                out.items.append([])
            if item_id not in out.items[w]:
                out.items[w].append(item_id)
    return out


def window_shingles(windows: Windows) -> dict[int, np.ndarray]:
    """For each shingle size in use, the sorted hashes of all shingles of the windows."""
    by: dict[int, list[np.ndarray]] = {}
    for w, h in enumerate(windows.hash):
        by.setdefault(windows.shingle(w), []).append(grams(h, windows.shingle(w)))
    return {n: np.unique(np.concatenate(g)) for n, g in by.items()}


def corpus_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle stands in all documents; only those of the bounded block come back."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {n: np.zeros(len(h), dtype=np.int64) for n, h in shared.value.items()}
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"]]
            for first, last in blocks(texts):
                words = words_of(texts[first:last])
                for n, known in shared.value.items():
                    g, _ = shingles(words, n)
                    at = np.searchsorted(known, g)
                    at = at[known[np.minimum(at, len(known) - 1)] == g]
                    totals[n] += np.bincount(at, minlength=len(known))[: len(known)]
        for n, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"n": n, "h": shared.value[n][at].view(np.int64), "total": total[at]})

    counts = pick(docs, text="text").mapInPandas(run, "n int, h long, total long").groupBy("n", "h").agg(F.sum("total").alias("total"))
    return {(r["n"], r["h"] & (2**64 - 1)): r["total"] for r in counts.collect()}


@dataclass
class Index:
    """Windows by their prefix: for each shingle size the sorted prefix hashes and the (window, place) of each."""

    prefix: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    windows: Windows


def index_of(windows: Windows, counts: dict[tuple[int, int], int]) -> Index:
    """Each window under its rarest shingle; windows with one that no document holds cannot occur."""
    entries: dict[int, list[tuple[int, int, int]]] = {}
    for w, h in enumerate(windows.hash):
        n = windows.shingle(w)
        total, prefix, place = min((counts.get((n, int(g)), 0), int(g), i) for i, g in enumerate(grams(h, n)))
        if total:
            entries.setdefault(n, []).append((prefix, w, place))
    prefix, window, place = {}, {}, {}
    for n, rows in entries.items():
        rows.sort()
        prefix[n] = np.array([r[0] for r in rows], dtype=np.uint64)
        window[n], place[n] = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
    return Index(prefix, window, place, windows)


def occurrences(words: Words, index: Index) -> list[tuple[int, int]]:
    """(first word, window) of every window that stands in the texts."""
    out: list[tuple[int, int]] = []
    for n, prefix in index.prefix.items():
        g, at = shingles(words, n)
        low, high = np.searchsorted(prefix, g, side="left"), np.searchsorted(prefix, g, side="right")
        some = np.flatnonzero(high > low)
        count = (high - low)[some]
        entry = np.repeat(low[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = index.window[n][entry]
        first = np.repeat(at[some], count) - index.place[n][entry]
        for w in np.unique(window).tolist():
            h, body = index.windows.hash[w], index.windows.text[w]
            start = first[window == w]
            start = start[(start >= 0) & (start + len(h) <= len(words.hash))]
            start = start[words.text[start] == words.text[start + len(h) - 1]]
            for k in range(len(h)):
                start = start[words.hash[start + k] == h[k]]
            out += [(s, w) for s in start.tolist() if words.joined(s, len(h)) == body]
    return out


def union(spans: list[tuple[int, int]]) -> list[int]:
    """Start and end of each merged span, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def finder(index: Index, spark: SparkSession):
    """A column function: text to n_words, spans of hit words (start and end, flat) and the items found."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [(t or "").encode() for t in series]
            n_words: list[int] = []
            spans: list[list[int]] = []
            items: list[list[str]] = []
            for begin, end in blocks(texts):
                words = words_of(texts[begin:end])
                size = np.bincount(words.text, minlength=end - begin)
                base = np.cumsum(size) - size
                own: dict[int, list[tuple[int, int]]] = {}
                named: dict[int, set[str]] = {}
                for first, w in occurrences(words, shared.value):
                    t = int(words.text[first])
                    a = first - int(base[t])
                    own.setdefault(t, []).append((a, a + len(shared.value.windows.hash[w])))
                    named.setdefault(t, set()).update(shared.value.windows.items[w])
                n_words += size.tolist()
                spans += [union(own.get(t, [])) for t in range(end - begin)]
                items += [sorted(named.get(t, ())) for t in range(end - begin)]
            yield pd.DataFrame({"n_words": n_words, "spans": spans, "items": items})

    return find


def pairs(flat: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(flat[0::2].tolist(), flat[1::2].tolist(), strict=True))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def merged(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([union(pairs(x) + pairs(y)) for x, y in zip(a, b, strict=True)])


def with_found(docs: DataFrame, text: str, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans and items. Each block of items is broadcast alone, its size bounded.

    With more than one block the documents are written between passes, so that no task holds two indexes.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item_id="item_id", text="text").where("text is not null").select(F.col("item_id").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for block in range(count):
        rows = items.where(F.col("block") == block).select("item_id", "text").distinct().collect()
        windows = windows_of(sorted((r["item_id"] or "null", r["text"]) for r in rows))
        wanted = window_shingles(windows)
        counts = corpus_counts(docs.select(F.col(text).alias("text")), wanted) if wanted else {}
        docs = docs.withColumn("__found", finder(index_of(windows, counts), spark)(F.col(text)))
        if block:
            docs = docs.withColumns({
                "spans": merged("spans", "__found.spans"), "items": F.array_union("items", "__found.items"),
            }).drop("__found")
        else:
            docs = docs.select(*[c for c in docs.columns if c != "__found"], "__found.*")
        if block + 1 < count:
            docs = written(docs, "found")
    return docs


def n_hit(spans: Column) -> Column:
    """Words within the merged spans: ends less starts."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda acc, x: acc + x)


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated for every document, and spans.

    Null texts have no words, are hit by nothing and hit nothing; a null item_id counts as the text 'null';
    items with one id are one item; repeated documents stay; no items, no hits; other columns are ignored.
    """
    rows = with_found(pick(docs, doc_id="doc_id", __text="text"), "__text", benchmark, block_bytes).drop("__text")
    rows = rows.withColumn("n_hit", n_hit(F.col("spans"))).withColumn("items", F.array_sort("items"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        is_contaminated().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    plain, names = numbered(docs)
    rows = with_found(plain, f"c{names.index('text')}", benchmark, block_bytes)
    rows = rows.withColumn("n_hit", n_hit(F.col("spans"))).where(~is_contaminated())
    return rows.drop("n_words", "spans", "items", "n_hit").toDF(*names)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def brute(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, str]:
    """The same by definition, for tests: n_words, n_hit, items_sha256 of one document."""
    import re

    def words(t: str | None) -> list[str]:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    own, hit, found = words(text), set(), set()
    for item_id, body in items:
        w = words(body)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(item_id)
    return len(own), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
