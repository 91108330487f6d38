"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, pick, written

LENGTH, END_ID = 1024, 2
#: Pieces shorter than a sequence that one task packs; the groups are dealt by row number, so none is larger.
GROUP = 30_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
_FAR = 1 << 40


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of a text by the byte-level BPE of a tokenizers file, as little-endian 32-bit bytes.

    The merges run in tiktoken over the file's own vocabulary, where an id is the rank of its merge; it gives
    the same ids several times faster, which a probe text confirms. A text that holds the string of a special
    token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = {w: i for w, i in self.whole.get_vocab().items() if w not in self.special}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items()}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merges = own.encode_ordinary
        probe = "It's 12 o'clock,  caf\u00e9\n\n\t na\u00efve_x \u65e5\u672c don't!! ***"
        if self.merges(probe) != self.exact(probe):
            raise ValueError(f"{path} is not a byte-level BPE with the expected pre-tokens")

    def exact(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        ids = self.exact(text) if any(s in text for s in self.special) else self.merges(text)
        return np.array(ids, dtype="<u4").tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first one takes the remainder."""
    first = n % length or length
    return [(0, first)] + [(start, length) for start in range(first, n, length)]


def tokenize(df: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its ids and the end id; only one longer than `length` is cut. Null and empty texts are one
    piece with the end id alone; repeated rows give repeated pieces; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = tokens_of(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokens(text or "") + end
                rows += [(doc_id, k, a, n, ids[4 * a : 4 * (a + n)]) for k, (a, n) in enumerate(cut(len(ids) // 4, length))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return pick(df, doc_id="doc_id", text="text").mapInPandas(run, PIECES)


def sum_of_squares(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins (lists of positions in sizes) by the sum-of-squares rule, closed with a repair of what stays open.

    Each item goes where the sum over gaps g of (open bins with gap g) squared becomes smallest: to an open
    bin, or to a new one. Items come in falling order of size. At the end, bins with a gap are taken apart and
    their items put where they fit best.
    """
    count = np.zeros(length + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        have = count[size:length]
        change = np.where(have > 0, count[: length - size] - have, _FAR)  # halved; count[0] stays 0
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] + (k > 0) <= count[length - size]:
            gap, at = k, open_bins[size + k].pop()
            count[size + k] -= 1
            bins[at].append(item)
        else:
            gap, at = length - size, len(bins)
            bins.append([item])
        if gap:
            count[gap] += 1
            open_bins[gap].append(at)
    loose = {at for gap in open_bins for at in gap}
    done = [b for at, b in enumerate(bins) if at not in loose]
    items = sorted((i for at in loose for i in bins[at]), key=lambda i: (-sizes[i], i))
    gaps: list[tuple[int, int]] = []
    for item in items:
        size = int(sizes[item])
        at = bisect.bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, into = gaps.pop(at)
            done[into].append(item)
        else:
            gap, into = length, len(done)
            done.append([item])
        if gap > size:
            bisect.insort(gaps, (gap - size, into))
    return done


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. Wants narrow columns: each is held for one group of pieces.

    The pieces are written to the shared folder and numbered there. Those that fill a sequence are one; the
    others are dealt by their number into groups of at most about `group`, each packed by one task. Ties go by
    the number. Columns sequence_id and offset are replaced.
    """
    kept = pieces.drop("sequence_id", "offset")
    names = kept.columns
    rows = written(kept.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == length).select(
        *names, F.col("__row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = rows.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    number = F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int")
    schema = rest.select(*names, F.col("__row").alias("sequence_id"), F.col("__row").alias("offset")).schema

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__row").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for number, items in enumerate(sum_of_squares(sizes, length)):
            sequence[items] = -1 - ((int(key[0]) << 32) + number)  # below 0: apart from those of full pieces
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        return pdf[names].assign(sequence_id=sequence, offset=offset)

    return full.unionByName(rest.groupBy(number.alias("__group")).applyInPandas(run, schema))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    pieces = tokenize(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
