"""Secret scans with a recursive decoding worklist: URL, Unicode, base64 and compressed layers to a fixpoint."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, pick

#: name, pattern, group that holds the secret, its least length.
KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the runs of the plain pattern that are long enough
]
#: An unpacked layer larger than this is not opened but reported, as kind "oversize": a guard against bombs.
MOST_UNPACKED = 256 << 20
SPANS = "array<struct<kind:string,start:long,end:long,layers:string>>"

_URL = re.compile(r"(?:[!-$&-~]|%[0-9A-Fa-f]{2})++")  # a run is tried once, whether it has an escape or not
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_ESCAPED = re.compile(r"[\\&]\S*(?:[\\&]\S*)*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]+)?={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
_HEX = np.zeros(256, dtype=np.uint8)
for _digit in "0123456789abcdefABCDEF":
    _HEX[ord(_digit)] = int(_digit, 16)
_URLSAFE = str.maketrans("-_", "+/", "\r\n")
_CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x9F\uFFFD]")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7E]\x00){8,}|(?:\x00[\t\n\r\x20-\x7E]){8,}")  # ASCII in UTF-16, either way round
#: Share of odd characters up to which a base64 run counts as text, so that its pieces are not tried by themselves too.
MOST_ODD = 0.3
_MAGIC = {b"\x1f\x8b": "gzip", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib",
          b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}


#: Bytes given to an unpacker at once, so that many small members are not copied over and over.
STEP = 1 << 16
_PADDING = re.compile(rb"\x00*")


class Oversize(Exception):
    pass


@dataclass
class Layer:
    """A text, the layers it was unwrapped from, and where a range of it lies in the document.

    oversize: the segment holds more than may be unpacked and was not opened.
    """

    text: str
    path: tuple[str, ...]
    place: Callable[[int, int], tuple[int, int]]
    oversize: bool = False


def hits(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, of each kind; those too short are dropped without a retry."""
    for name, pattern, group, least in KINDS:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                yield name, m.start(), m.end()


def unpacked(data: bytes, most: int = MOST_UNPACKED) -> tuple[bytes, list[str]]:
    """The bytes below all compressed layers, and these; a layer that was seen before ends the unwrapping."""
    names: list[str] = []
    seen = {hashlib.sha256(data).digest()}
    while _packing(data):
        out, more = _unpack(data, most)
        digest = hashlib.sha256(out).digest()
        if not more or digest in seen:
            break
        seen.add(digest)
        data, names = out, [*names, *more]
    return data, names


def _packing(data: bytes, at: int = 0) -> str | None:
    return next((n for magic, n in _MAGIC.items() if data.startswith(magic, at)), None)


def _unpack(data: bytes, most: int) -> tuple[bytes, list[str]]:
    """All members of concatenated streams, most bytes in total, and what follows them as it is; their formats."""
    parts: list[bytes] = []
    names: list[str] = []
    at = size = 0
    while name := _packing(data, at):
        out, end = _member(name, data, at, most - size)
        size += len(out)
        if size > most:
            raise Oversize
        if end is None and not out:
            break
        parts.append(out)
        names += [name] if name not in names else []
        if end is None:
            break  # broken: what could be read counts, and the bytes themselves follow
        at = _PADDING.match(data, end).end()
    return b"".join([*parts, data[at:]]), names


def _member(name: str, data: bytes, at: int, most: int) -> tuple[bytes, int | None]:
    """What one member holds, at most a byte more than most, and where it ends; None if it is broken."""
    if name == "zstd":
        return _frame(data, at, most)
    unpacker = zlib.decompressobj(47) if name in ("gzip", "zlib") else bz2.BZ2Decompressor() if name == "bzip2" else lzma.LZMADecompressor()
    out: list[bytes] = []
    size = 0
    try:
        while not unpacker.eof and size <= most:
            chunk = getattr(unpacker, "unconsumed_tail", b"")
            if not chunk and getattr(unpacker, "needs_input", True):
                chunk = data[at : at + STEP]
                at += len(chunk)
                if not chunk:
                    return b"".join(out), len(data)  # cut off
            out.append(unpacker.decompress(chunk, most + 1 - size))
            size += len(out[-1])
    except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
        return b"".join(out), None
    return b"".join(out), at - len(unpacker.unused_data)


def _frame(data: bytes, at: int, most: int) -> tuple[bytes, int | None]:
    """_member for a zstd frame, whose blocks say where it ends."""
    out: list[bytes] = []
    size = 0
    try:
        head = data[at : at + 18]
        end = at + zstandard.frame_header_size(head)
        last = False
        while not last and end + 3 <= len(data):
            block = int.from_bytes(data[end : end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end = min(end + 4 * zstandard.get_frame_parameters(head).has_checksum, len(data))
        with zstandard.ZstdDecompressor().stream_reader(data[at:end]) as reader:
            while size <= most and (got := reader.read(min(16 * STEP, most + 1 - size))):
                out.append(got)
                size += len(got)
    except (ValueError, zstandard.ZstdError):
        return b"".join(out), None
    return b"".join(out), end


def from_bytes(data: bytes, name: str, layer: Layer, start: int, end: int, at: Callable[[int, int], tuple[int, int]]) -> Iterator[Layer]:
    """The texts that bytes of a segment hold: all of them as UTF-8, where an invalid byte is one U+FFFD, and each
    run of UTF-16. at: range of bytes to range of the segment."""
    try:
        data, packed = unpacked(data)
    except Oversize:
        yield Layer("", (*layer.path, name), lambda i, j: layer.place(start, end), oversize=True)
        return
    if not data:
        return

    def within(a: int, b: int) -> tuple[int, int]:
        if packed:
            return layer.place(start, end)  # within a compressed layer nothing finer is known
        a, b = at(a, b)
        return layer.place(start + a, start + b)

    raw = data.decode(errors="surrogateescape")  # keeps the number of bytes of every character
    byte_of: list[np.ndarray] = []

    def place(i: int, j: int) -> tuple[int, int]:
        if len(raw) == len(data):
            return within(i, j)
        if not byte_of:
            byte_of.append(byte_places(raw))
        return within(int(byte_of[0][i]), int(byte_of[0][j]))

    path = (*layer.path, name, *packed)
    yield Layer(re.sub("[\udc80-\udcff]", "\ufffd", raw), path, place)
    for m in _WIDE.finditer(data):
        text = m[0].replace(b"\0", b"").decode()
        yield Layer(text, (*path, "utf-16"), lambda i, j, s=m.start(): within(s + 2 * i, s + 2 * j))


def byte_places(raw: str) -> np.ndarray:
    """Where each character of a text decoded with surrogateescape begins in its bytes, and their number."""
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return np.concatenate(([0], np.cumsum(sizes)))


def from_url(layer: Layer) -> Iterator[tuple[int, int, Layer]]:
    if "%" not in layer.text:
        return
    for m in _URL.finditer(layer.text):
        if "%" not in m[0]:
            continue
        body = np.frombuffer(m[0].encode(), dtype=np.uint8)
        escapes = np.flatnonzero(body == ord("%"))
        first = np.ones(len(body), dtype=bool)
        first[escapes + 1] = first[escapes + 2] = False
        begins = np.flatnonzero(first)
        out = body[begins]
        out[np.searchsorted(begins, escapes)] = _HEX[body[escapes + 1]] * 16 + _HEX[body[escapes + 2]]
        begins = np.append(begins, len(body))
        for made in from_bytes(out.tobytes(), "url", layer, m.start(), m.end(), lambda a, b, s=begins: (int(s[a]), int(s[b]))):
            yield m.start(), m.end(), made


def from_unicode(layer: Layer) -> Iterator[tuple[int, int, Layer]]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    for m in _ESCAPED.finditer(layer.text):
        out: list[str] = []
        begins: list[np.ndarray] = []
        last = 0
        for e in _ESCAPE.finditer(m[0]):
            digits = next(g for g in e.groups() if g)
            code = int(digits, 10 if e.lastindex == 6 else 16)
            if code > 0x10FFFF:
                continue
            if e.start() > last:
                out.append(m[0][last : e.start()])
                begins.append(np.arange(last, e.start()))
            if 0xDC00 <= code < 0xE000 and out and "\ud800" <= out[-1] < "\udc00":
                out[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800) * 0x400 + code - 0xDC00)
            else:
                out.append(chr(code))
                begins.append(np.array([e.start()]))
            last = e.end()
        if not last:
            continue
        out.append(m[0][last:])
        places = np.concatenate([*begins, np.arange(last, len(m[0]) + 1)])
        text = re.sub("[\ud800-\udfff]", "\ufffd", "".join(out))
        place = lambda i, j, s=places, at=m.start(): layer.place(at + int(s[i]), at + int(s[j]))
        yield m.start(), m.end(), Layer(text, (*layer.path, "unicode"), place)


def from_base64(layer: Layer) -> Iterator[tuple[int, int, Layer]]:
    """Every run as a whole and every line of it; where neither is text, also the pieces between its signs."""
    for m in _BASE64.finditer(layer.text):
        made = _base64(layer, m.start(), m.end())
        yield from ((m.start(), m.end(), x) for x in made)
        poor = [] if _is_text(made) else [m.span()]
        if "\n" in m[0]:
            whole, poor = not poor, []
            for p in re.finditer(r"[^\r\n]{16,}", m[0]):
                start, end = m.start() + p.start(), m.start() + p.end()
                made = _base64(layer, start, end)
                yield from ((start, end, x) for x in made)
                if not whole and not _is_text(made):
                    poor.append((start, end))
        for start, end in poor:
            for p in _PIECE.finditer(layer.text, start, end):
                if p.span() != (start, end):
                    yield from ((p.start(), p.end(), x) for x in _base64(layer, p.start(), p.end()))


def _is_text(made: list[Layer]) -> bool:
    """Whether a decoded run is text or was compressed rather than noise; it is scanned in any case."""
    if not made or not (made[0].text or made[0].oversize):
        return False
    return made[0].oversize or "base64" != made[-1].path[-1] or len(_CONTROL.findall(made[0].text)) <= MOST_ODD * len(made[0].text)


def _base64(layer: Layer, start: int, end: int) -> list[Layer]:
    body = layer.text[start:end]
    code = body.translate(_URLSAFE).rstrip("=")
    code = code[: len(code) - (len(code) % 4 == 1)]
    try:
        data = base64.b64decode(code + "=" * (-len(code) % 4))
    except binascii.Error:
        return []
    signs = np.frombuffer(body.encode(), dtype=np.uint8)
    kept = np.flatnonzero((signs != 10) & (signs != 13)) if "\n" in body else range(len(body))

    def at(a: int, b: int) -> tuple[int, int]:
        return int(kept[4 * (a // 3)]), int(kept[min(4 * ((max(a, b - 1)) // 3) + 4, len(code)) - 1]) + 1

    return list(from_bytes(data, "base64", layer, start, end, at))


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layers) of every secret of a text, positions in code points of the text itself.

    A worklist holds the layers still to be read, at first the text. Each is scanned, and each of its segments
    that unwraps to another text joins the list, until none does. A text that was seen at the same place is
    not read again, so cycles end. Kinds found below a layer are named decoded_ and the kind.
    """
    text = text or ""
    out = [(kind, a, b, "") for kind, a, b in hits(text)]
    work = [Layer(text, (), lambda i, j: (i, j))]
    seen: set[tuple[int, int, bytes]] = set()
    found: set[tuple[str, int, int, str]] = set()
    while work:
        layer = work.pop()
        for unwrap in (from_url, from_unicode, from_base64):
            for start, end, made in unwrap(layer):
                if made.oversize:
                    found.add(("oversize", *made.place(0, 0), "+".join(made.path)))
                    continue
                key = (*layer.place(start, end), hashlib.sha256(made.text.encode()).digest())
                if key in seen or made.text == layer.text:
                    continue
                seen.add(key)
                for kind, a, b in hits(made.text):
                    found.add((f"decoded_{kind}", *made.place(a, b), "+".join(made.path)))
                work.append(made)
    order = {name: k for k, name in enumerate([k[0] for k in KINDS] + [f"decoded_{k[0]}" for k in KINDS] + ["oversize"])}
    plain = {}
    for kind, a, b, _ in out:
        plain.setdefault(kind, []).append((a, b))
    added = [f for f in sorted(found) if not _stands(plain.get(f[0].removeprefix("decoded_"), []), f)]
    return sorted(out + added, key=lambda s: (s[1], order[s[0]], s[2], s[3]))


def _stands(spans: list[tuple[int, int]], found: tuple[str, int, int, str]) -> bool:
    """Whether a span of the text itself already is this one: a layer repeats what it did not change."""
    at = bisect_right(spans, (found[1], 1 << 62)) - 1
    return at >= 0 and spans[at] == (found[1], found[2])


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, layers), by start, then kind, of every row.

    Null texts count as empty and have none; repeated rows stay; an empty table gives none; other columns are
    ignored. Rows are independent: no shuffle. A layer beyond MOST_UNPACKED bytes is reported, not opened.
    """
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in scan(t)] for t in series], dtype=object)

    return pick(df, doc_id=doc_id, text=text).select("doc_id", run("text").alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans in their order; one that several layers show is named once."""
    return F.array_join(F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k[0] for k in KINDS]
    found = find(documents(spark, sf_dir))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    of_base = joined(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select(
        "doc_id", *[count(name) for name in base], F.sha2(of_base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
