"""Secret scans that look through encodings, by a worklist of decoded layers.

The text is the first layer. Every layer is scanned for secrets and searched for encoded parts: percent
signs, Unicode escapes and character references, base64, and what gzip, zlib, bzip2 or xz have compressed
inside base64. A decoded part becomes a layer of its own, with the place in the original text of each of its
characters, until nothing new appears. A layer that was met before is not looked at again.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tablegauge.llm.common import arrow_table, text_groups

GROUP_BYTES = 4 << 20
#: The kinds in their order, their patterns and least lengths (of the value, or of the match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A compressed part that unfolds to more bytes than this is reported as refused instead of read.
LAYER_BYTES = 32 << 20

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN)), ("n_layers", pa.int32()), ("n_refused", pa.int32())])


@dataclass
class Layer:
    """A decoded text, and for each character where its source begins and ends in the original text."""

    text: str
    starts: np.ndarray | None  # None: the original text itself
    ends: np.ndarray | None
    depth: int

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text) + 1, dtype=np.int64)
            return at[:-1], at[1:]
        return self.starts, self.ends


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets written plainly in the text, leftmost and non-overlapping within a kind."""
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def replaced(layer: Layer, found: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with parts (start, end, new text, source of each new character) in place of the old ones."""
    starts, ends = layer.places()
    texts, new_starts, new_ends, at = [], [], [], 0
    for a, b, text, sources in found:
        texts += [layer.text[at:a], text]
        new_starts += [starts[at:a], starts[[s for s, _ in sources]] if sources else starts[:0]]
        new_ends += [ends[at:a], ends[[e - 1 for _, e in sources]] if sources else ends[:0]]
        at = b
    texts.append(layer.text[at:])
    return Layer("".join(texts), np.concatenate([*new_starts, starts[at:]]), np.concatenate([*new_ends, ends[at:]]), layer.depth + 1)


def characters(octets: bytes) -> Iterator[tuple[str, int, int]]:
    """The characters of UTF-8 octets with the first and one past the last octet of each; bad ones are U+FFFD."""
    at = 0
    for c in octets.decode("utf-8", "replace"):
        n = len(c.encode("utf-8"))
        if c == "�" and octets[at:at + 3] != b"\xef\xbf\xbd":
            n = 1
        yield c, at, min(at + n, len(octets))
        at += n


def unpercent(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    found = []
    for m in PERCENT.finditer(layer.text):
        chars = list(characters(bytes.fromhex(m[0].replace("%", ""))))
        found.append((m.start(), m.end(), "".join(c for c, _, _ in chars),
                      [(m.start() + 3 * min(a, len(m[0]) // 3 - 1), m.start() + 3 * b) for _, a, b in chars]))
    return replaced(layer, found) if found else None


def escaped(form: str) -> str:
    """The character that one escape stands for; U+FFFD if there is none."""
    if form.startswith("&#"):
        digits = form[2:-1]
        code = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
    elif len(form) == 12:  # two halves
        high, low = int(form[2:6], 16), int(form[8:12], 16)
        code = 0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00)
    else:
        code = int(form[2:].strip("{}"), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"


def unescaped(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    found = [(m.start(), m.end(), escaped(m[0]), [(m.start(), m.end())]) for m in ESCAPE.finditer(layer.text)]
    return replaced(layer, found) if found else None


def inflated(octets: bytes, limit: int) -> bytes | None:
    """What a compressed stream holds, None where it is none; more than ``limit`` bytes raise OverflowError."""
    if octets[:2] == b"\x1f\x8b" or octets[:1] == b"\x78" and len(octets) > 1 and int.from_bytes(octets[:2], "big") % 31 == 0:
        unfold = zlib.decompressobj(47)
        try:
            out = unfold.decompress(octets, limit + 1)
        except zlib.error:
            return None
    elif octets[:3] == b"BZh" or octets[:6] == b"\xfd7zXZ\x00":
        unfold = bz2.BZ2Decompressor() if octets[:1] == b"B" else lzma.LZMADecompressor(memlimit=256 << 20)
        try:
            out = unfold.decompress(octets, limit + 1)
        except (OSError, EOFError, lzma.LZMAError):
            return None
    else:
        return None
    if len(out) > limit:
        raise OverflowError("a compressed part is larger than a layer may be")
    return out


def readable(octets: bytes) -> str | None:
    """The text of the octets if they are UTF-8 without control characters other than white space."""
    try:
        text = octets.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def unbased(layer: Layer, limit: int, refused: list) -> Iterator[Layer]:
    """A layer for each run of base64 that holds text, or compressed text."""
    for m in BASE64.finditer(layer.text):
        letters = m[0].rstrip("=")
        if len(letters) % 4 == 1:
            continue
        try:
            octets = base64.b64decode(letters.replace("-", "+").replace("_", "/") + "=" * (-len(letters) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        begin, (first, last) = m.start(), layer.span(m.start(), m.end())
        if (text := readable(octets)) is not None:
            starts, ends = layer.places()
            parts = [(begin + a * 4 // 3, begin + min(len(letters), -(-b * 4 // 3))) for _, a, b in characters(octets)]
            yield Layer(text, starts[[a for a, _ in parts]], ends[[b - 1 for _, b in parts]], layer.depth + 1)
            continue
        try:
            while (inner := inflated(octets, limit)) is not None:
                octets = inner
                if (text := readable(octets)) is not None:  # no character of it has a place of its own
                    yield Layer(text, np.full(len(text), first), np.full(len(text), last), layer.depth + 1)
                    break
        except OverflowError:
            refused.append((first, last))


def secret_spans(text: str, limit: int = LAYER_BYTES) -> tuple[list[tuple[str, int, int, int]], int, int]:
    """All spans (kind, start, end, depth) by place, the number of layers, and of refused parts.

    Depth 0 is what stands in the text itself. A span that several layers show keeps its least depth.
    """
    work, seen = [Layer(text, None, None, 0)], set()
    spans: dict[tuple[str, int, int], int] = {}
    refused: list = []
    while work:
        layer = work.pop()
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.span(0, len(layer.text)) if layer.text else ()) if layer.depth else None
        if mark in seen:
            continue
        seen.add(mark)
        for kind, a, b in matches(layer.text):
            key = (kind, *layer.span(a, b))
            spans[key] = min(layer.depth, spans.get(key, layer.depth))
        work += [x for x in (unpercent(layer), unescaped(layer)) if x is not None]
        work += unbased(layer, limit, refused)
    listed = sorted(((k, a, b, d) for (k, a, b), d in spans.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return listed, len(seen), len(set(refused))


def scan_secrets(docs: DataFrame, limit: int = LAYER_BYTES) -> DataFrame:
    """doc_id, spans (kind, start, end, depth), n_layers, n_refused of every row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Places count code points of the whole
    text, ends are exclusive. A null or empty text has no spans. Repeated rows give a row each.
    A compressed part that unfolds beyond ``limit`` bytes (a bomb) is not read but counted in ``n_refused``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            rows = [secret_spans(t or "", limit) for t in group.column(1).to_pylist()]
            yield arrow_table({
                "doc_id": group.column(0),
                "spans": [[{"kind": k, "start": a, "end": b, "depth": d} for k, a, b, d in r[0]] for r in rows],
                "n_layers": [r[1] for r in rows], "n_refused": [r[2] for r in rows]}, FOUND)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, from_arrow_schema(FOUND))


def redacted(text: str, mark: str, limit: int = LAYER_BYTES) -> str:
    """The text with every span, overlapping ones together, replaced by the mark with the first one's kind."""
    parts, at, end, kind = [], 0, -1, ""
    for k, a, b, _ in secret_spans(text, limit)[0]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            parts.append(mark.format(kind=kind))
            at = end
        parts.append(text[at:a])
        end, kind = b, k
    if end >= 0:
        parts.append(mark.format(kind=kind))
        at = end
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in ``text`` replaced; a null text stays null."""
    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "text", GROUP_BYTES):
            texts = [None if t is None else redacted(t, mark) for t in group.column(at).to_pylist()]
            columns = list(group.columns)
            columns[at] = pa.array(texts, type=schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)
