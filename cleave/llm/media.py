"""Media columns: signature sniffing with one Aho-Corasick automaton and format validators; carving of embedded media."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cleave.llm.common import arrow_schema, pick

#: Magic bytes of the known formats, with the place of the format's first byte before them: fixed values.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"RIFF", "wav", 0),
    (b"BM", "bmp", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
]
#: Marks that end a format or point back to its begin; the same automaton finds them.
END_MAGIC = [(b"%%EOF", "pdf end"), (b"startxref", "pdf table"), (b"PK\x05\x06", "zip end")]
ROW = 64


class Found(NamedTuple):
    kind: str
    start: int
    end: int


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, back in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
    for magic, kind in END_MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1))
    a.make_automaton()
    return a


class Places:
    """Where the automaton found which magic bytes, and from where walks through a format are known to fail; so validators are linear in all."""

    def __init__(self, data: bytes):
        self.starts: list[tuple[int, str]] = []
        self.ends: dict[str, list[int]] = {kind: [] for _, kind in END_MAGIC}
        for end, (kind, back) in automaton().iter(data.decode("latin-1")):
            if kind in self.ends:
                self.ends[kind].append(end - back)
            else:
                self.starts.append((end - back, kind))
        self.dead: set[tuple[str, int]] = set()
        self.archives: dict[int, int] = {}
        for p in self.ends["zip end"]:
            if p + 22 <= len(data):
                size, offset, note = struct.unpack_from("<IIH", data, p + 12)
                if size <= p and data[p - size : p - size + 4] == b"PK\x01\x02" and p + 22 + note <= len(data):
                    self.archives.setdefault(p - size - offset, p + 22 + note)

    def walk(self, kind: str, at: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where steps from `at` end, or -1. step: from a place to the next one and whether that is the end; -1 fails."""
        way, p = [], at
        while (kind, p) not in self.dead:
            way.append(p)
            p, done = step(p)
            if done:
                return p
            if p < 0:
                break
        self.dead.update((kind, x) for x in way)
        return -1


def _png(data: bytes, at: int, places: Places) -> int:
    """End of a PNG whose chunks have right lengths and checksums, or -1. Checksums are taken of chunks that lead to an end."""
    if data[at + 8 : at + 16] != b"\x00\x00\x00\x0dIHDR":
        return -1

    def step(p: int) -> tuple[int, bool]:
        if p + 12 > len(data):
            return -1, False
        n, tag = struct.unpack_from(">I4s", data, p)
        return (p + 12 + n, tag == b"IEND") if p + 12 + n <= len(data) else (-1, False)

    end, p = places.walk("png", at + 8, step), at + 8
    while 0 <= p < end:
        n = struct.unpack_from(">I", data, p)[0]
        if zlib.crc32(memoryview(data)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", data, p + 8 + n)[0]:
            return -1
        p += 12 + n
    return end


def _wav(data: bytes, at: int, places: Places) -> int:
    """End of a RIFF WAVE with a fmt and a data chunk that fill it, or -1."""
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return -1
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return -1
    p, seen = at + 12, set()
    while p + 8 <= end:
        tag, n = struct.unpack_from("<4sI", data, p)
        if p + 8 + n > end:
            return -1
        seen.add(tag)
        p += 8 + n + (n & 1)
    return end if {b"fmt ", b"data"} <= seen and p >= end else -1


def _bmp(data: bytes, at: int, places: Places) -> int:
    """End of a bitmap whose header sizes agree with its file size, or -1."""
    if at + 54 > len(data):
        return -1
    size, zero, start, header, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    if zero or header < 40 or header > 124 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
        return -1
    packed = struct.unpack_from("<I", data, at + 30)[0]
    body = (w * bits + 31) // 32 * 4 * abs(h)
    if start < 14 + header or at + size > len(data) or (not packed and start + body > size):
        return -1
    return at + size


def _gif(data: bytes, at: int, places: Places) -> int:
    """End of a GIF after walking its blocks to the trailer, or -1."""
    if at + 13 > len(data):
        return -1

    def parts(p: int) -> tuple[int, bool]:
        while p < len(data) and data[p]:
            if ("gif parts", p) in places.dead:
                return -1, False
            places.dead.add(("gif parts", p))  # met again only by another walk, which would end as this one does
            p += 1 + data[p]
        return p + 1, False

    def step(p: int) -> tuple[int, bool]:
        mark = data[p] if p < len(data) else 0
        if mark == 0x3B:
            return p + 1, True
        if mark == 0x21:
            return parts(p + 2)
        if mark != 0x2C or p + 10 > len(data):
            return -1, False
        local = data[p + 9]
        return parts(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))

    flags = data[at + 10]
    return places.walk("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), step)


def _jpeg(data: bytes, at: int, places: Places) -> int:
    """End of a JPEG after walking its segments and scans to the end marker, or -1."""

    def step(state: int) -> tuple[int, bool]:
        p, scanned = state >> 1, state & 1
        if p + 2 > len(data) or data[p] != 0xFF:
            return -1, False
        if data[p + 1] == 0xD9:
            return (p + 2, True) if scanned else (-1, False)
        if p + 4 > len(data):
            return -1, False
        scan = data[p + 1] == 0xDA
        p += 2 + struct.unpack_from(">H", data, p + 2)[0]
        while scan:
            p = data.find(b"\xff", p)
            if p < 0 or p + 1 >= len(data) or ("scan", p) in places.dead:
                return -1, False
            places.dead.add(("scan", p))  # as for GIF
            if data[p + 1] and not 0xD0 <= data[p + 1] <= 0xD7:
                break
            p += 2
        return 2 * p + (scan or scanned), False

    return places.walk("jpeg", 2 * (at + 2), step)


def _pdf(data: bytes, at: int, places: Places) -> int:
    """End of a PDF: its first end mark, if a table's place is named before it; or -1."""
    ends, tables = places.ends["pdf end"], places.ends["pdf table"]
    k, t = bisect_left(ends, at), bisect_left(tables, at)
    return ends[k] + 5 if k < len(ends) and t < len(tables) and tables[t] < ends[k] else -1


def _zip(data: bytes, at: int, places: Places) -> int:
    """End of an archive whose central directory points back to its first entry, or -1."""
    return places.archives.get(at, -1)


def _flac(data: bytes, at: int, places: Places) -> int:
    """A FLAC stream has no length of its own: with a right STREAMINFO block it reaches to the end."""
    return len(data) if data[at + 4 : at + 8] in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") and at + 42 <= len(data) else -1


def _ogg(data: bytes, at: int, places: Places) -> int:
    """End of a run of Ogg pages of one stream, or -1."""
    p, last = at, -1
    while p + 27 <= len(data) and data[p : p + 5] == b"OggS\x00":
        n = data[p + 26]
        q = p + 27 + n + sum(data[p + 27 : p + 27 + n])
        if q > len(data):
            return last
        p = last = q
    return last


VALIDATORS = {"png": _png, "wav": _wav, "bmp": _bmp, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "flac": _flac, "ogg": _ogg}


def sniff(data: bytes) -> list[Found]:
    """Media in `data` by start: the automaton finds magic bytes, the format's validator confirms structure and length.

    What lies inside a confirmed piece is not listed apart from it (its first byte holds the outer one).
    """
    out, covered, places = [], 0, Places(data)
    for at, kind in places.starts:
        if at >= covered and (stop := VALIDATORS[kind](data, at, places)) > 0:
            out.append(Found(kind, at, stop))
            covered = stop
    return out


def true_type(data: bytes | None, declared: str | None, found: list[Found] | None = None) -> tuple[str | None, int, list[Found]]:
    """The type that the bytes show (else the declared one), their media length, and media embedded behind or before."""
    found = sniff(data or b"") if found is None else found
    if found and found[0].start == 0:
        return found[0].kind, found[0].end, found[1:]
    return declared, len(data or b""), found


def store(payload: bytes, kind: str) -> bytes:
    """`payload` (a multiple of 64 bytes) as 8-bit samples of a WAV, or rows of 64 grey pixels of a PNG or bitmap."""
    rows = len(payload) // ROW
    if kind == "wav":
        fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
        return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload
    if kind == "bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + len(payload), 0, 54 + 1024, 40, ROW, -rows, 1, 8, 0, len(payload), 0, 0, 256, 0) + palette + payload
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return MAGIC[0][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read(data: bytes, kind: str) -> bytes:
    """The samples of what `store` wrote."""
    if kind == "wav":
        p = 12
        while data[p : p + 4] != b"data":
            n = struct.unpack_from("<I", data, p + 4)[0]
            p += 8 + n + (n & 1)
        return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]
    if kind == "bmp":
        start, _, w, h = struct.unpack_from("<IIii", data, 10)
        return data[start : start + w * abs(h)]
    p, body, w, h = 8, [], 0, 0
    while True:
        n, tag = struct.unpack_from(">I4s", data, p)
        if tag == b"IHDR":
            w, h = struct.unpack_from(">II", data, p + 8)
        elif tag == b"IDAT":
            body.append(data[p + 8 : p + 8 + n])
        elif tag == b"IEND":
            break
        p += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


KINDS = ("wav", "png", "bmp")
STORED = "doc_id bigint, declared string, media binary, n_bytes bigint"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _each(batches: Iterator[pa.RecordBatch], kind: str, columns: int, row, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Rows out of `row(*values)`, in batches of about `most` bytes of values."""
    schema, out, held = arrow_schema(kind), [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        for i in range(b.num_rows):
            for r in row(*(b.column(k)[i].as_py() for k in range(columns))):
                out.append(r)
                held += sum(len(x) for x in r if isinstance(x, bytes | str))
            if held > most or len(out) >= 5000:
                if out:
                    yield flush()
                out, held = [], 0
    if out:
        yield flush()


#: A picture of one pixel: what comes with a text's medium in one file, before or behind it, unless it is stored alone.
PIXEL = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02L\x01\x00;"


def encode_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, declared, media, n_bytes: each text as UTF-8, padded with zero bytes to a positive multiple of 64, stored as media.

    Format and file layout follow from the bytes (their CRC): the medium is alone, or has a small picture before or behind it. The declared
    type is always the first format's, so wrong for most.
    """

    def row(doc_id, text):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % ROW or (0 if raw else ROW))
        crc = zlib.crc32(payload)
        before, behind = ((b"", b""), (PIXEL, b""), (b"", PIXEL))[crc // len(KINDS) % 3]
        yield doc_id, KINDS[0], before + store(payload, KINDS[crc % len(KINDS)]) + behind, len(raw)

    return pick(df, id_col, text_col).mapInArrow(lambda it: _each(it, STORED, 2, row), STORED)


def inspect(df: DataFrame) -> DataFrame:
    """The features of a media column (doc_id, declared, media, n_bytes): the first medium that can hold samples is carved out of the file and
    read. media_bytes and media_sha256 are that medium's; feature names the file's true type and what else it embeds."""

    def row(doc_id, declared, media, n_bytes):
        pieces = sniff(media)
        found = next(x for x in pieces if x.kind in KINDS)
        medium = media[found.start : found.end]
        payload = read(medium, found.kind)
        samples = np.frombuffer(payload, np.uint8)
        distinct = np.count_nonzero(np.bincount(samples, minlength=256))
        others = ",".join(f"{x.kind}:{x.start}:{x.end}" for x in pieces if x is not found)
        kind, length, _ = true_type(media, declared, pieces)
        feature = f"type={found.kind};declared={declared};file={kind}:{length};samples={len(samples)};mean={samples.mean():.4f};distinct={distinct};embedded={others}"
        yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(medium), hashlib.sha256(medium).hexdigest(), feature

    return pick(df, "doc_id", "declared", "media", "n_bytes").mapInArrow(lambda it: _each(it, FEATURES, 4, row), FEATURES)


CARVED = "row_id bigint, declared string, type string, start bigint, length bigint, media binary"


def carve(df: DataFrame, id_col: str, bytes_col: str, declared_col: str) -> DataFrame:
    """row_id, declared, type, start, length, media: every confirmed piece of media in a binary column, in place order."""

    def row(row_id, data, declared):
        for x in sniff(data or b""):
            yield row_id, declared, x.kind, x.start, x.end - x.start, data[x.start : x.end]

    return pick(df, id_col, bytes_col, declared_col).mapInArrow(lambda it: _each(it, CARVED, 3, row), CARVED)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as media in a file, carved out of it, read back and described; see `encode_rows` and `inspect`.

    Null texts count as empty: 64 zero bytes. Equal texts give equal values; repeated rows and null ids stay rows of their
    own. Texts of any length are stored whole. An empty table gives an empty result. Columns beyond id and text are not read.
    """
    return inspect(encode_rows(df, id_col, text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
