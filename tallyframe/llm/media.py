"""Media columns: store bytes as media, and sniff, correct and carve media by signature.

An Aho-Corasick automaton over all known magic byte strings finds every place where a file could begin; a
format validator then walks the structure from there (chunk lengths, checksums, trailers) and either returns
the exact length or refuses. A declared type counts for nothing: the type is what validates at offset 0.

Defined cases: null text is the empty payload (one block of 64 zero bytes); null media gives a null type and no
carved parts; bytes that no validator accepts keep the declared type;
long texts are scanned whole, trailers and chains of blocks once for all signatures in them; equal bytes give equal results; other
columns of the input are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import slices

BLOCK = 64
OCTETS = "application/octet-stream"


class Notes:
    """What validators have learned about one byte string, so that no stretch of it is searched again for each signature in it."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.ends: dict[tuple[str, int], int | None] = {}

    def next(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from ``at`` on, or -1; all places are looked up once."""
        if what not in self.places:
            self.places[what] = [m.start() for m in re.finditer(re.escape(what), self.data)]
        i = bisect_left(self.places[what], at)
        return self.places[what][i] if i < len(self.places[what]) else -1

    def archive_ends(self) -> dict[int, list[int]]:
        """Start of an archive -> places of the end records that count back to it."""
        if self.archives is None:
            self.archives = {}
            for m in re.finditer(b"PK\x05\x06", self.data):
                if m.start() + 22 <= len(self.data):
                    size, start, _ = struct.unpack_from("<IIH", self.data, m.start() + 12)
                    self.archives.setdefault(m.start() - start - size, []).append(m.start())
        return self.archives

    archives: dict[int, list[int]] | None = None

    def walk(self, kind: str, pos: int | None, step: Callable[[int], int | None], last: Callable[[int], bool]) -> int | None:
        """The first place from ``pos`` on, by ``step``, where ``last`` holds; None if the walk leaves the data. Walks that meet are one."""
        seen, visited = self.ends, []
        while pos is not None and pos < len(self.data) and (kind, pos) not in seen:
            visited.append(pos)
            if last(pos):
                break
            pos = step(pos)
        end = seen[kind, pos] if (kind, pos) in seen else pos if pos is not None and pos < len(self.data) else None
        for v in visited:
            seen[kind, v] = end
        return end


def _riff(data: bytes, at: int, form: bytes) -> int | None:
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    pos = at + 12
    while pos + 8 <= end:
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return end - at if pos in (end, end + 1) else None


def _wav(data: bytes, at: int, notes: Notes) -> int | None:
    return _riff(data, at, b"WAVE")


def _avi(data: bytes, at: int, notes: Notes) -> int | None:
    return _riff(data, at, b"AVI ")


def _webp(data: bytes, at: int, notes: Notes) -> int | None:
    return _riff(data, at, b"WEBP")


def _png(data: bytes, at: int, notes: Notes) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size, kind = struct.unpack_from(">I", data, pos)[0], data[pos + 4 : pos + 8]
        body_end = pos + 8 + size
        if body_end + 4 > len(data) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(data[pos + 4 : body_end]) != struct.unpack_from(">I", data, body_end)[0]:
            return None
        pos, first = body_end + 4, False
        if kind == b"IEND":
            return pos - at
    return None


def _gif(data: bytes, at: int, notes: Notes) -> int | None:
    def skip_blocks(pos: int) -> int | None:
        end = notes.walk("gif", pos, lambda p: p + 1 + data[p], lambda p: data[p] == 0)
        return None if end is None else end + 1

    if len(data) < at + 13:
        return None
    flags = data[at + 10]
    pos: int | None = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos is not None and pos < len(data):
        if data[pos] == 0x3B:
            return pos + 1 - at
        if data[pos] == 0x21:
            pos = skip_blocks(pos + 2)
        elif data[pos] == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos = skip_blocks(pos + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int, notes: Notes) -> int | None:
    if len(data) < at + 30:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    sound = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if sound and 14 + header <= offset <= size <= len(data) - at else None


def _jpeg(data: bytes, at: int, notes: Notes) -> int | None:
    pos = at + 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xD9:
            return pos + 2 - at
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2:
            return None
        pos += 2 + size
        if marker == 0xDA:  # entropy-coded data runs to the next marker that is no restart and no stuffed byte
            while True:
                pos = data.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(data):
                    return None
                if data[pos + 1] != 0 and not 0xD0 <= data[pos + 1] <= 0xD7:
                    break
                pos += 2
    return pos + 2 - at if data[pos : pos + 2] == b"\xff\xd9" else None


def _gzip(data: bytes, at: int, notes: Notes) -> int | None:
    if len(data) < at + 18 or data[at + 3] & 0xE0:
        return None
    inflate, pos = zlib.decompressobj(31), at
    try:
        while pos < len(data) and not inflate.eof:
            inflate.decompress(data[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(data)) - len(inflate.unused_data) - at if inflate.eof else None


def _zip(data: bytes, at: int, notes: Notes) -> int | None:
    for pos in notes.archive_ends().get(at, []):
        size, start, comment = struct.unpack_from("<IIH", data, pos + 12)
        if data[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            end = pos + 22 + comment
            return end - at if end <= len(data) else None
    return None


def _pdf(data: bytes, at: int, notes: Notes) -> int | None:
    if not data[at + 5 : at + 8].replace(b".", b"", 1).isdigit():
        return None
    begin = notes.next(b"startxref", at)
    end = notes.next(b"%%EOF", begin) if begin >= 0 else -1
    return end + 5 - at if end >= 0 else None


def _midi(data: bytes, at: int, notes: Notes) -> int | None:
    if len(data) < at + 14 or struct.unpack_from(">I", data, at + 4)[0] != 6:
        return None
    tracks, pos = struct.unpack_from(">H", data, at + 10)[0], at + 14
    for _ in range(tracks):
        if data[pos : pos + 4] != b"MTrk" or pos + 8 > len(data):
            return None
        pos += 8 + struct.unpack_from(">I", data, pos + 4)[0]
    return pos - at if tracks and pos <= len(data) else None


def _ogg(data: bytes, at: int, notes: Notes) -> int | None:
    def after(pos: int) -> int | None:
        if data[pos : pos + 4] != b"OggS" or pos + 27 > len(data):
            return None
        table = data[pos + 27 : pos + 27 + data[pos + 26]]
        end = pos + 27 + len(table) + sum(table)
        return end if end <= len(data) else None

    last = notes.walk("ogg", at, after, lambda p: after(p) is not None and bool(data[p + 5] & 4))
    return None if last is None else after(last) - at


def _mp4(data: bytes, at: int, notes: Notes) -> int | None:
    pos, kinds = at, []
    while pos + 8 <= len(data):
        size, kind = struct.unpack_from(">I", data, pos)[0], data[pos + 4 : pos + 8]
        if size < 8 or pos + size > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += size
    return pos - at if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


#: Media type, magic bytes, their place from the start of the file, and the validator.
FORMATS: list[tuple[str, bytes, int, Callable[[bytes, int, Notes], int | None]]] = [
    ("audio/wav", b"RIFF", 0, _wav),
    ("video/x-msvideo", b"RIFF", 0, _avi),
    ("image/webp", b"RIFF", 0, _webp),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("audio/midi", b"MThd", 0, _midi),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
]
_AUTOMATON: ahocorasick.Automaton | None = None


def _automaton() -> ahocorasick.Automaton:
    """All magic strings in one automaton; bytes are passed as Latin-1, a code point for each byte."""
    global _AUTOMATON
    if _AUTOMATON is None:
        by_magic: dict[bytes, list[int]] = {}
        for i, (_, magic, _, _) in enumerate(FORMATS):
            by_magic.setdefault(magic, []).append(i)
        built = ahocorasick.Automaton()
        for magic, ids in by_magic.items():
            built.add_word(magic.decode("latin-1"), (len(magic), ids))
        built.make_automaton()
        _AUTOMATON = built
    return _AUTOMATON


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of every place in ``data`` where a whole, valid file lies, by start; nested ones too."""
    found, notes = [], Notes(data)
    for last, (size, ids) in _automaton().iter(data.decode("latin-1")):
        for i in ids:
            kind, _, before, validate = FORMATS[i]
            at = last + 1 - size - before
            if at >= 0 and (length := validate(data, at, notes)):
                found.append((at, length, kind))
    return sorted(found)


def pad_payload(text: bytes | None) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    raw = text or b""
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def wav_encode(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file; ``samples`` has an even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_decode(data: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    pos = 12
    while pos + 8 <= len(data):
        size = struct.unpack_from("<I", data, pos + 4)[0]
        if data[pos : pos + 4] == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def store_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_type: str = OCTETS) -> DataFrame:
    """A row for each document: id, n_bytes, declared_type and the payload stored as 8-bit samples in ``media``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x or b"") for x in raw], pa.int64()),
                    pa.array([declared_type] * len(raw), pa.string()),
                    pa.array([wav_encode(pad_payload(x)) for x in raw], pa.binary()),
                ],
                ["doc_id", "n_bytes", "declared_type", "media"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return slim.mapInArrow(encode, "doc_id long, n_bytes long, declared_type string, media binary")


def sniff(media: bytes | None, declared: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The type that validates over the start of ``media`` (else the declared one), and the files embedded further in."""
    if media is None:
        return None, []
    found = find_media(media)
    outer = max((x for x in found if x[0] == 0), key=lambda x: x[1], default=None)
    return (outer[2] if outer else declared), [x for x in found if x[0] > 0]


def _outermost(parts: list[tuple[int, int, str]]) -> list[tuple[tuple[int, int, str], bool]]:
    """Each carved file, and whether it reaches beyond all that begin before it; by start, the longest first."""
    out, end = [], 0
    for part in sorted(parts, key=lambda x: (x[0], -x[1])):
        out.append((part, part[0] + part[1] > end))
        end = max(end, part[0] + part[1])
    return out


def sniff_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """A row for each media value: id, declared_type, media_type, corrected, and the carved files themselves.

    A file that lies within another carved one is stated without its bytes, which are in that one's content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carved_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("content", pa.binary())]))
        for batch in slices(batches, 64):
            media, declared = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            got = [sniff(m, d) for m, d in zip(media, declared, strict=True)]
            carved = [[{"start": a, "length": n, "media_type": k, "content": m[a : a + n] if outermost else None} for (a, n, k), outermost in _outermost(parts)] for m, (_, parts) in zip(media, got, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([k for k, _ in got], pa.string()), pa.array([k is not None and k != d for (k, _), d in zip(got, declared, strict=True)], pa.bool_()), pa.array(carved, carved_type)],
                ["doc_id", "declared_type", "media_type", "corrected", "carved"],
            )

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), F.col(declared_col).alias("declared_type"))
    return slim.mapInArrow(run, "doc_id long, declared_type string, media_type string, corrected boolean, carved array<struct<start:long,length:long,media_type:string,content:binary>>")


def media_features(stored: DataFrame) -> DataFrame:
    """Read the stored bytes of ``store_as_media`` back and describe them.

    The feature string holds the confirmed type, the sample count and sum, and each carved file as
    type@start+length, starts counted in the payload.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "media_type"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for declared, media in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kind, parts = sniff(media, declared)
                if kind != "audio/wav":
                    raise ValueError(f"stored media is {kind}")
                payload = wav_decode(media)
                head = len(media) - len(payload)
                inner = ",".join(f"{k}@{a - head}+{n}" for a, n, k in parts if a >= head)
                feature = f"{kind};samples={len(payload)};sum={sum(payload)};carved={inner or '-'}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made[:6], batch.column(2), made[6]], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string"
    return stored.select("doc_id", "n_bytes", "declared_type", "media").mapInArrow(read, schema)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` as media, read back: one row each, nulls as the empty text."""
    return media_features(store_as_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
