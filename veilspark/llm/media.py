"""Media columns: Aho-Corasick signature sniffing, format validators, carving, lossless sample storage."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fed, kept, slices

# Fixed values of the file formats: magic bytes, their place in the file, and the format's name.
SIGNATURES = [
    (b"RIFF", 0, "riff"), (b"\x89PNG\r\n\x1a\n", 0, "png"), (b"GIF87a", 0, "gif"), (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"), (b"BM", 0, "bmp"), (b"%PDF-", 0, "pdf"), (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"), (b"OggS", 0, "ogg"), (b"fLaC", 0, "flac"), (b"ftyp", 4, "mp4"),
]


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    """WAVE, AVI or WebP: chunks fill the declared length exactly; a WAVE has fmt before data."""
    if at + 12 > len(b):
        return None
    end, form = at + 8 + struct.unpack_from("<I", b, at + 4)[0], b[at + 8 : at + 12]
    name = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}.get(form)
    if not name or end > len(b):
        return None
    pos, seen = at + 12, []
    while pos + 8 <= end:
        kind, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        seen.append(kind)
        pos += 8 + size + size % 2
    if pos not in (end, end + 1) or not seen:
        return None
    if name == "wav" and (seen[0] != b"fmt " or b"data" not in seen):
        return None
    return name, end


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        stop = pos + 12 + size
        if stop > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[pos + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return "png", stop
        pos, first = stop, False
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    """Screen descriptor, colour tables and blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    flags, pos = b[at + 10], at + 13

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(pos: int) -> int | None:
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        return pos + 1 if pos < len(b) else None

    pos += table(flags)
    while pos is not None and pos < len(b):
        if b[pos] == 0x3B:
            return "gif", pos + 1
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos = blocks(pos + 10 + table(b[pos + 9]) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """Segments with lengths, a start of scan, and the end marker after its data."""
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if kind in (0xFF, 0xD8, 0xD9, 0x00) or size < 2:
            return None
        pos += 2 + size
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return ("jpeg", end + 2) if end >= 0 else None
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    """File size within the bytes, reserved fields zero, a known header size, pixels inside the file."""
    if at + 30 > len(b):
        return None
    size, a, c, pixels, header = struct.unpack_from("<IHHII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    fine = not a and not c and header in (40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("bmp", at + size) if fine and 14 + header <= pixels <= size <= len(b) - at else None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """A version digit, a cross-reference pointer and the end mark; of a file saved in steps the last one's, each with a pointer of its own."""
    end = begin = at
    while (mark := b.find(b"%%EOF", begin)) >= 0 and b.find(b"startxref", begin, mark) >= 0 and (begin == at or b.find(b"%PDF-", begin, mark) < 0):
        end = begin = mark + 5
    return ("pdf", end) if end > at and b[at + 5 : at + 6].isdigit() else None


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    """The first end record whose directory lies where it says, counted from this signature: not one of an archive stored inside."""
    end = at
    while (end := b.find(b"PK\x05\x06", end)) >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if at + offset + size == end and b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
            return "zip", end + 22 + note
        end += 4
    return None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    """A stream that inflates, piece by piece, to its end and checksum."""
    tool, pos = zlib.decompressobj(31), at
    try:
        while not tool.eof and pos < len(b):
            tool.decompress(b[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return None
    return ("gzip", min(pos, len(b)) - len(tool.unused_data)) if tool.eof else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    """Pages one after another, the first of them beginning a stream."""
    pos = at
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        if pos == at and not b[pos + 5] & 2:
            return None
        n = b[pos + 26]
        stop = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + 27 + n > len(b) or stop > len(b):
            return None
        pos = stop
    return ("ogg", pos) if pos > at else None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    """Checksums of single bytes, by long division by the polynomial."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        rest = byte << (bits - 8)
        for _ in range(8):
            rest = (rest << 1 ^ (polynomial if rest & top else 0)) & mask
        out.append(rest)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(samples, end of the header) of a frame whose header has the sync code and its checksum."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, number = b[at + 2] >> 4, b[at + 2] & 15, b[at + 4]
    pos = at + 4 + (1 if number < 0x80 else 8 - (number ^ 0xFF).bit_length())
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(b[pos : pos + extra], "big") + 1 if extra else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    pos += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for x in b[at:pos]:
        check = _CRC8[check ^ x]
    return (samples, pos + 1) if size and pos < len(b) and check == b[pos] else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks from STREAMINFO to the last, then frames: each ends where its checksum holds, and another begins or all samples are there."""
    pos, first, last = at + 4, True, False
    least = most = total = 0
    while pos + 4 <= len(b) and not last:
        last, kind, size = bool(b[pos] & 0x80), b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first:
            if kind or size != 34 or pos + 38 > len(b):
                return None
            info = b[pos + 4 : pos + 38]
            least, most, total = int.from_bytes(info[4:7], "big"), int.from_bytes(info[7:10], "big"), int.from_bytes(info[13:18], "big") & (1 << 36) - 1
        pos, first = pos + 4 + size, False
    if not last or pos > len(b) or not total:
        return None
    samples = 0
    while samples < total:
        frame = _flac_frame(b, pos)
        if frame is None:
            return None
        samples += frame[0]
        check, begin = 0, pos
        for pos in range(begin, min(len(b), begin + most if most else len(b))):
            check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ b[pos]]
            if not check and pos + 1 - begin >= max(least, frame[1] - begin + 3) and (samples >= total or _flac_frame(b, pos + 1)):
                break
        else:
            return None
        pos += 1
    return "flac", pos


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    """Boxes with lengths from ftyp on, a moov or mdat among them."""
    pos, kinds = at, []
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if size < 8 or pos + size > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += size
    return ("mp4", pos) if {b"moov", b"mdat"} & set(kinds) else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip,
    "gzip": _gzip, "ogg": _ogg, "flac": _flac, "mp4": _mp4,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    tool = ahocorasick.Automaton()
    for magic, place, name in SIGNATURES:
        tool.add_word(magic.decode("latin-1"), (len(magic), place, name))
    tool.make_automaton()
    return tool


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(format, start, end) of all media in ``data``, by start: what a validator confirms, none inside another.

    One Aho-Corasick pass finds all magic bytes. A file inside a confirmed one belongs to it, unless
    that one is a WAVE, whose samples may be anything: files among them are carved as well.
    """
    found, busy = [], 0
    hits = sorted({(stop + 1 - size - place, name) for stop, (size, place, name) in _automaton().iter(data.decode("latin-1"))})
    for at, name in hits:
        if at < busy or at < 0:
            continue
        if got := VALIDATORS[name](data, at):
            found.append((got[0], at, got[1]))
            busy = at + 44 if got[0] == "wav" else got[1]
    return found


def sniffed(data: bytes | None, declared: str | None) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """Right type of a media value, whether its declared type was wrong, and the media embedded in it.

    The type is that of a confirmed file at byte 0, else ``unknown``, and then a declared type counts
    as wrong unless null. Null and empty values are ``empty`` with nothing embedded.
    """
    if not data:
        return "empty", declared is not None and declared != "empty", []
    found = sniff(data)
    kind = found[0][0] if found and found[0][1] == 0 else "unknown"
    return kind, declared is not None and declared != kind, [x for x in found if x[1] > 0]


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM in a WAVE container; the samples are an even number of bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(data: bytes) -> bytes:
    """The samples of a WAVE, found by walking its chunks; an error if it isn't a whole one."""
    if not (got := _riff(data, 0)) or got[0] != "wav":
        raise ValueError("not a WAVE")
    pos = 12
    while data[pos : pos + 4] != b"data":
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + size % 2
    return data[pos + 8 : pos + 8 + struct.unpack_from("<I", data, pos + 4)[0]]


def _sniffed(parts: Iterator[pa.RecordBatch], keep: list[str], content: str, declared: str | None) -> Iterator[pa.RecordBatch]:
    """What :func:`sniff_media` does to Arrow batches of the columns ``keep``."""
    kind = pa.list_(pa.struct([("format", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
    for part in slices(parts):
        values = part.column(keep.index(content)).to_pylist()
        said = part.column(keep.index(declared)).to_pylist() if declared else [None] * len(values)
        got = [sniffed(v, d) for v, d in zip(values, said, strict=True)]
        inside = [
            [{"format": f, "start": a, "length": b - a, "sha256": hashlib.sha256(v[a:b]).hexdigest()} for f, a, b in g[2]]
            for v, g in zip(values, got, strict=True)
        ]
        columns = [*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array(inside, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "media_type", "type_corrected", "carved"])


def sniff_media(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """``df`` with media_type, type_corrected and carved (array of format, start, length, sha256).

    ``content`` is a binary column; ``declared`` a column of declared types, or None. Columns of ``df``
    with the new names are replaced. See :func:`sniffed` for nulls. Values are looked at one by one, whole.
    """
    from pyspark.sql.types import _parse_datatype_string

    carved = "array<struct<format:string,start:long,length:long,sha256:string>>"
    keep = [c for c in df.columns if c not in ("media_type", "type_corrected", "carved")]
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add("media_type", "string").add("type_corrected", "boolean")
    schema = schema.add("carved", _parse_datatype_string(carved))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sniffed(parts, keep, content, declared)

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _stored(parts: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """What :func:`store_texts` does to Arrow batches of the columns ``keep`` and the text."""
    for part in slices(parts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(len(keep)).to_pylist()]
        media = [to_wav(r + bytes(max(1, -(-len(r) // 64)) * 64 - len(r))) for r in raw]
        yield pa.RecordBatch.from_arrays(
            [*part.columns[: len(keep)], pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())],
            names=[*keep, "n_bytes", "media"],
        )


def store_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Texts as WAVE samples: ``keep`` columns (but any of the new names), n_bytes and media (binary).

    A text's UTF-8 bytes (a null text: none) are padded with bytes 0 to a positive multiple of 64.
    """
    keep, columns = kept(keep, ["n_bytes", "media"])
    schema = docs.select(*columns).schema.add("n_bytes", "long").add("media", "binary")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stored(parts, keep)

    return fed(docs, columns).mapInArrow(run, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit samples, sniffed, read back and measured.

    The values are declared ``unknown``; sniffing corrects that to ``wav`` and carves what the samples
    hold. All steps of a batch are taken in one Python worker, as values passed between two would lie in both and
    in the JVM. feature: type, whether corrected, rate, samples, sum of samples, carved files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["doc_id", "n_bytes", "media", "declared"]
        stored = _stored(parts, names[:1])
        said = (pa.RecordBatch.from_arrays([*x.columns, pa.array(["unknown"] * x.num_rows, pa.string())], names=names) for x in stored)
        for part in _sniffed(said, names, "media", "declared"):
            rows = []
            for r in part.to_pylist():
                data = r["media"]
                payload = from_wav(data)
                inside = ",".join(f"{c['format']}@{c['start']}+{c['length']}" for c in r["carved"])
                total = int(np.frombuffer(payload, np.uint8).sum())
                rate = struct.unpack_from("<I", data, 24)[0]
                rows.append({
                    "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                    "feature": f"{r['media_type']};corrected={int(r['type_corrected'])};rate={rate};samples={len(payload)};sum={total};carved={inside}",
                })
            out = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(out, kinds, strict=True)], names=out)

    return fed(docs, [F.col("doc_id")]).mapInArrow(run, schema)
