"""Bytes: signatures in built-in expressions; containers in Arrow-batched functions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

#: Signatures (fixed values): kind, offset from 1, bytes.
SIGNATURES = [("otf", 1, "4F54544F"), ("ttf", 1, "00010000"), ("woff2", 1, "774F4632"), ("png", 1, "89504E470D0A1A0A"), ("jpeg", 1, "FFD8FF")]


def signature(b: Column) -> Column:
    out = F.when((F.hex(F.substring(b, 1, 4)) == "52494646") & (F.hex(F.substring(b, 9, 4)) == "57454250"), "webp")
    for kind, at, magic in SIGNATURES:
        out = out.when(F.hex(F.substring(b, at, len(magic) // 2)) == magic, kind)
    return out.otherwise("other")


def sum32(data: bytes) -> int:
    """Sum of the big-endian 32-bit words modulo 2**32, padded with zeros."""
    return int(np.frombuffer(data + b"\0" * (-len(data) % 4), ">u4").sum(dtype=np.uint64) & 0xFFFFFFFF)


@F.pandas_udf(LongType())
def checksum(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else sum32(bytes(b)))


def sfnt_tables(data: bytes) -> list[tuple[int, str, int, int, int]]:
    """(record offset, tag, checksum, offset, length) of the table directory; raises if it is cut short."""
    if len(data) < 12:
        raise ValueError("too short")
    n = int.from_bytes(data[4:6], "big")
    if len(data) < 12 + 16 * n:
        raise ValueError("directory cut short")
    out = []
    for at in range(12, 12 + 16 * n, 16):
        check, offset, length = np.frombuffer(data, ">u4", 3, at + 4).tolist()
        if offset + length > len(data):
            raise ValueError("table outside the file")
        out.append((at, data[at : at + 4].decode("latin-1"), check, offset, length))
    return out


def _table_sum(data: bytes, tag: str, offset: int, length: int) -> int:
    body = data[offset : offset + length]
    return sum32(body[:8] + b"\0\0\0\0" + body[12:]) if tag == "head" and length >= 12 else sum32(body)


def sfnt_errors(data: bytes) -> list[str]:
    try:
        rows = sfnt_tables(data)
    except ValueError as e:
        return [str(e)]
    bad = [f"{tag}: checksum" for _, tag, check, offset, length in rows if check != _table_sum(data, tag, offset, length)]
    heads = [offset for _, tag, _, offset, length in rows if tag == "head" and length >= 12]
    if heads:
        whole = data[: heads[0] + 8] + b"\0\0\0\0" + data[heads[0] + 12 :]
        if int.from_bytes(data[heads[0] + 8 : heads[0] + 12], "big") != (0xB1B0AFBA - sum32(whole)) & 0xFFFFFFFF:
            bad.append("file: adjustment")
    return bad


def sfnt_repaired(data: bytes) -> bytes:
    """The same file with right checksums."""
    out = bytearray(data)
    head = None
    for at, tag, _, offset, length in sfnt_tables(data):
        if tag == "head" and length >= 12:
            head = offset
            out[offset + 8 : offset + 12] = b"\0\0\0\0"
        out[at + 4 : at + 8] = _table_sum(data, tag, offset, length).to_bytes(4, "big")
    if head is not None:
        out[head + 8 : head + 12] = ((0xB1B0AFBA - sum32(bytes(out))) & 0xFFFFFFFF).to_bytes(4, "big")
    return bytes(out)


def without_metadata(data: bytes) -> bytes | None:
    """An image without its metadata; the same bytes if it has none; None if it can't be read."""
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    return None


#: Two bytes that end a scan's data: a marker other than a stuffed byte or a restart.
_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg_segments(data: bytes):
    """(marker, start, stop) of every segment up to the end marker, a scan's data with its header; raises if the file is cut short or broken."""
    at, kind = 2, 0
    while kind != 0xD9:
        lead = re.compile(rb"\xff+([^\x00\xff\xd8])").match(data, at)
        if not lead:
            raise ValueError("no marker")
        kind, start, at = lead[1][0], lead.end() - 2, lead.end()
        if kind not in (0xD9, 0x01, *range(0xD0, 0xD8)):
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > len(data):
                raise ValueError("segment cut short")
            at += size
        if kind == 0xDA:
            after = _AFTER_SCAN.search(data, at)
            if not after:
                raise ValueError("scan cut short")
            at = after.start()
        yield kind, start, at


def _jpeg(data: bytes) -> bytes | None:
    """Without APP1, APP13, comments, the index of further pictures and those pictures."""
    try:
        kept = [data[a:z] for kind, a, z in _jpeg_segments(data) if kind not in (0xE1, 0xED, 0xFE) and not (kind == 0xE2 and data[a + 4 : a + 8] == b"MPF\0")]
    except ValueError:
        return None
    return data[:2] + b"".join(kept)


def _png(data: bytes) -> bytes | None:
    out, at = [data[:8]], 8
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8]
        if end > len(data):
            return None
        if kind not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"):
            out.append(data[at:end])
        if kind == b"IEND":
            return b"".join(out)
        at = end
    return None


def _webp(data: bytes) -> bytes | None:
    out, at = [], 12
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + 8 + n + n % 2
        if at + 8 + n > len(data):
            return None
        if kind == b"VP8X":
            out.append(data[at : at + 8] + bytes([data[at + 8] & ~0x0C]) + data[at + 9 : end])
        elif kind not in (b"EXIF", b"XMP "):
            out.append(data[at:end])
        at = end
    body = b"WEBP" + b"".join(out)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


@F.pandas_udf(StringType())
def metadata_status(s: pd.Series) -> pd.Series:
    """clean, change or unreadable."""

    def one(b):
        kept = None if b is None else without_metadata(bytes(b))
        return "unreadable" if kept is None else "clean" if kept == bytes(b) else "change"

    return s.map(one)


@F.pandas_udf(BinaryType())
def stripped(s: pd.Series) -> pd.Series:
    """Images without their metadata; null for what can't be read."""
    return pd.Series([None if b is None else without_metadata(bytes(b)) for b in s], dtype=object)


DIRECTORY = ArrayType(StructType().add("tag", StringType()).add("checksum", LongType()).add("offset", LongType()).add("length", LongType()))


@F.pandas_udf(DIRECTORY)
def directory(s: pd.Series) -> pd.Series:
    """The table records of font files; null where they are cut short."""

    def one(b):
        try:
            return [dict(zip(("tag", "checksum", "offset", "length"), r[1:])) for r in sfnt_tables(bytes(b))]
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b) for b in s], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def font_errors(s: pd.Series) -> pd.Series:
    """What is wrong with the checksums of font files; null for null."""
    return pd.Series([None if b is None else sfnt_errors(bytes(b)) for b in s], dtype=object)


@F.pandas_udf(BinaryType())
def repaired(s: pd.Series) -> pd.Series:
    """Font files with right checksums; null where the records are cut short."""

    def one(b):
        try:
            return sfnt_repaired(bytes(b))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b) for b in s], dtype=object)
