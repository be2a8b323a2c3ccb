"""Column expressions and Arrow functions on stored bytes: integers, floats, bit fields, Morton points, text and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def le_unsigned(data: Column, offset: Column | int, size: int) -> Column:
    """A little-endian unsigned integer of 1 to 7 bytes as BIGINT; NULL where bytes lack."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    total = F.lit(0).cast("long")
    for i in range(size):
        byte = F.conv(F.hex(F.substring(data, offset + i + 1, 1) if isinstance(offset, int) else data.substr((offset + i + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        total = total + F.shiftleft(byte, 8 * i)
    return total


def le_signed(data: Column, offset: Column | int, size: int) -> Column:
    value, half = le_unsigned(data, offset, size), 1 << (8 * size - 1)
    return F.when(value >= half, value - (half << 1)).otherwise(value)


@pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("raw_hex", T.StringType())]))
def float_evidence(data: pd.Series) -> pd.DataFrame:
    """4 or 8 little-endian bytes as a double, its shortest decimal that gives the same bytes (or inf, nan), and the bytes.

    The value alone can't tell -0.0 or payloads of NaN apart: group by raw_hex.
    """
    rows = []
    for x in data:
        if x is None or len(x) not in (4, 8):
            rows.append((None, None, None if x is None else bytes(x).hex()))
            continue
        value = struct.unpack("<f" if len(x) == 4 else "<d", x)[0]
        text = str(np.float32(value)) if len(x) == 4 and np.isfinite(value) else repr(value)
        rows.append((value, text, bytes(x).hex()))
    return pd.DataFrame(rows, columns=["value", "text", "raw_hex"])


def bit_field(word: Column, offset: Column | int, width: Column | int) -> Column:
    """Unsigned bits [offset, offset + width) of a word."""
    offset, width = (F.lit(x) if isinstance(x, int) else x for x in (offset, width))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int")) - 1
    return F.call_function("shiftrightunsigned", word.cast("long"), offset.cast("int")).bitwiseAND(mask)


def signed_bits(value: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    half = F.call_function("shiftleft", F.lit(1).cast("long"), (width - 1).cast("int"))
    return F.when(value >= half, value - half * 2).otherwise(value)


def align_up(value: Column, to: int = 4) -> Column:
    return ((value + (to - 1)) / to).cast("long") * to


def metadata_key(page: Column, kind: str) -> Column:
    """The key of a page's metadata entry."""
    if kind == "group":
        return F.shiftleft(page.bitwiseAND(F.lit(~15)), 5) + 1
    return F.shiftleft(page, 5) + {"tags": 16, "huge": 17, "pointers": 18}[kind]


def pointer_offset(high: Column, low: Column) -> Column:
    """22 low bits below the high units."""
    return F.shiftleft(high.cast("long"), 22).bitwiseOR(low.cast("long").bitwiseAND(F.lit((1 << 22) - 1)))


def morton_part(value: Column, axis: int) -> Column:
    """The bits of one of three interleaved axes of a non-negative long: up to 21 bits."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", value, i * 3 + axis).bitwiseAND(F.lit(1)).cast("long"), i)))


def morton_interleave(x: Column, y: Column, z: Column) -> Column:
    spread = lambda v, axis: F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", v.cast("long"), i).bitwiseAND(F.lit(1)).cast("long"), i * 3 + axis)))
    return spread(x, 0).bitwiseOR(spread(y, 1)).bitwiseOR(spread(z, 2))


#: Greatest quantised coordinate that witnesses confirm: all even bits of 32.
LARGEST = 0x55555555


def dequantised(low: Column, high: Column, q: Column) -> Column:
    return low + (high - low) * q / F.lit(float(LARGEST))


def latin1(data: Column) -> Column:
    """Bytes up to the first NUL as text, one character a byte."""
    text = F.decode(data, "ISO-8859-1")
    return F.substring_index(text, "\0", 1)


def text_status(data: Column, most: int) -> Column:
    """Whether a stored text ends within its bytes, its bound, or not at all."""
    at = F.instr(F.decode(data, "ISO-8859-1"), "\0")
    return F.when(at > 0, "TERMINATED").when(F.octet_length(data) >= most, "TEXT_BOUND").otherwise("ALLOCATION_END")


def symbolic_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9]+\]", "[]")


def template_argument(name: Column, template: str) -> Column:
    """T of a name like template<T*>, else NULL."""
    found = F.regexp_extract(name, rf"^{template}<\s*([^<>]+?)\s*\*\s*>$", 1)
    return F.when(found != "", found)


def address_text(segment: Column, cluster: Column, offset: Column) -> Column:
    return F.format_string("s%d_c%d_o%s", segment, cluster, F.lower(F.hex(offset)))


def parsed_address(text: Column) -> Column:
    """STRUCT(segment, cluster, offset) of seg:cluster:offset in decimal or 0x hexadecimal, else NULL."""
    part = lambda i: F.element_at(F.split(text, ":"), i)
    number = lambda p: F.when(p.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(p, 3, 15), 16, 10)).when(p.rlike("^[0-9]{1,18}$"), p).cast("long")
    whole = text.rlike("^(0[xX][0-9a-fA-F]{1,15}|[0-9]{1,18})(:(0[xX][0-9a-fA-F]{1,15}|[0-9]{1,18})){2}$")
    return F.when(whole, F.struct(number(part(1)).alias("segment"), number(part(2)).alias("cluster"), number(part(3)).alias("offset")))


# Canonical JSON


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, UTF-8, no NaN; bytes as an object with their hex."""

    def plain(x: Any) -> Any:
        if isinstance(x, (bytes, bytearray, memoryview)):
            return {"encoding": "hex", "data": bytes(x).hex()}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def row_frame(values: list[Any]) -> bytes:
    """A row as its proof takes it: 8 bytes of length, big-endian, and the canonical JSON of its columns."""
    data = canonical(values).encode()
    return struct.pack(">Q", len(data)) + data


def json_depth(text: str, most: int = 64) -> int:
    """Objects and arrays within one another in a JSON text, level by level; refuses what is deeper, not JSON, or not finite."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    level, deep = [json.loads(text, parse_constant=refuse)], 0
    while level := [x for x in level if isinstance(x, (dict, list))]:
        deep += 1
        if deep > most:
            raise ValueError("RESOURCE_LIMIT: the document is nested too deep")
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x)]
    return deep


@pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; NULL for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t, parse_constant=lambda n: 1 / 0))
        except (ValueError, ZeroDivisionError, RecursionError):
            return None

    return text.map(one, na_action=None)


def packed_blob(raw: bytes, level: int = 6) -> tuple[str, bytes, str]:
    """(codec, data, digest): compressed where that is smaller."""
    small = zlib.compress(raw, level)
    return ("zlib", small, hashlib.sha256(raw).hexdigest()) if len(small) < len(raw) else ("raw", raw, hashlib.sha256(raw).hexdigest())


@pandas_udf(T.StructType([T.StructField("codec", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("sha256", T.StringType())]))
def packed_blobs(raw: pd.Series) -> pd.DataFrame:
    """packed_blob of each value; NULL in every part for NULL."""
    return pd.DataFrame([(None, None, None) if x is None else packed_blob(bytes(x)) for x in raw], columns=["codec", "data", "sha256"])


@pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("status", T.StringType())]))
def unpacked_blob(codec: pd.Series, data: pd.Series, raw_length: pd.Series, sha256: pd.Series) -> pd.DataFrame:
    """The bytes of blobs, inflated to at most their stated length and checked against length and digest; MALFORMED_BLOB where a part is NULL."""
    rows = []
    for c, d, n, s in zip(codec, data, raw_length, sha256, strict=True):
        if d is None or pd.isna(n):
            rows.append((None, "MALFORMED_BLOB"))
            continue
        try:
            if c == "zlib":
                z = zlib.decompressobj()
                raw = z.decompress(bytes(d), int(n) + 1)
                whole = z.eof and not z.unused_data
            else:
                raw, whole = bytes(d), c == "raw"
        except zlib.error:
            raw, whole = b"", False
        if not whole or len(raw) != n:
            rows.append((None, "MALFORMED_BLOB"))
        elif hashlib.sha256(raw).hexdigest() != s:
            rows.append((None, "DIGEST_MISMATCH"))
        else:
            rows.append((raw, "VERIFIED"))
    return pd.DataFrame(rows, columns=["data", "status"])


INTERPRETATION = ("UNSUPPORTED", "UNKNOWN", "UNRESOLVED", "RESOURCE_BOUND")


def facets(value: Any) -> dict[str, int]:
    """How many nodes of a decoded value are leaves, resolved, or left open for a reason, counted separately."""
    out = {"nodes": 0, "fields": 0, "open": 0}

    def see(x: Any) -> None:
        if isinstance(x, dict):
            out["nodes"] += 1
            status = x.get("status")
            if isinstance(status, str):
                out["fields"] += 1
                out["open"] += status.startswith(INTERPRETATION)
            for v in x.values():
                see(v)
        elif isinstance(x, list):
            for v in x:
                see(v)

    see(value)
    return out


@pandas_udf(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("status", T.StringType())]))
def depth_of_json(text: pd.Series) -> pd.DataFrame:
    """How deep JSON texts are nested: READ, RESOURCE_BOUND beyond 64 levels, or MALFORMED_SOURCE."""
    rows = []
    for t in text:
        try:
            rows.append((None, "NULL") if t is None else (json_depth(t), "READ"))
        except (ValueError, RecursionError) as e:
            rows.append((None, "RESOURCE_BOUND" if "RESOURCE_LIMIT" in str(e) or isinstance(e, RecursionError) else "MALFORMED_SOURCE"))
    return pd.DataFrame(rows, columns=["depth", "status"])


def bounded_json(text: Column, most: int) -> Column:
    """STRUCT(json, bytes, status): the canonical form of a JSON text if it has at most so many bytes; never a part of it."""
    made = canonical_json(text)
    size = F.octet_length(made).cast("long")
    status = F.when(text.isNull(), "NULL").when(made.isNull(), "MALFORMED_SOURCE").when(size > most, "RESOURCE_BOUND").otherwise("WRITTEN")
    return F.struct(F.when(size <= most, made).alias("json"), size.alias("bytes"), status.alias("status"))


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as UTC, for headers alone: what a stored number counts isn't proven."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
