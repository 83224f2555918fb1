"""Byte-string functions: comparison, prefixes, encodings and checksums.

Built-in expressions where they exist; varints, CRC32C and exclusive or of byte strings are Arrow functions over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

_TABLE: list[int] = []
MASK_DELTA = 0xA282EAD8


def _raw(k: Column) -> Column:
    return k.cast("binary")


def fixed_prefix(k: Column, n: int) -> Column:
    """The first n bytes, as binary; null, out of domain, for shorter keys."""
    return F.when(F.octet_length(k) >= n, F.substring(_raw(k), 1, n))


def capped_prefix(k: Column, n: int) -> Column:
    """The first n bytes, or all, as binary."""
    return F.substring(_raw(k), 1, n)


def noop_prefix(k: Column) -> Column:
    return k


def remove_prefix(k: Column, n: int) -> Column:
    return F.substring(_raw(k), F.lit(n + 1), F.octet_length(k))


def remove_suffix(k: Column, n: int) -> Column:
    return F.substring(_raw(k), F.lit(1), F.greatest(F.octet_length(k) - n, F.lit(0)))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes that two keys share: where they differ, if they do."""
    one, two = F.hex(_raw(a)), F.hex(_raw(b))
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(one, 2 * i - 1, F.lit(2)) != F.substring(two, 2 * i - 1, F.lit(2)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(at) - 1, n))


def encode_fixed(x: Column, size: int) -> Column:
    """Little-endian bytes of a long, its low ``size`` bytes (1, 2, 4 or 8)."""
    hexed = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(size)]))


def decode_fixed(b: Column, size: int) -> Column:
    """The long of little-endian bytes; 8 bytes read as signed."""
    hexed = F.hex(b)
    turned = F.concat(*[F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size)])
    if size < 8:
        return F.conv(turned, 16, 10).cast("long")
    return F.conv(turned, 16, -10).cast("long")


def is_stale(ts_s: Column, ttl: int, now: int) -> Column:
    return F.lit(False) if ttl <= 0 else (ts_s + ttl) < now


def append_ts(v: Column, ts_s: Column, size: int = 4) -> Column:
    """The value's bytes with a time in seconds behind them; a time that ``size`` bytes (4 or 8) can't hold is an error."""
    if size < 8:
        room = 1 << 8 * size
        over = F.raise_error(F.concat(F.lit(f"a time beyond {size} bytes: "), ts_s.cast("string"))).cast("long")
        ts_s = F.when((ts_s < 0) | (ts_s >= room), over).otherwise(ts_s)
    return F.concat(_raw(v), encode_fixed(ts_s, size))


def ts_of(v: Column, size: int = 4) -> Column:
    """The time that append_ts put behind a value."""
    return decode_fixed(F.substring(v, F.octet_length(v) - (size - 1), F.lit(size)), size)


def time_text(ts_s: Column) -> Column:
    """Seconds since 1970 as a dump writes them, in UTC whatever the session's zone."""
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_s / 86400).cast("int"))
    clock = F.pmod(ts_s, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.replace(at.cast("string"), F.lit("-"), F.lit("/")), F.lit("-"), two(clock / 3600), F.lit(":"), two(F.pmod(clock, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(clock, F.lit(60))))


def strip_ts(v: Column, size: int = 4) -> Column:
    return remove_suffix(v, size)


def until(x: Column, delimiter: str) -> Column:
    return F.substring_index(x, delimiter, 1)


def _bytes_fn(fn: Callable, kind: str, arrow: pa.DataType):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fn(x) for x in column.to_pylist()], arrow)

    return arrow_udf(run, kind)


def crc32c_of(data: bytes, start: int = 0) -> int:
    """CRC-32C (Castagnoli) of bytes; ``start`` extends the checksum of what came before."""
    if not _TABLE:
        for i in range(256):
            for _ in range(8):
                i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
            _TABLE.append(i)
    c = start ^ 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _TABLE[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def crc32c_all(values: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings, a byte of all of them at a time, the longest first."""
    crc32c_of(b"")
    table, n = np.array(_TABLE, np.uint32), np.array([len(v) for v in values], np.int64)
    order = np.argsort(-n, kind="stable")
    data, start = np.frombuffer(b"".join(values), np.uint8), np.cumsum(n) - n
    c, start, left = np.full(len(n), 0xFFFFFFFF, np.uint32), start[order], np.sort(n)[::-1]
    for i in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-left, -i))  # as many are longer than i
        c[:k] = (c[:k] >> np.uint32(8)) ^ table[(c[:k] ^ data[start[:k] + i]) & np.uint32(0xFF)]
    out = np.empty(len(n), np.int64)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(b: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        values = column.cast(pa.binary()).to_pylist()
        return pa.array(crc32c_all([x or b"" for x in values]), pa.int64(), mask=np.array([x is None for x in values], bool))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, "bigint")(b)


def mask_crc(c: Column) -> Column:
    """A checksum that is stored: rotated right by 15 bits, plus a constant."""
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (turned + MASK_DELTA) % (1 << 32)


def unmask_crc(m: Column) -> Column:
    turned = F.pmod(m - MASK_DELTA, F.lit(1 << 32))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15).bitwiseAND(F.lit(0xFFFFFFFF)))


def varint_of(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def of_varint(b: bytes) -> int | None:
    """The signed long of a varint at the start of the bytes; null where it doesn't end within them or 64 bits."""
    x = 0
    for i, c in enumerate(b[:10]):
        x |= (c & 127) << (7 * i)
        if c < 128:
            x &= (1 << 64) - 1
            return x - (1 << 64) if x >> 63 else x
    return None


def encode_varint(x: Column) -> Column:
    """Bytes of a long as a varint, by built-in expressions: seven bits a byte, the lowest first, the high bit where more follow."""
    more = lambda i: F.shiftrightunsigned(x, 7 * (i + 1)) != 0
    two = lambda y: F.lpad(F.hex(y), 2, "0")
    parts = []
    for i in range(10):
        low = F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127)) if i < 9 else F.shiftrightunsigned(x, 63)
        last = two(low) if i == 9 else two(F.when(more(i), low + 128).otherwise(low))
        parts.append(last if i == 0 else F.when(F.shiftrightunsigned(x, 7 * i) != 0, last).otherwise(F.lit("")))
    return F.unhex(F.concat(*parts))


def of_varints(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longs of many varints, a byte of all of them at a time, and which of them end within their bytes or ten."""
    heads = [v[:10] for v in values]
    n = np.array([len(v) for v in heads], np.int64)
    data, start = np.frombuffer(b"".join(heads) + bytes(1), np.uint8), np.cumsum(n) - n
    x, open_ = np.zeros(len(n), np.uint64), n > 0
    for i in range(10):
        at = np.flatnonzero(open_ & (n > i))
        c = data[start[at] + i].astype(np.uint64)
        x[at] |= (c & np.uint64(127)) << np.uint64(7 * i)
        open_[at] = c >= 128
    return x.view(np.int64), (n > 0) & ~open_


def decode_varint(b: Column) -> Column:
    """The signed long of a varint at the start of the bytes; null where it doesn't end within them or ten bytes."""

    def run(column: pa.Array) -> pa.Array:
        x, ok = of_varints([v or b"" for v in column.to_pylist()])
        return pa.array(x, pa.int64(), mask=~ok)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, "bigint")(b)


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1))))


def encode_slice(b: Column) -> Column:
    """The bytes after their length as a varint."""
    return F.concat(encode_varint(F.octet_length(b).cast("long")), b)


def decode_slice(b: Column) -> Column:
    def run(x: bytes) -> bytes | None:
        n = of_varint(x)
        head = len(varint_of(n)) if n is not None else 0
        return None if n is None or n < 0 or len(x) < head + n else x[head : head + n]

    return _bytes_fn(run, "binary", pa.binary())(b)


def separator_of(a: bytes, b: bytes) -> bytes:
    """A short key in [a, b)."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if n < min(len(a), len(b)) and a[n] < 255 and a[n] + 1 < b[n]:
        return a[:n] + bytes([a[n] + 1])
    return a


def successor_of(a: bytes) -> bytes:
    """A short key at or after a."""
    n = next((i for i, x in enumerate(a) if x != 255), None)
    return a if n is None else a[:n] + bytes([a[n] + 1])
