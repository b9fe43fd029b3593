"""Partition transforms of table formats as column expressions.

``bucket`` needs 32-bit Murmur3 with seed 0 over a value's canonical bytes; the
engine's own hash has another seed, so it is computed with numpy over Arrow batches.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public constants of Murmur3 for 32 bits.
_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
_M5, _F1, _F2 = np.uint32(0xE6546B64), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scramble(k: np.ndarray) -> np.ndarray:
    return _rotate(k * _C1, 15) * _C2


def _finish(h: np.ndarray, length) -> np.ndarray:
    h = h ^ np.asarray(length, np.uint32)
    h = (h ^ (h >> np.uint32(16))) * _F1
    h = (h ^ (h >> np.uint32(13))) * _F2
    return h ^ (h >> np.uint32(16))


def murmur3_long(values: np.ndarray) -> np.ndarray:
    """Of 64-bit little-endian values."""
    v = values.astype(np.int64).view(np.uint64)
    h = np.zeros(len(v), np.uint32)
    for part in ((v & np.uint64(0xFFFFFFFF)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint32)):
        h = _rotate(h ^ _scramble(part), 13) * np.uint32(5) + _M5
    return _finish(h, 8)


def murmur3_bytes(data: bytes) -> int:
    n = len(data)
    h = np.zeros(1, np.uint32)
    for word in np.frombuffer(data[: n - n % 4], "<u4"):
        h = _rotate(h ^ _scramble(np.array([word], np.uint32)), 13) * np.uint32(5) + _M5
    if n % 4:
        h = h ^ _scramble(np.array([int.from_bytes(data[n - n % 4 :], "little")], np.uint32))
    return int(_finish(h, n)[0])


def bucket(column: Column, n: int, kind: str = "long") -> Column:
    """Bucket of long (also int, date, timestamp in microseconds as long), string or binary values."""
    if kind in ("string", "binary"):

        @F.pandas_udf("int")
        def of_bytes(s: pd.Series) -> pd.Series:
            hashes = [None if x is None else (murmur3_bytes(x.encode() if isinstance(x, str) else bytes(x)) & 0x7FFFFFFF) % n for x in s]
            return pd.Series(hashes, dtype="Int32")

        return of_bytes(column)

    @F.pandas_udf("int")
    def of_longs(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series(pd.array([pd.NA] * len(s), dtype="Int32"))
        hashes = murmur3_long(s[there].to_numpy().astype(np.int64))
        out[there.to_numpy()] = ((hashes & np.uint32(0x7FFFFFFF)) % np.uint32(n)).astype(np.int32)
        return out

    return of_longs(column.cast("long"))


def truncate(column: Column, width: int, kind: str = "long") -> Column:
    """Numbers down to a multiple of the width; strings by code points; binary by bytes; decimals by their unscaled value."""
    if kind == "string":
        return F.substring(column, 1, width)
    if kind == "binary":
        return F.substring(column, 1, width)
    if kind.startswith("decimal"):
        scale = int(re.search(r",\s*(\d+)", kind)[1])
        unit = F.lit(width).cast("decimal(38,0)") * F.lit(10**-scale if not scale else f"1e-{scale}").cast(f"decimal(38,{scale})")
        return column - F.pmod(column, unit.cast(f"decimal(38,{scale})"))
    return column - F.pmod(column, F.lit(width))


def year(column: Column) -> Column:
    return F.year(column) - 1970


def month(column: Column) -> Column:
    return (F.year(column) - 1970) * 12 + F.month(column) - 1


def day(column: Column) -> Column:
    return F.unix_date(column.cast("date"))


def hour(column: Column) -> Column:
    return F.floor(F.unix_micros(column.cast("timestamp")) / 3_600_000_000).cast("int")


def apply(name: str, column: Column, kind: str = "long") -> Column:
    """A transform by its name: identity, void, bucket[N], truncate[W], year, month, day, hour."""
    if name == "identity":
        return column
    if name == "void":
        return F.lit(None)
    if m := re.fullmatch(r"(bucket|truncate)\[(\d+)\]", name):
        return (bucket if m[1] == "bucket" else truncate)(column, int(m[2]), kind)
    return {"year": year, "month": month, "day": day, "hour": hour}[name](column)


def lower_bound(value, width: int):
    """The prefix that is at most the value."""
    return value[:width]


def upper_bound(value, width: int):
    """A short value that is at least ``value``: itself, or its prefix with the last place raised; None if none can be."""
    if len(value) <= width:
        return value
    prefix = value[:width]
    top = 255 if isinstance(value, bytes) else 0x10FFFF
    for at in range(len(prefix) - 1, -1, -1):
        code = prefix[at] if isinstance(value, bytes) else ord(prefix[at])
        if code < top:
            code += 1
            if not isinstance(value, bytes) and 0xD800 <= code <= 0xDFFF:
                code = 0xE000
            return prefix[:at] + (bytes([code]) if isinstance(value, bytes) else chr(code))
    return None


def metrics_mode(column: str, default: str = "truncate(16)", overrides: dict[str, str] | None = None) -> str:
    """none, counts, truncate(n) or full; a column's own setting comes first."""
    return (overrides or {}).get(column, default)


def truncated_bounds(column: Column, width: int) -> tuple[Column, Column]:
    """Lower and upper bound of a string column's values, cut to a width; null where no upper one exists."""

    @F.pandas_udf("string")
    def upper(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else upper_bound(x, width))

    return F.substring(column, 1, width), upper(column)


def column_metrics(df: DataFrame, default: str = "truncate(16)", overrides: dict[str, str] | None = None) -> DataFrame:
    """(column, n, low, high) of each column as its metrics mode allows: a column in mode none has no row."""
    rows = []
    for c in df.columns:
        mode = metrics_mode(c, default, overrides)
        if mode == "none":
            continue
        low, high = F.min(c).cast("string"), F.max(c).cast("string")
        if mode == "counts":
            low = high = F.lit(None).cast("string")
        elif m := re.fullmatch(r"truncate\((\d+)\)", mode):
            if df.schema[c].dataType.simpleString() == "string":
                low, high = F.substring(low, 1, int(m[1])), F.concat(F.lit(f"{int(m[1])}:"), high)
        rows.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), low.alias("low"), high.alias("high")))
    out = df.agg(F.array(*rows).alias("m")).select(F.explode("m").alias("m")).select("m.*")

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:  # a row a column
        return s.map(lambda x: upper_bound(x.split(":", 1)[1], int(x.split(":", 1)[0])) if x is not None and re.match(r"\d+:", x) else x)

    return out.withColumn("high", cut("high"))
