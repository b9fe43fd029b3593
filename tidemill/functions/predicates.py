"""Predicates as a small algebra: to columns for rows, and to file skipping from statistics.

Negation is pushed to the leaves before skipping, so NOT is sound: a file is skipped
only if no row of it can match.  Literals take the column's type, so values of
different types are never compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """op: = != < <= > >= in not_in is_null not_null is_nan not_nan starts_with not_starts_with."""

    op: str
    name: str
    value: Any = None


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


TRUE, FALSE = Leaf("true", ""), Leaf("false", "")
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "in": "not_in", "not_in": "in", "is_null": "not_null", "not_null": "is_null", "is_nan": "not_nan", "not_nan": "is_nan", "starts_with": "not_starts_with", "not_starts_with": "starts_with", "true": "false", "false": "true"}


def pushed(e):
    """The same predicate with negation in the leaves and constants folded."""
    if isinstance(e, Not):
        x = e.inner
        if isinstance(x, Not):
            return pushed(x.inner)
        if isinstance(x, Leaf):
            return Leaf(_OPPOSITE[x.op], x.name, x.value)
        both = (Or if isinstance(x, And) else And)(Not(x.left), Not(x.right))
        return pushed(both)
    if isinstance(e, Leaf):
        return e
    a, b = pushed(e.left), pushed(e.right)
    stop, pass_ = (FALSE, TRUE) if isinstance(e, And) else (TRUE, FALSE)
    if stop in (a, b):
        return stop
    if a == pass_:
        return b
    return a if b == pass_ else type(e)(a, b)


def to_column(e) -> Column:
    if isinstance(e, And):
        return to_column(e.left) & to_column(e.right)
    if isinstance(e, Or):
        return to_column(e.left) | to_column(e.right)
    if isinstance(e, Not):
        return ~to_column(e.inner)
    if e.op in ("true", "false"):
        return F.lit(e.op == "true")
    c, v = F.col(e.name), e.value
    if e.op in ("in", "not_in"):
        return c.isin(*v) if e.op == "in" else ~c.isin(*v)
    simple = {"is_null": c.isNull, "not_null": c.isNotNull, "is_nan": lambda: F.isnan(c), "not_nan": lambda: ~F.isnan(c)}
    if e.op in simple:
        return simple[e.op]()
    if e.op in ("starts_with", "not_starts_with"):
        return c.startswith(v) if e.op == "starts_with" else ~c.startswith(v)
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[e.op]


def may_match(e) -> Column:
    """Whether a file may hold a matching row, over a table of statistics.

    For a column x the table has x_lower, x_upper, x_nulls, x_nans and record_count;
    what is unknown is null, and keeps the file.
    """
    return F.coalesce(_may(pushed(e)), F.lit(True))


def _may(e) -> Column:
    if isinstance(e, And):
        return F.coalesce(_may(e.left), F.lit(True)) & F.coalesce(_may(e.right), F.lit(True))
    if isinstance(e, Or):
        return F.coalesce(_may(e.left), F.lit(True)) | F.coalesce(_may(e.right), F.lit(True))
    if e.op in ("true", "false"):
        return F.lit(e.op == "true")
    low, high, nulls, rows = F.col(f"{e.name}_lower"), F.col(f"{e.name}_upper"), F.col(f"{e.name}_nulls"), F.col("record_count")
    some = F.coalesce(nulls < rows, F.lit(True))  # not only nulls
    v = e.value
    if e.op == "is_null":
        return nulls > 0
    if e.op in ("not_null", "not_nan", "not_in", "!=", "not_starts_with"):
        if e.op == "!=":
            return some & ~((low == v) & (high == v))
        if e.op == "not_starts_with":
            return some & ~(low.startswith(v) & high.startswith(v))
        return some
    if e.op == "is_nan":
        return F.col(f"{e.name}_nans") > 0
    if e.op == "in":
        hit = F.lit(False)
        for x in v:
            hit = hit | ((low <= x) & (high >= x))
        return some & hit
    if e.op == "starts_with":
        return some & (F.substring(low, 1, len(v)) <= v) & (F.substring(high, 1, len(v)) >= v)
    return some & {"=": (low <= v) & (high >= v), "<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}[e.op]


def must_match(e) -> Column:
    """Whether every row of a file matches, so that no filter remains for it."""
    return F.coalesce(_must(pushed(e)), F.lit(False))


def _must(e) -> Column:
    if isinstance(e, And):
        return F.coalesce(_must(e.left), F.lit(False)) & F.coalesce(_must(e.right), F.lit(False))
    if isinstance(e, Or):
        return F.coalesce(_must(e.left), F.lit(False)) | F.coalesce(_must(e.right), F.lit(False))
    if e.op in ("true", "false"):
        return F.lit(e.op == "true")
    low, high, nulls, rows = F.col(f"{e.name}_lower"), F.col(f"{e.name}_upper"), F.col(f"{e.name}_nulls"), F.col("record_count")
    v = e.value
    if e.op == "is_null":
        return nulls == rows
    if e.op == "not_null":
        return nulls == 0
    if e.op in ("=", "in"):
        value = low == v if e.op == "=" else low.isin(*v)
        return (nulls == 0) & (low == high) & value
    if e.op in ("!=", "not_in"):
        out = nulls == 0
        for x in v if e.op == "not_in" else (v,):
            out = out & ((high < x) | (low > x))
        return out
    if e.op in ("<", "<=", ">", ">="):
        return (nulls == 0) & {"<": high < v, "<=": high <= v, ">": low > v, ">=": low >= v}[e.op]
    return F.lit(False)


def partition_filter(e, spec: dict[str, tuple[str, str]]):
    """A row predicate projected onto partition fields: it keeps each partition that may hold a match.

    ``spec`` gives for a partition field its source column and transform.  What a
    transform cannot decide becomes true.
    """
    return _project(pushed(e), spec)


def _project(e, spec):
    if isinstance(e, (And, Or)):
        return pushed(type(e)(_project(e.left, spec), _project(e.right, spec)))
    out = TRUE
    for part, (source, transform) in spec.items():
        if source != e.name:
            continue
        if e.op in ("is_null", "not_null") or transform == "identity":
            one = Leaf(e.op, part, e.value)
        elif transform.startswith("truncate[") and isinstance(e.value, (int, str)) and e.op in ("=", "<", "<=", ">", ">="):
            w = int(transform[9:-1])
            v = e.value[:w] if isinstance(e.value, str) else e.value - e.value % w
            one = Leaf({"<": "<=", ">": ">="}.get(e.op, e.op), part, v)
        elif transform.startswith("bucket[") and e.op == "=" and isinstance(e.value, (int, str)):
            import numpy as np

            from tidemill.functions.transforms import murmur3_bytes, murmur3_long

            h = murmur3_bytes(e.value.encode()) if isinstance(e.value, str) else int(murmur3_long(np.array([e.value]))[0])
            one = Leaf("=", part, (h & 0x7FFFFFFF) % int(transform[7:-1]))
        else:
            continue
        out = one if out == TRUE else And(out, one)
    return out
