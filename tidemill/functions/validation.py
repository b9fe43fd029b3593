"""Row validation by rules in the expression language, and format checks."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import cel
from tidemill.functions.cel import Env, Typed


@dataclass(frozen=True)
class Rule:
    """``expression`` gives true or "" where the row is right; anything else, or an error, is a violation."""

    id: str
    path: str
    expression: str
    message: str = ""
    ignore_empty: bool = False


@dataclass(frozen=True)
class Required:
    path: str
    id: str = "required"


# Formats as their public standards give them, within one line each.
HOSTNAME = r"^(?=.{1,253}\.?$)(?!.*\.\d+\.?$)(?!\d+$)([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.?$"
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
URI_CHARS = r"([A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:" + URI_CHARS + "*$"
URI_REF = "^" + URI_CHARS + "*$"


@F.pandas_udf(T.BooleanType())
def _is_ip6(s: pd.Series) -> pd.Series:
    def ok(x) -> bool:
        try:
            return x is not None and isinstance(ipaddress.ip_address(x), ipaddress.IPv6Address)
        except ValueError:
            return False

    return s.map(ok)


@F.pandas_udf(T.BooleanType())
def _is_prefix(s: pd.Series) -> pd.Series:
    def ok(x) -> bool:
        try:
            return x is not None and "/" in x and bool(ipaddress.ip_network(x, strict=False))
        except ValueError:
            return False

    return s.map(ok)


def is_ip(c: Column, version: int | None = None) -> Column:
    four = c.rlike(IPV4)
    return four if version == 4 else _is_ip6(c) if version == 6 else four | _is_ip6(c)


def is_host_and_port(c: Column) -> Column:
    host, port = F.regexp_extract(c, r"^(.*):(\d+)$", 1), F.regexp_extract(c, r"^(.*):(\d+)$", 2)
    return (host.rlike(HOSTNAME) | host.rlike(IPV4)) & (port.try_cast("int") <= 65535)


def _one(kind: str, f):
    return [lambda *v: Typed(f(*(x.column for x in v)), "bool") if v and v[0].type == kind else None]


FORMATS = {
    "isHostname": _one("string", lambda c: c.rlike(HOSTNAME)),
    "isEmail": _one("string", lambda c: c.rlike(EMAIL)),
    "isUri": _one("string", lambda c: c.rlike(URI)),
    "isUriRef": _one("string", lambda c: c.rlike(URI_REF)),
    "isIp": _one("string", lambda c, *v: is_ip(c)),
    "isIpPrefix": _one("string", lambda c: _is_prefix(c)),
    "isHostAndPort": _one("string", lambda c, *v: is_host_and_port(c)),
    "isNan": _one("double", F.isnan),
    "isInf": _one("double", lambda c: F.abs(c) == float("inf")),
    "unique": [lambda v: Typed(F.size(F.array_distinct(v.column)) == F.size(v.column), "bool") if v.type.startswith("list") else None],
}


def violations(df: DataFrame, rules: list[Rule | Required], now: Column | None = None) -> DataFrame:
    """The rows with ``violations``: an array of (path, rule, message)."""
    variables = cel.columns_of(df)
    if now is not None:
        variables["now"] = Typed(now, "timestamp")
    env = Env(variables, dict(FORMATS))
    found = []
    for r in rules:
        if isinstance(r, Required):
            c = F.col(r.path)
            kind = df.schema[r.path].dataType.simpleString()
            wrong, message = c.isNull() | ((c == "") if kind == "string" else F.lit(False)), F.lit("value is required")
        else:
            t = cel.compile_expression(r.expression, env)
            right = t.column == "" if t.type == "string" else t.column
            wrong = ~F.coalesce(right, F.lit(False))
            message = F.coalesce(t.column, F.lit("evaluation failed")) if t.type == "string" else F.lit(r.message)
            if r.ignore_empty:
                wrong = wrong & F.col(r.path).isNotNull() & (F.col(r.path).cast("string") != "")
        found.append(F.when(wrong, F.struct(F.lit(r.path).alias("path"), F.lit(r.id).alias("rule"), message.alias("message"))))
    return df.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))


def report(df: DataFrame, keys: list[str], rules: list[Rule | Required], now: Column | None = None) -> DataFrame:
    """A row for each violation."""
    return violations(df, rules, now).select(*keys, F.explode("violations").alias("v")).select(*keys, "v.path", "v.rule", "v.message")
