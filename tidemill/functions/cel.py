"""A typed expression language (CEL) compiled to columns, so that Catalyst generates the code.

``compile_expression(text, env)`` gives a ``Typed`` column.  An error at run time
(overflow, division by zero, a missing key, a failed conversion) is a NULL; the
engine's three-valued logic then absorbs errors in ``&&`` and ``||`` as the language
asks.  Mixed-type arithmetic and unknown names are errors at compile time, with the
language's error kinds.  A nullable input column is read as an error where it is null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class CelError(ValueError):
    """kind: parse, undeclared, no_overload, no_such_field, unsupported, invalid."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Typed:
    """A column and its type: int, uint, double, string, bytes, bool, null, timestamp, duration, list(T), map(K,V)."""

    column: Column
    type: str
    items: tuple[Typed, ...] | None = None


@dataclass
class Env:
    variables: dict[str, Typed] = field(default_factory=dict)
    functions: dict[str, list[Callable[..., Typed | None]]] = field(default_factory=dict)
    container: str = ""

    def find(self, name: str) -> Typed | None:
        """By the innermost package first, then outwards."""
        package = self.container
        while True:
            full = f"{package}.{name}" if package else name
            if full in self.variables:
                return self.variables[full]
            if not package:
                return None
            package = package.rpartition(".")[0]


_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>//[^\n]*)|(?P<number>0[xX][0-9a-fA-F]+[uU]?|\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+[uU]?)
    |(?P<string>(?:[rR][bB]?|[bB][rR]?)?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))
    |(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}]))""",
    re.X | re.S,
)
_LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">=", "in"], ["+", "-"], ["*", "/", "%"]]


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise CelError("parse", f"unexpected {text[at : at + 10]!r}")
        if m.lastgroup != "comment":
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] != "string" else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.at]
        if wanted is not None and (t[1] != wanted or t[0] == "string"):
            raise CelError("parse", f"expected {wanted!r}, found {t[1]!r}")
        self.at += 1
        return t

    def expression(self):
        c = self.binary(0)
        if self.peek() == "?":
            self.take()
            a = self.expression()
            self.take(":")
            return ("if", c, a, self.expression())
        return c

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.take()[1]
            left = ("op", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.peek() in ("!", "-"):
            op = self.take()[1]
            if op == "-" and self.tokens[self.at][0] == "number":
                return self.postfix(("number", "-" + self.take()[1]))
            return ("unary", op, self.unary())
        return self.postfix(self.primary())

    def arguments(self, end: str) -> list:
        out = []
        while self.peek() != end:
            out.append(self.expression())
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return out

    def postfix(self, e):
        while True:
            if self.peek() == ".":
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise CelError("parse", f"a name expected, found {name!r}")
                if self.peek() == "(":
                    self.take()
                    e = ("call", name, e, self.arguments(")"))
                else:
                    e = ("select", e, name)
            elif self.peek() == "[":
                self.take()
                e = ("index", e, self.expression())
                self.take("]")
            else:
                return e

    def primary(self):
        kind, t = self.take()
        if kind in ("number", "string"):
            return (kind, t)
        if kind == "name":
            if t in ("true", "false", "null"):
                return ("constant", t)
            if self.peek() == "(":
                self.take()
                return ("call", t, None, self.arguments(")"))
            return ("name", t)
        if t == "(":
            e = self.expression()
            self.take(")")
            return e
        if t == "[":
            return ("list", self.arguments("]"))
        if t == "{":
            pairs = []
            while self.peek() != "}":
                k = self.expression()
                self.take(":")
                pairs.append((k, self.expression()))
                if self.peek() != "}":
                    self.take(",")
            self.take("}")
            return ("map", pairs)
        raise CelError("parse", f"unexpected {t!r}")


def parse(text: str):
    p = _Parser(text)
    e = p.expression()
    if p.tokens[p.at][0] != "end":
        raise CelError("parse", f"unexpected {p.peek()!r}")
    return e


NUMBERS = ("int", "uint", "double")
_SPARK = {"int": "bigint", "uint": "decimal(20,0)", "double": "double", "string": "string", "bytes": "binary", "bool": "boolean", "timestamp": "timestamp", "duration": "interval day to second"}
_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}


def duration_us(text: str) -> int:
    if not re.fullmatch(r"-?(\d+(\.\d*)?(h|ms|us|ns|m|s))+", text):
        raise CelError("invalid", f"duration {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(h|ms|us|ns|m|s)", text))
    return int(-total if text[0] == "-" else total)


def _interval(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000)).cast("decimal(18,6)"))


def _item(t: str) -> str:
    return t[5:-1]


def _key_value(t: str) -> tuple[str, str]:
    k, v = t[4:-1].split(",", 1)
    return k, v


def _checked(c: Column, t: str) -> Column:
    """NULL (an error) where an unsigned result leaves its range."""
    return F.when((c >= 0) & (c <= F.lit("18446744073709551615").cast("decimal(20,0)")), c.cast("decimal(20,0)")) if t == "uint" else c


def _equal(a: Typed, b: Typed) -> Column:
    if a.type in NUMBERS and b.type in NUMBERS:
        if a.type != b.type and "double" not in (a.type, b.type):
            return a.column.cast("decimal(20,0)") == b.column.cast("decimal(20,0)")
        x, y = a.column.cast("double") if a.type != b.type else a.column, b.column.cast("double") if a.type != b.type else b.column
        return (x == y) & ~F.isnan(x) & ~F.isnan(y) if "double" in (a.type, b.type) else x == y
    if a.type != b.type:
        if a.type.startswith("list") and b.type.startswith("list") and "list(dyn)" in (a.type, b.type):
            return F.size(a.column) == F.size(b.column)
        return F.lit(False)
    if a.type == "null":
        return F.lit(True)
    if a.type.startswith("map"):
        entries = [F.array_sort(F.map_entries(x.column)) for x in (a, b)]
        return entries[0] == entries[1]
    return a.column == b.column


def _compare(op: str, a: Typed, b: Typed) -> Column:
    if a.type in NUMBERS and b.type in NUMBERS:
        x, y = (v.column if a.type == b.type else v.column.cast("double" if "double" in (a.type, b.type) else "decimal(20,0)") for v in (a, b))
        guard = ~F.isnan(x) & ~F.isnan(y) if "double" in (a.type, b.type) else F.lit(True)
    elif a.type == b.type and a.type in ("string", "bytes", "bool", "timestamp", "duration"):
        x, y, guard = a.column, b.column, F.lit(True)
    else:
        raise CelError("no_overload", f"{a.type} {op} {b.type}")
    return guard & {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    x, y, t = a.column, b.column, a.type
    if a.type == b.type and t in NUMBERS:
        if t == "double":
            if op == "%":
                raise CelError("no_overload", "double % double")
            divided = F.when(y != 0, x / F.when(y != 0, y)).otherwise(F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))))
            return Typed({"+": x + y, "-": x - y, "*": x * y, "/": divided}[op], t)
        if op in "/%":
            other = F.when(y != 0, y)
            if op == "/":
                whole = F.call_function("div", x, other) if t == "int" else F.floor(x / other)
                least = F.lit(-(1 << 63))
                return Typed(F.when(~((x == least) & (y == -1)), whole) if t == "int" else _checked(whole, t), t)
            return Typed(_checked(F.try_mod(x, other), t), t)
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        return Typed(_checked(f(x, y), t), t)
    if op == "+" and a.type == b.type and (t in ("string", "bytes") or t.startswith("list")):
        return Typed(F.concat(x, y), t)
    if op in "+-" and b.type == "duration" and t in ("timestamp", "duration"):
        return Typed(x + y if op == "+" else x - y, t)
    if op == "+" and t == "duration" and b.type == "timestamp":
        return Typed(y + x, "timestamp")
    if op == "-" and t == b.type == "timestamp":
        return Typed(x - y, "duration")
    raise CelError("no_overload", f"{a.type} {op} {b.type}")


_FIELDS: dict[str, Callable[[Column], Column]] = {
    "getFullYear": F.year,
    "getMonth": lambda c: F.month(c) - 1,
    "getDate": F.day,
    "getDayOfMonth": lambda c: F.day(c) - 1,
    "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1,
    "getHours": F.hour,
    "getMinutes": F.minute,
    "getSeconds": F.second,
    "getMilliseconds": lambda c: F.floor(F.unix_micros(c) / 1000) % 1000,
}
_TOTALS = {"getHours": 3600, "getMinutes": 60, "getSeconds": 1}


def _convert(name: str, a: Typed) -> Typed:
    x, t = a.column, a.type
    if name == "dyn" or name == t:
        return a
    if name == "type":
        return Typed(F.lit(t.split("(")[0]), "string")
    if name in ("int", "uint") and t in (*NUMBERS, "string") or name == "double" and t in (*NUMBERS, "string"):
        if t == "double" and name != "double":
            low, high = (-(2.0**63), 2.0**63) if name == "int" else (-1.0, 2.0**64)
            x = F.when((x > low) & (x < high) & ~F.isnan(x), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
            return Typed(_checked(x.cast(_SPARK[name]), name), name)
        return Typed(_checked(x.try_cast(_SPARK[name]), name), name)
    if name == "int" and t == "timestamp":
        return Typed(F.unix_seconds(x), "int")
    if name == "string" and t in (*NUMBERS, "bool"):
        return Typed(x.cast("string"), "string")
    if name == "string" and t == "bytes":
        return Typed(F.try_validate_utf8(x.cast("string")), "string")
    if name == "string" and t == "timestamp":
        return Typed(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "string")
    if name == "bytes" and t == "string":
        return Typed(F.encode(x, "UTF-8"), "bytes")
    if name == "bool" and t == "string":
        return Typed(F.when(x.isin("true", "True", "TRUE", "t", "1"), True).when(x.isin("false", "False", "FALSE", "f", "0"), False), "bool")
    if name == "timestamp" and t == "string":
        return Typed(x.try_cast("timestamp"), "timestamp")
    if name == "timestamp" and t == "int":
        return Typed(F.timestamp_seconds(x), "timestamp")
    raise CelError("no_overload", f"{name}({t})")


class _Compiler:
    def __init__(self, env: Env):
        self.env = env

    def of(self, e, local: dict[str, Typed]) -> Typed:
        return getattr(self, "_" + e[0])(e, local)

    def _number(self, e, local):
        t = e[1]
        if t[-1] in "uU" and not t.lower().startswith("-"):
            return Typed(F.lit(str(int(t[:-1], 0))).cast("decimal(20,0)"), "uint")
        if re.fullmatch(r"-?(0[xX][0-9a-fA-F]+|\d+)", t):
            n = int(t, 16 if "x" in t.lower() else 10)
            if not -(1 << 63) <= n < 1 << 63:
                raise CelError("invalid", f"integer {t}")
            return Typed(F.lit(n).cast("bigint"), "int")
        return Typed(F.lit(float(t)), "double")

    def _string(self, e, local):
        prefix = re.match(r"[rRbB]*", e[1])[0].lower()
        try:
            value = ast.literal_eval(("r" if "r" in prefix else "") + e[1][len(prefix) :])
        except (SyntaxError, ValueError) as x:
            raise CelError("parse", str(x)) from x
        if "b" in prefix:
            return Typed(F.lit(bytearray(value.encode())), "bytes")
        return Typed(F.lit(value), "string")

    def _constant(self, e, local):
        return Typed(F.lit(None), "null") if e[1] == "null" else Typed(F.lit(e[1] == "true"), "bool")

    def _name(self, e, local):
        found = local.get(e[1]) or self.env.find(e[1])
        if found is None:
            raise CelError("undeclared", e[1])
        return found

    def _list(self, e, local):
        items = tuple(self.of(x, local) for x in e[1])
        if not items:
            return Typed(F.array(), "list(dyn)", ())
        kinds = {i.type for i in items}
        if len(kinds) > 1:
            raise CelError("unsupported", "a list of several types")
        column = F.array(*(i.column for i in items))
        failed = F.lit(False)
        for i in items:
            failed = failed | i.column.isNull()
        return Typed(F.when(~failed, column), f"list({items[0].type})", items)

    def _map(self, e, local):
        pairs = [(self.of(k, local), self.of(v, local)) for k, v in e[1]]
        if not pairs:
            return Typed(F.create_map(), "map(dyn,dyn)")
        if len({k.type for k, _ in pairs}) > 1 or len({v.type for _, v in pairs}) > 1:
            raise CelError("unsupported", "a map of several types")
        if pairs[0][0].type not in ("int", "uint", "bool", "string"):
            raise CelError("invalid", f"a key of type {pairs[0][0].type}")
        keys = [str(k) for k, _ in e[1]]
        if len(set(keys)) < len(keys):
            raise CelError("invalid", "a key occurs twice")
        return Typed(F.create_map(*(c.column for p in pairs for c in p)), f"map({pairs[0][0].type},{pairs[0][1].type})")

    def _unary(self, e, local):
        a = self.of(e[2], local)
        if e[1] == "!" and a.type == "bool":
            return Typed(~a.column, "bool")
        if e[1] == "-" and a.type == "int":
            return Typed(F.try_subtract(F.lit(0).cast("bigint"), a.column), "int")
        if e[1] == "-" and a.type == "double":
            return Typed(-a.column, "double")
        if e[1] == "-" and a.type == "duration":
            return Typed(-a.column, "duration")
        raise CelError("no_overload", f"{e[1]}{a.type}")

    def _op(self, e, local):
        op, a, b = e[1], self.of(e[2], local), self.of(e[3], local)
        if op in ("&&", "||"):
            if a.type != "bool" or b.type != "bool":
                raise CelError("no_overload", f"{a.type} {op} {b.type}")
            return Typed(a.column & b.column if op == "&&" else a.column | b.column, "bool")
        if op == "==":
            return Typed(_equal(a, b), "bool")
        if op == "!=":
            return Typed(~_equal(a, b), "bool")
        if op == "in":
            if b.type == "list(dyn)" or b.type == "map(dyn,dyn)":
                return Typed(F.lit(False), "bool")
            if b.type.startswith("list"):
                return Typed(F.exists(b.column, lambda x: _equal(a, Typed(x, _item(b.type)))), "bool")
            if b.type.startswith("map"):
                return Typed(F.exists(F.map_keys(b.column), lambda x: _equal(a, Typed(x, _key_value(b.type)[0]))), "bool")
            raise CelError("no_overload", f"{a.type} in {b.type}")
        if op in ("<", "<=", ">", ">="):
            return Typed(_compare(op, a, b), "bool")
        return _arithmetic(op, a, b)

    def _if(self, e, local):
        c, a, b = (self.of(x, local) for x in e[1:])
        if c.type != "bool" or a.type != b.type:
            raise CelError("no_overload", f"{c.type} ? {a.type} : {b.type}")
        return Typed(F.when(c.column.isNull(), F.lit(None)).when(c.column, a.column).otherwise(b.column), a.type)

    def _select(self, e, local):
        names, at = [e[2]], e[1]
        while at[0] == "select":
            names.insert(0, at[2])
            at = at[1]
        if at[0] == "name" and at[1] not in local:  # the longest qualified name that is declared
            whole = self.env.find(".".join([at[1], *names]))
            if whole is not None:
                return whole
        a = self.of(e[1], local)
        if a.type.startswith("map"):
            return Typed(F.try_element_at(a.column, F.lit(e[2])), _key_value(a.type)[1])
        raise CelError("no_such_field", e[2])

    def _index(self, e, local):
        a, i = self.of(e[1], local), self.of(e[2], local)
        if a.type.startswith("list") and i.type == "int":
            return Typed(F.when(i.column >= 0, F.try_element_at(a.column, (i.column + 1).cast("int"))), _item(a.type))
        if a.type.startswith("map"):
            return Typed(F.try_element_at(a.column, i.column), _key_value(a.type)[1])
        raise CelError("no_overload", f"{a.type}[{i.type}]")

    def _call(self, e, local):
        _, name, target, args = e
        if name == "has" and target is None and len(args) == 1 and args[0][0] == "select":
            a = self.of(args[0][1], local)
            if not a.type.startswith("map"):
                raise CelError("no_such_field", args[0][2])
            return Typed(F.map_contains_key(a.column, F.lit(args[0][2])), "bool")
        if target is not None and name in ("all", "exists", "exists_one", "map", "filter") and args and args[0][0] == "name":
            return self.macro(name, self.of(target, local), args, local)
        if target is not None and target[0] == "name" and target[1] not in local and f"{target[1]}.{name}" in self.env.functions:
            name, target = f"{target[1]}.{name}", None
        values = [self.of(x, local) for x in ([target] if target is not None else []) + args]
        for f in self.env.functions.get(name, ()):  # an extension comes first; it declines with None
            out = f(*values)
            if out is not None:
                return out
        if name == "size" and len(values) == 1:
            a = values[0]
            size = F.char_length if a.type == "string" else F.octet_length if a.type == "bytes" else F.size
            if a.type not in ("string", "bytes") and not a.type.startswith(("list", "map")):
                raise CelError("no_overload", f"size({a.type})")
            return Typed(F.when(a.column.isNotNull(), size(a.column)).cast("bigint"), "int")
        if name in ("contains", "startsWith", "endsWith", "matches") and [v.type for v in values] == ["string", "string"]:
            f = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[name]
            return Typed(f(values[0].column, values[1].column), "bool")
        if name == "duration" and args and args[0][0] == "string":
            return Typed(_interval(F.lit(duration_us(ast.literal_eval(args[0][1])))), "duration")
        if name in _FIELDS and values:
            return self.date_part(name, values, args)
        if name in ("int", "uint", "double", "string", "bool", "bytes", "timestamp", "type", "dyn", "duration") and len(values) == 1 and target is None:
            return _convert(name, values[0])
        raise CelError("no_overload", f"{name}({', '.join(v.type for v in values)})")

    def date_part(self, name, values, args):
        a = values[0]
        if a.type == "duration" and name in (*_TOTALS, "getMilliseconds"):
            seconds = F.extract(F.lit("SECOND"), a.column) + 60 * F.extract(F.lit("MINUTE"), a.column) + 3600 * F.extract(F.lit("HOUR"), a.column) + 86400 * F.extract(F.lit("DAY"), a.column)
            total = seconds * 1000 % 1000 if name == "getMilliseconds" else seconds / _TOTALS[name]
            return Typed(F.when(total < 0, F.ceil(total)).otherwise(F.floor(total)).cast("bigint"), "int")
        if a.type != "timestamp":
            raise CelError("no_overload", f"{name}({a.type})")
        at = F.from_utc_timestamp(a.column, values[1].column) if len(values) > 1 else a.column
        return Typed(_FIELDS[name](at).cast("bigint"), "int")

    def macro(self, name, over, args, local):
        if over.type.startswith("map"):
            items, kind = F.map_keys(over.column), _key_value(over.type)[0]
        elif over.type.startswith("list"):
            items, kind = over.column, _item(over.type)
        else:
            raise CelError("no_overload", f"{over.type}.{name}")
        if kind == "dyn":
            return Typed(over.column, "list(dyn)") if name in ("map", "filter") else Typed(F.lit(name == "all"), "bool")
        seen: list[Typed] = []

        def body(k: int):
            def at(x: Column) -> Column:
                out = self.of(args[k], {**local, args[0][1]: Typed(x, kind)})
                seen.append(out)
                return out.column

            return at

        if name == "all":
            return Typed(F.forall(items, body(1)), "bool")
        if name == "exists":
            return Typed(F.exists(items, body(1)), "bool")
        if name == "exists_one":
            return Typed(F.when(~F.exists(items, lambda x: body(1)(x).isNull()), F.size(F.filter(items, body(1))) == 1), "bool")
        if name == "filter":
            return Typed(F.filter(items, body(1)), f"list({kind})")
        if len(args) == 3:
            items = F.filter(items, body(1))
        out = F.transform(items, body(len(args) - 1))
        return Typed(out, f"list({seen[-1].type})")


def compile_expression(text: str, env: Env | dict[str, Typed] | None = None) -> Typed:
    env = env if isinstance(env, Env) else Env(dict(env or {}))
    return _Compiler(env).of(parse(text), {})


def columns_of(df) -> dict[str, Typed]:
    """A DataFrame's columns as variables of the types they have."""

    def kind(t: str) -> str | None:
        if t in ("tinyint", "smallint", "int", "bigint"):
            return "int"
        if t in ("float", "double"):
            return "double"
        if t in ("string", "boolean", "binary"):
            return {"string": "string", "boolean": "bool", "binary": "bytes"}[t]
        if t.startswith("timestamp"):
            return "timestamp"
        if t.startswith("array<"):
            inner = kind(t[6:-1])
            return inner and f"list({inner})"
        if t.startswith("map<"):
            k, v = t[4:-1].split(",", 1)
            return f"map({kind(k)},{kind(v)})"
        return None

    out = {}
    for name, t in df.dtypes:
        k = kind(t)
        if k:
            c = F.col(name).cast("bigint") if k == "int" else F.col(name).cast("double") if k == "double" else F.col(name).cast("timestamp") if k == "timestamp" else F.col(name)
            out[name] = Typed(c, k)
    return out
