import math

import pytest
from pyspark.sql import functions as F

from tidemill.functions.cel import CelError, Env, Typed, compile_expression

CASES = [
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("0x10", 16), ("5u + 3u", 8), ("2u - 3u", None), ("9223372036854775807 + 1", None),
    ("1 / 0", None), ("1.5 + 2.5", 4.0), ("1.0 / 0.0", math.inf), ("1 == 1u", True), ("1 == 1.0", True), ("'a' == 1", False), ("[1, 2] == [1, 2]", True),
    ("{'a': 1} == {'a': 1}", True), ("double('NaN') == double('NaN')", False), ("double('NaN') < 1.0", False), ("1 < 2u", True), ("'a' < 'b'", True),
    ("true || 1 / 0 == 1", True), ("1 / 0 == 1 || true", True), ("false && 1 / 0 == 1", False), ("true && 1 / 0 == 1", None), ("!false", True),
    ("true ? 1 : 2", 1), ("size('é!')", 2), ("size(b'é')", 2), ("'abc'.contains('b')", True), ("'abc'.startsWith('ab')", True), ("'abc'.endsWith('bc')", True),
    ("'abc'.matches('b.')", True), ("'a' + 'b'", "ab"), ("[1, 2, 3][1]", 2), ("[1][5]", None), ("{'a': 1}['b']", None), ("{'a': 1}.a", 1), ("2 in [1, 2]", True),
    ("'a' in {'a': 1}", True), ("has({'a': 1}.b)", False), ("[1, 2].all(x, x > 0)", True), ("[1, 2].exists(x, x > 1)", True), ("[1, 2, 3].exists_one(x, x > 2)", True),
    ("[1, 2].map(x, x * 2) == [2, 4]", True), ("[1, 2, 3].map(x, x > 1, x * 2) == [4, 6]", True), ("[1, 2, 3].filter(x, x % 2 == 1) == [1, 3]", True), ("{'k': 1}.all(k, k == 'k')", True),
    ("int('42')", 42), ("int('x')", None), ("int(3.9)", 3), ("int(-3.9)", -3), ("uint(3)", 3), ("uint(-1)", None), ("double(3)", 3.0), ("string(12)", "12"), ("bool('true')", True),
    ("type(1) == 'int'", True), ("timestamp('2024-02-03T04:05:06Z').getMonth()", 1), ("timestamp('2024-02-03T04:05:06Z').getDayOfWeek()", 6), ("timestamp('2024-02-03T04:05:06Z').getHours('+02:00')", 6),
    ("duration('1h30m').getMinutes()", 90), ("timestamp('2024-01-01T00:00:00Z') + duration('36h') == timestamp('2024-01-02T12:00:00Z')", True),
    ("r'\\n' == '\\\\n'", True), ("null == null", True), ("1 == 1 ? 'y' : 'n' // note", "y"), ("a + 1", 6), ("p.a", 9), ("[1, 2].exists(a, a == 2) && a == 5", True), ("twice(4)", 8),
]
ERRORS = [("1 +", "parse"), ("1 + 1u", "no_overload"), ("1 + 1.0", "no_overload"), ("zzz", "undeclared"), ("'a' < 1", "no_overload"), ("{'a': 1, 'a': 2}", "invalid"), ("9223372036854775808", "invalid"), ("{1.0: 1}", "invalid"), ("f(1)", "no_overload"), ("1 ? 2 : 3", "no_overload")]


def env():
    variables = {"a": Typed(F.lit(5).cast("bigint"), "int"), "q.p.a": Typed(F.lit(9).cast("bigint"), "int")}
    return Env(variables, {"twice": [lambda v: Typed(v.column * 2, "int") if v.type == "int" else None]}, "q")


def test_conformance(spark):
    row = spark.range(1).select(*(compile_expression(t, env()).column.alias(f"c{i}") for i, (t, _) in enumerate(CASES))).first()
    for i, (text, want) in enumerate(CASES):
        got = row[i]
        assert (got is None) == (want is None) and (want is None or float(got) == float(want) if isinstance(want, (int, float)) and not isinstance(want, bool) and want is not None else got == want), (text, got)


@pytest.mark.parametrize(("text", "kind"), ERRORS)
def test_errors(spark, text, kind):
    with pytest.raises(CelError) as e:
        compile_expression(text, env())
    assert e.value.kind == kind
