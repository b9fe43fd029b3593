"""Queries over the expression language, validation, predicates, transforms and semi-structured columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import cel, predicates, transforms, validation
from tidemill.functions.cel import Typed
from tidemill.functions.validation import Required, Rule
from tidemill.plans.registry import query, table


def evaluated(df, keys, **expressions):
    """Key columns and one column for each expression; errors are null."""
    variables = cel.columns_of(df)
    return df.select(*keys, *(cel.compile_expression(t, variables).column.alias(n) for n, t in expressions.items()))


@query("c1_literals", "SELECT event_id, 17 AS a, CAST(2.5 AS DOUBLE) AS b, 'x' AS c, true AS d FROM events")
def c1(s, d):
    out = evaluated(table(s, d, "events"), ["event_id"], a="0x11", b="2.5", c="'x'", d="true")
    return out.withColumn("a", F.col("a").cast("int"))


@query("c2_arithmetic", "SELECT event_id, event_id + 2 * user_id AS a, event_id // 7 AS b, event_id % 7 AS c, value * 2.0 - 1.0 AS d FROM events")
def c2(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="event_id + 2 * user_id", b="event_id / 7", c="event_id % 7", d="value * 2.0 - 1.0")


@query("c3_comparison", "SELECT event_id, value > 50 AS a, event_type < 'e' AS b, user_id >= 5.5 AS c FROM events")
def c3(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="value > 50.0", b="event_type < 'e'", c="user_id >= 5.5")


@query("c4_equality", "SELECT event_id, user_id = 5 AS a, false AS b, [user_id, 1] = [5, 1] AS c FROM events")
def c4(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="user_id == 5u", b="event_type == 1", c="[user_id, 1] == [5, 1]")


@query("c5_logic", "SELECT event_id, event_type = 'click' AND value > 50 AS a, CASE WHEN event_id % 3 = 0 THEN event_type = 'click' OR NULL ELSE event_type = 'click' OR 10 // (event_id % 3) > 5 END AS b FROM events")
def c5(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="event_type == 'click' && value > 50.0", b="event_type == 'click' || 10 / (event_id % 3) > 5")


@query("c6_ternary", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS a FROM events")
def c6(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="value > 50.0 ? 'high' : 'low'")


@query("c7_strings", "SELECT page_id, length(url) AS a, contains(url, 'page') AS b, starts_with(url, 'https') AS c, regexp_matches(url, '[0-9]+') AS d, url || '#' AS e FROM pages")
def c7(s, d):
    return evaluated(table(s, d, "pages"), ["page_id"], a="size(url)", b="url.contains('page')", c="url.startsWith('https')", d="url.matches('[0-9]+')", e="url + '#'")


@query("c8_lists", "SELECT vec_id, len(embedding) AS a, CAST(embedding[1] AS DOUBLE) AS b, label IN (1, 3) AS c FROM embeddings")
def c8(s, d):
    return evaluated(table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["vec_id"], a="size(embedding)", b="embedding[0]", c="label in [1, 3]")


@query("c9_macros", """SELECT vec_id, len([x for x in embedding if x > 0.3]) > 0 AS a, len([x for x in embedding if x > -1]) = len(embedding) AS b,
    CAST(len([x for x in embedding if x > 0]) AS BIGINT) AS c, len([x for x in embedding if x > 0.35]) = 1 AS d FROM embeddings""")
def c9(s, d):
    e = table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return evaluated(e, ["vec_id"], a="embedding.exists(x, x > 0.3)", b="embedding.all(x, x > -1.0)", c="size(embedding.filter(x, x > 0.0))", d="embedding.exists_one(x, x > 0.35)")


@query("c10_conversions", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS a, CAST(event_id AS VARCHAR) AS b, CAST(user_id AS DOUBLE) AS c FROM events")
def c10(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="int(value)", b="string(event_id)", c="double(user_id)")


@query("c11_date_time", """SELECT event_id, year(ts) AS a, month(ts) - 1 AS b, day(ts) AS c, dayofweek(ts) AS d, dayofyear(ts) - 1 AS e, hour(ts + INTERVAL 2 HOUR) AS f, minute(ts) AS g FROM events""")
def c11(s, d):
    return evaluated(table(s, d, "events"), ["event_id"], a="ts.getFullYear()", b="ts.getMonth()", c="ts.getDate()", d="ts.getDayOfWeek()", e="ts.getDayOfYear()", f="ts.getHours('+02:00')", g="ts.getMinutes()")


@query("c12_name_resolution", "SELECT event_id, value + 1 AS a FROM events")
def c12(s, d):
    e = table(s, d, "events")
    env = cel.Env({"shop.order.value": Typed(F.col("value"), "double"), "value": Typed(F.lit(0.0), "double")}, {}, "shop.order")
    return e.select("event_id", cel.compile_expression("value + 1.0", env).column.alias("a"))


@query("c13_compiled_filter", "SELECT event_id FROM events WHERE value > 20 AND event_type IN ('click', 'view')")
def c13(s, d):
    e = table(s, d, "events")
    return e.filter(cel.compile_expression("value > 20.0 && event_type in ['click', 'view']", cel.columns_of(e)).column).select("event_id")


@query("u5_extension_function", "SELECT event_id, value * value AS a FROM events")
def u5(s, d):
    e = table(s, d, "events")
    square = [lambda v: Typed(v.column * v.column, "double") if v.type == "double" else None]
    return e.select("event_id", cel.compile_expression("square(value)", cel.Env(cel.columns_of(e), {"square": square})).column.alias("a"))


RULES = [
    Rule("balance", "c_acctbal", "c_acctbal >= 0.0", "negative balance"),
    Rule("segment", "c_mktsegment", "c_mktsegment in ['BUILDING', 'MACHINERY'] ? '' : 'segment ' + c_mktsegment"),
    Rule("late", "c_custkey", "10 / (c_custkey % 4) > 0", "failed"),
    Required("c_name"),
]


@query("v1_violations", """SELECT c_custkey, 'c_acctbal' AS path, 'balance' AS rule, 'negative balance' AS message FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT c_custkey, 'c_mktsegment', 'segment', 'segment ' || c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT c_custkey, 'c_custkey', 'late', 'failed' FROM customer WHERE c_custkey % 4 = 0""")
def v1(s, d):
    return validation.report(table(s, d, "customer"), ["c_custkey"], RULES)


@query("v2_required_ignore_empty", "SELECT event_id, 'value' AS path, 'range' AS rule, 'too high' AS message FROM events WHERE value > 90")
def v2(s, d):
    return validation.report(table(s, d, "events"), ["event_id"], [Required("event_type"), Rule("range", "value", "value <= 90.0", "too high", ignore_empty=True)])


@query("v3_formats", r"SELECT page_id, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=]|%[0-9A-Fa-f][0-9A-Fa-f])*') AS is_uri, false AS is_email, false AS is_ip FROM pages")
def v3(s, d):
    p = table(s, d, "pages")
    env = cel.Env(cel.columns_of(p), dict(validation.FORMATS))
    return p.select("page_id", *(cel.compile_expression(t, env).column.alias(n) for n, t in (("is_uri", "url.isUri()"), ("is_email", "url.isEmail()"), ("is_ip", "url.isIp(4)"))))


@query("v4_time_rules", "SELECT event_id, 'ts' AS path, 'past' AS rule, 'in the future' AS message FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def v4(s, d):
    return validation.report(table(s, d, "events"), ["event_id"], [Rule("past", "ts", "ts <= now", "in the future")], F.expr("TIMESTAMP '2024-01-15 00:00:00'"))


P = predicates


@query("p17_predicate", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') AND o_totalprice >= 1000) OR NOT (o_orderkey < 900) OR o_orderpriority IS NULL")
def p17(s, d):
    e = P.Or(P.And(P.Leaf("in", "o_orderstatus", ("F", "P")), P.Leaf(">=", "o_totalprice", 1000.0)), P.Or(P.Not(P.Leaf("<", "o_orderkey", 900)), P.Leaf("is_null", "o_orderpriority")))
    return table(s, d, "orders").filter(P.to_column(e)).select("o_orderkey")


@query("p18_predicate_extended", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00') AND c_mktsegment NOT IN ('BUILDING') AND NOT isnan(c_acctbal)")
def p18(s, d):
    e = P.And(P.Leaf("starts_with", "c_name", "Customer#00"), P.And(P.Leaf("not_in", "c_mktsegment", ("BUILDING",)), P.Leaf("not_nan", "c_acctbal")))
    return table(s, d, "customer").filter(P.to_column(e)).select("c_custkey")


@query("t1_identity_void", "SELECT l_orderkey, CAST(NULL AS VARCHAR) AS void FROM lineitem")
def t1(s, d):
    return table(s, d, "lineitem").select(transforms.apply("identity", F.col("l_orderkey")).alias("l_orderkey"), transforms.apply("void", F.col("l_orderkey")).cast("string").alias("void"))


@query("t2_bucket")
def t2(s, d):
    return table(s, d, "orders").select("o_orderkey", transforms.bucket(F.col("o_orderkey"), 16).alias("bucket"), transforms.bucket(F.col("o_orderstatus"), 8, "string").alias("status_bucket"))


@query("t3_truncate", "SELECT o_orderkey, o_orderkey - (o_orderkey % 10) AS decade, left(o_orderpriority, 3) AS prefix FROM orders")
def t3(s, d):
    return table(s, d, "orders").select("o_orderkey", transforms.truncate(F.col("o_orderkey"), 10).alias("decade"), transforms.truncate(F.col("o_orderpriority"), 3, "string").alias("prefix"))


@query("t4_date_parts", """SELECT l_orderkey, l_linenumber, year(l_shipdate) - 1970 AS y, (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS m, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d,
    CAST(floor(epoch_us(l_shipdate) / 3600000000) AS BIGINT) AS h FROM lineitem""")
def t4(s, d):
    c = F.col("l_shipdate")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", transforms.year(c).alias("y"), transforms.month(c).alias("m"), transforms.day(c).cast("long").alias("d"), transforms.hour(c).cast("long").alias("h"))


@query("l18_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def l18(s, d):
    return table(s, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("s17_ndjson_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def s17(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"}).alias("p")).select("event_id", "p.k")


@query("k10_encode_json_csv", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS js, c_custkey || ',' || c_mktsegment AS csv FROM customer""")
def k10(s, d):
    row = F.struct("c_custkey", "c_mktsegment")
    return table(s, d, "customer").select("c_custkey", F.to_json(row).alias("js"), F.to_csv(row).alias("csv"))


@query("x1_xpath", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 2 AS children FROM customer")
def x1(s, d):
    xml = F.to_xml(F.struct("c_name", "c_mktsegment"), {"rowTag": "customer"})
    c = table(s, d, "customer").select("c_custkey", xml.alias("xml"))
    return c.select("c_custkey", F.xpath_string("xml", F.lit("/customer/c_name")).alias("name"), F.xpath_string("xml", F.lit("//c_mktsegment")).alias("segment"), F.xpath_int("xml", F.lit("count(/customer/*)")).alias("children"))


@query("x3_normalize_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")
def x3(s, d):
    return table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
