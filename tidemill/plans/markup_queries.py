"""Queries over ``pages.html``; no SQL can parse it, tests hold literal vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import markup
from tidemill.plans.registry import query, table


@query("h1_text_content")
def h1(s, d):
    return table(s, d, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


@query("h2_query_selector")
def h2(s, d):
    p = table(s, d, "pages").select("page_id", F.explode(markup.query_selector_all(F.col("html"), "p, h1, a[href]")).alias("n"))
    return p.select("page_id", "n.tag", "n.text")


@query("h3_attributes")
def h3(s, d):
    p = table(s, d, "pages").select("page_id", F.explode(markup.query_selector_all(F.col("html"), "a[href]")).alias("n"))
    return p.select("page_id", F.col("n.attrs")["href"].alias("href"))


@query("h4_rewrite")
def h4(s, d):
    return table(s, d, "pages").select("page_id", markup.rewrite_html(F.col("html"), "script, style", "remove").alias("html"))


@query("x2_xml_axes", "SELECT c_custkey, c_mktsegment AS next FROM customer")
def x2(s, d):
    xml = F.to_xml(F.struct("c_name", "c_mktsegment"), {"rowTag": "customer"})
    return table(s, d, "customer").select("c_custkey", F.element_at(markup.xpath_all(xml, "/customer/c_name/following-sibling::*"), 1).alias("next"))
