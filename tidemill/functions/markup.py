"""HTML trees with CSS selectors, and path queries over XML, as Arrow-batched functions.

HTML is parsed by the standard library's tolerant tokenizer; a tree is built with the
rules for void and raw-text elements and for end tags that may be left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element classes of the public HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "pre", "form", "blockquote"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements()[::-1]

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += c.children[::-1]
        return "".join(out)

    def siblings(self) -> list[Node]:
        return self.parent.elements() if self.parent else [self]

    def html(self) -> str:
        inner = "".join(c if isinstance(c, str) and self.tag in RAW else escape(c, False) if isinstance(c, str) else c.html() for c in self.children)
        if self.tag == "#document":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        if self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(text: str | None) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"""\*|(?P<tag>[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|:(?P<pseudo>[a-z-]+)(?P<paren>\()?""")


class Selector:
    """A selector list: types, ids, classes, attributes, combinators, :not :is :where :nth-* :first/last/only-child :empty."""

    def __init__(self, text: str):
        self.options = [self._complex(p.strip()) for p in _split(text, ",")]

    def _complex(self, text: str) -> list[tuple[str, list[Callable[[Node], bool]]]]:
        parts, at, combinator = [], 0, " "
        while at < len(text):
            m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if m and parts:
                combinator, at = m[1] or " ", m.end()
            tests, at = self._compound(text, at)
            parts.append((combinator, tests))
            combinator = " "
        return parts

    def _compound(self, text: str, at: int):
        tests: list[Callable[[Node], bool]] = []
        while m := _SIMPLE.match(text, at):
            at = m.end()
            if m["tag"]:
                tests.append(lambda n, t=m["tag"].lower(): n.tag == t)
            elif m["id"]:
                tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
            elif m["cls"]:
                tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
            elif m["attr"]:
                value = next((m[k] for k in ("q", "s", "bare") if m[k] is not None), None)
                tests.append(_attribute(m["attr"].lower(), m["op"], value))
            elif m["pseudo"]:
                argument = None
                if m["paren"]:
                    depth, start = 1, at
                    while depth:
                        if at >= len(text):
                            raise ValueError(f"selector: {text!r}")
                        depth += {"(": 1, ")": -1}.get(text[at], 0)
                        at += 1
                    argument = text[start : at - 1]
                tests.append(_pseudo(m["pseudo"], argument))
            else:
                tests.append(lambda n: True)
        if not tests:
            raise ValueError(f"selector: {text!r} at {at}")
        return tests, at

    def matches(self, n: Node) -> bool:
        return any(self._match(n, o, len(o) - 1) for o in self.options)

    def _match(self, n: Node, parts, k: int) -> bool:
        combinator, tests = parts[k]
        if not all(t(n) for t in tests):
            return False
        if k == 0:
            return True
        if combinator in ">+":
            other = n.parent if combinator == ">" else _before(n, 1)
            return other is not None and other.tag != "#document" and self._match(other, parts, k - 1)
        if combinator == "~":
            own = n.siblings()
            return any(self._match(x, parts, k - 1) for x in own[: own.index(n)])
        up = n.parent
        while up is not None and up.tag != "#document":
            if self._match(up, parts, k - 1):
                return True
            up = up.parent
        return False

    def all(self, root: Node) -> list[Node]:
        return [n for n in root.walk() if self.matches(n)]


def _split(text: str, by: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == by and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _before(n: Node, k: int) -> Node | None:
    own = n.siblings()
    i = own.index(n)
    return own[i - k] if i >= k else None


def _attribute(name, op, value):
    def test(n: Node) -> bool:
        have = n.attrs.get(name)
        if have is None or op is None:
            return have is not None
        if op == "=":
            return have == value
        if op == "~=":
            return value in have.split()
        if op == "|=":
            return have == value or have.startswith(value + "-")
        return bool(value) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](value)

    return test


def _pseudo(name, argument):
    if name in ("not", "is", "where"):
        inner = Selector(argument)
        return (lambda n: not inner.matches(n)) if name == "not" else inner.matches
    if name == "empty":
        return lambda n: not n.children
    if name in ("first-child", "last-child", "only-child"):
        return lambda n: (name == "last-child" or n.siblings()[0] is n) and (name == "first-child" or n.siblings()[-1] is n)
    if name.startswith("nth-"):
        a, b = _nth(argument)
        of_type, last = "of-type" in name, "last" in name

        def test(n: Node) -> bool:
            own = [x for x in n.siblings() if not of_type or x.tag == n.tag]
            i = (own[::-1] if last else own).index(n) + 1 - b
            return i == 0 if a == 0 else i % a == 0 and i // a >= 0

        return test
    raise ValueError(f"selector: :{name} is not supported")


def _nth(text: str) -> tuple[int, int]:
    t = text.replace(" ", "").lower()
    if t in ("odd", "even"):
        return 2, int(t == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", t)
    if not m:
        raise ValueError(f"selector: {text!r}")
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


def html_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else parse_html(x).text())

    return f(c)


def query_selector_all(c: Column, selector: str) -> Column:
    """array of (tag, attrs, text, html) for what the selector matches, in document order."""
    chosen = Selector(selector)

    @F.pandas_udf("array<struct<tag:string,attrs:map<string,string>,text:string,html:string>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"tag": n.tag, "attrs": dict(n.attrs), "text": n.text(), "html": n.html()} for n in chosen.all(parse_html(x))])

    return f(c)


def rewrite_html(c: Column, selector: str, action: str, name: str = "", value: str = "") -> Column:
    """The document with what the selector matches changed: remove, unwrap, set_attribute, set_text."""
    chosen = Selector(selector)

    def change(text):
        if text is None:
            return None
        root = parse_html(text)
        for n in chosen.all(root):
            if action == "set_attribute":
                n.attrs[name] = value
            elif action == "set_text":
                n.children = [value]
            else:
                i = n.parent.children.index(n)
                inner = n.children if action == "unwrap" else []
                for child in inner:
                    if isinstance(child, Node):
                        child.parent = n.parent
                n.parent.children[i : i + 1] = inner
        return root.html()

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(change)

    return f(c)


_STEP = re.compile(r"(?P<axis>(?:parent|self|ancestor|following-sibling|preceding-sibling|descendant|child)::)?(?P<name>[\w:.-]+\(?\)?|\*|\.\.?|@[\w:-]+|@\*)(?P<preds>(?:\[[^\]]*\])*)")


def xpath_select(text: str, path: str) -> list[str]:
    """Texts (or attribute values) that a path selects: child and // steps, axes, @name, [n], [@a='v'], [tag='v'], * . ..; names are local names."""
    root = ET.fromstring(text)
    up = {c: p for p in root.iter() for c in p}
    top = ET.Element("#document")
    top.append(root)
    up[root] = top
    local = lambda e: e.tag.rpartition("}")[2]
    nodes: list = [top]
    for deep, step in re.findall(r"(//?|^)([^/]+(?:\[[^\]]*\])?)", path):
        m = _STEP.fullmatch(step)
        if not m:
            raise ValueError(f"path: {step!r}")
        found: list = []
        for n in nodes:
            bases = list(n.iter()) if deep == "//" else [n]
            for b in bases:
                name, axis = m["name"], (m["axis"] or "child::")[:-2]
                if name.startswith("@"):
                    found += [v for k, v in b.attrib.items() if name in ("@*", "@" + k.rpartition("}")[2])]
                    continue
                if name == "text()":
                    found += [t for t in [b.text, *(c.tail for c in b)] if t]
                    continue
                around = list(up[b]) if b in up else [b]
                at = around.index(b)
                line = {"child": lambda b=b: list(b), "self": lambda b=b: [b], "descendant": lambda b=b: list(b.iter())[1:], "parent": lambda b=b: [up[b]] if b in up else [], "following-sibling": lambda: around[at + 1 :], "preceding-sibling": lambda: around[:at]}
                if axis == "ancestor":
                    options, x = [], b
                    while x in up:
                        x = up[x]
                        options.append(x)
                else:
                    options = [b] if name == "." else [up[b]] if name == ".." and b in up else [] if name == ".." else line[axis]()
                own = [x for x in options if name in ("*", ".", "..", local(x))]
                for pred in re.findall(r"\[([^\]]*)\]", m["preds"]):
                    if pred.isdigit():
                        own = own[int(pred) - 1 : int(pred)]
                    elif a := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*['\"]([^'\"]*)['\"])?", pred):
                        own = [x for x in own if a[1] in x.attrib and (a[2] is None or x.attrib[a[1]] == a[2])]
                    elif a := re.fullmatch(r"([\w-]+)\s*=\s*['\"]([^'\"]*)['\"]", pred):
                        own = [x for x in own if any(local(c) == a[1] and "".join(c.itertext()) == a[2] for c in x)]
                    else:
                        raise ValueError(f"path: [{pred}]")
                found += [x for x in own if not any(x is y for y in found)]
        nodes = found
    return [n if isinstance(n, str) else "".join(n.itertext()) for n in nodes]


def xpath_all(c: Column, path: str) -> Column:
    """What a path selects; null where the text is not well-formed."""

    def one(text):
        try:
            return None if text is None else xpath_select(text, path)
        except ET.ParseError:
            return None

    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(one)

    return f(c)
