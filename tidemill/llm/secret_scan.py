"""Secret scans: keyword automaton, anchored expressions near its hits, checksums inside the token.

Method.  One Aho-Corasick automaton holds every keyword.  A text is fed to it
once; an expression is tried only where its keyword was hit, anchored there.
Tokens of kinds that embed a checksum are reported only if it is right.
Runs of hexadecimal digits have no keyword; they are found by a plain run search.

Each text is judged alone inside its own Arrow batch: no shuffle, no state, and
memory bounded by a batch of texts.

Defined results: a null text is empty; nulls in other columns pass through; an
empty text has no spans; repeated rows are scanned each; spans are in code
points, end exclusive; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import text_parts

# The base patterns and the least lengths that the contract states.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Public token prefixes whose last six characters are a base-62 CRC-32 of the rest.
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")

_assign = re.compile(ASSIGN, re.A | re.I)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_checked = re.compile(r"[A-Za-z]{3}_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def checksum62(body: str) -> str:
    """The six characters that such a token ends in."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, ("assign", len(w)))
    a.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED.items():
        for p in prefixes:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def scan(text: str, a) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    folded = text.lower()
    if len(folded) != len(text):  # some letters grow when lowered; only A-Z matter here
        folded = text.translate(_lower)
    past = dict.fromkeys(KINDS, 0)
    found = []
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in a.iter(folded))
    for at, kind in hits:
        if at < past[kind]:
            continue
        m = (_assign if kind == "assign" else _access if kind == "access" else _checked).match(text, at)
        if not m:
            continue
        if kind in CHECKED:
            if not text.startswith(CHECKED[kind], at) or checksum62(m[1]) != m[2]:
                continue
        past[kind] = m.end()
        if kind == "assign" and len(m[2]) < LEAST[kind] or kind == "access" and m.end() - at < LEAST[kind]:
            continue
        found.append((kind, at, m.end()))
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans`` with kind, start, end and value."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for b in text_parts(batches):
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in scan(text, a)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], names=["id", "spans"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans, by DataFrame functions."""
    from pyspark.sql import functions as F

    def joined(only: tuple[str, ...] | None):
        s = F.col("spans") if only is None else F.filter("spans", lambda x: x["kind"].isin(*only))
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    return spans.select("doc_id", *counts, F.sha2(joined(("assign", "access", "hex")), 256).alias("base_sha256"), joined(None).alias("spans"))
