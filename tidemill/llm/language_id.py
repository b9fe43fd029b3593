"""Language identification by cross-parsing entropy over suffix automata.

Method.  For each language a suffix automaton is built of labelled text.  A text is
cross-parsed: from the root the automaton is followed as far as it goes, which is
the longest match that starts there; one more phrase is counted and the parse goes
on behind it.  The language that needs the fewest phrases, normalised by the
logarithm of its training length, explains the text best and wins.

Letters are lower-cased and folded to the symbols that occur in the training texts;
all else but letters is one separator, so figures and signs favour no language.
The automata are double arrays: a state's edges lie at its own offset in one common
table, whose size follows the edges and not the alphabet.  Many texts are parsed
side by side, one step of all at a time.  So that a very long text is no slower than
many short ones it is parsed in segments at once, each from the root; where the
parse of the segment before, carried on, begins a phrase that this one begins
as well, both are the same from there on.  The phrases counted are those of one parse
of the whole text; where a segment's parse never meets the one before, the
text is parsed again in one go.

Training is bounded: ``TRAIN_CHARS`` symbols a language, from whole texts taken in
the order of a hash of their id until the bound is reached; the automata's size is
bounded by that and they are broadcast.  Everything else covers every row.

Defined results: null text, or text without letters, is ``und`` with score 0; ties
between languages go to the first by name; a table without labelled rows gives
``und`` for all; repeated rows are judged each; an empty table gives an empty
result; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import text_parts

#: Symbols of training text a language; texts enter whole but for the last.
TRAIN_CHARS = 60_000
#: Rows a language that may be looked at to get them.
TRAIN_ROWS = 400
#: Symbols of a text that are parsed in one go before its other segments are joined; no result depends on it.
SEGMENT = 512
UNDETERMINED = "und"


def folded(text: str) -> str:
    """Lower-case letters, everything else one blank."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


class Automaton:
    """The suffix automaton of a symbol sequence as a double array.

    A state is the offset of its edges in two common tables: its edge by symbol c leads
    to ``next[state + c]``, if ``owner[state + c]`` is the state itself.  State 0, the
    root, has no edges there; ``start[c]`` is where a new phrase that begins with c
    leads, which is 0 again if no phrase does.
    """

    def __init__(self, symbols: list[int], alphabet: int):
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.size = len(symbols)
        self.start, self.owner, self.next = double_array(edges, alphabet)


def double_array(edges: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases begin by symbol, and the tables of owners and targets; state 0 of ``edges`` is the root."""
    size = 2 * sum(map(len, edges)) + 4 * alphabet
    base, used, taken = [0] * len(edges), bytearray(size), bytearray(size)
    taken[0] = 1
    low = 1
    for s in sorted(range(1, len(edges)), key=lambda s: -len(edges[s])):
        own = edges[s]
        at = low
        while taken[at] or any(used[at + c] for c in own):
            at += 1
        low = max(low, at - 32)  # holes further back are left
        if at + 2 * alphabet >= len(used):
            used, taken = used + bytearray(len(used)), taken + bytearray(len(taken))
        taken[at] = 1
        for c in own:
            used[at + c] = 1
        base[s] = at
    top = max(base) + alphabet + 1
    owner, target = np.full(top, -1, np.int32), np.zeros(top, np.int32)
    of = np.array(base, np.int64)
    state = np.repeat(np.arange(1, len(edges)), [len(e) for e in edges[1:]])
    place = of[state] + np.fromiter((c for e in edges[1:] for c in e), np.int64, len(state))
    owner[place] = of[state]
    target[place] = of[np.fromiter((t for e in edges[1:] for t in e.values()), np.int64, len(state))]
    start = np.zeros(alphabet, np.int32)
    start[list(edges[0])] = of[list(edges[0].values())]
    return start, owner, target


def parse(a: Automaton, symbols: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse segments side by side from the root: a column each, of which the first ``live[t]`` have a symbol in row t.

    Returns where phrases begin, in the same layout, and the states at the ends.
    """
    steps, lanes = symbols.shape
    begins, state = np.zeros(symbols.shape, bool), np.zeros(lanes, np.int32)
    fresh = a.start[symbols]
    place, owner, to, on = np.empty(lanes, np.int64), np.empty(lanes, np.int32), np.empty(lanes, np.int32), np.empty(lanes, bool)
    for t in range(steps):
        n = live[t]
        now = state[:n]
        np.add(now, symbols[t, :n], out=place[:n])
        np.take(a.owner, place[:n], out=owner[:n], mode="clip")
        np.take(a.next, place[:n], out=to[:n], mode="clip")
        np.equal(owner[:n], now, out=on[:n])
        np.logical_not(on[:n], out=begins[t, :n])  # the match ends; the symbol begins the next, or is a phrase of its own
        np.copyto(now, fresh[t, :n])
        np.copyto(now, to[:n], where=on[:n])
    return begins, state


def joined(a: Automaton, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry parses on from ``start`` until they begin a phrase where ``begins`` has one.

    Returns where that is (-1: not before ``end``) and the phrases begun before.
    """
    met, more = np.full(len(start), -1, np.int64), np.zeros(len(start), np.int64)
    lane, at, state = np.arange(len(start)), start.copy(), state.copy()
    while len(lane):
        c = symbols[at]
        place = state + c
        fresh = a.owner[place] != state
        done = fresh & begins[at]
        met[lane[done]] = at[done]
        more[lane[fresh & ~done]] += 1
        go = ~done & (at + 1 < end[lane])
        state = np.where(fresh, a.start[c], a.next[place])[go]
        lane, at = lane[go], at[go] + 1
    return met, more


def phrases_of(a: Automaton, symbols: list[int]) -> int:
    """The phrases of one text, symbol by symbol."""
    owner, to, start = a.owner, a.next, a.start.tolist()
    state = n = 0
    for c in symbols:
        if state and owner[state + c] == state:
            state = int(to[state + c])
        else:
            n += 1
            state = start[c]
    return n


class Model:
    """Automata by language, and the fold from code points to symbols (0: separator, 1: unknown letter)."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        texts = {k: " ".join(folded(t).split())[:TRAIN_CHARS] for k, t in texts.items()}
        letters = sorted({c for t in texts.values() for c in t} - {" "})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}
        self.alphabet = len(letters) + 2
        self.automata = [Automaton([self.symbol.get(c, 0) for c in texts[k]], self.alphabet) for k in self.languages]
        self.bits = [np.log2(max(2, a.size)) for a in self.automata]

    def fold_table(self) -> np.ndarray:
        """Symbol of every code point of the basic plane and beyond, by rule."""
        table = np.zeros(0x110000, np.int16)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                table[point] = self.symbol.get(c.lower()[0], 1)
        return table

    def costs(self, texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each text and language, and the number of letters of each text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = fold[points]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(row[symbols > 0], minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
        blank = symbols == 0
        keep = np.ones(len(symbols), bool)  # one blank where several follow
        keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
        symbols, row = symbols[keep].astype(np.int64), row[keep]
        sizes = np.bincount(row, minlength=len(texts))
        begin = np.cumsum(sizes) - sizes
        parts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = begin[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        steps = int(length.max(initial=0))
        live = np.searchsorted(-length[order], -np.arange(steps), side="left")  # segments longer than the step
        place = start[order][None, :] + np.arange(steps)[:, None]
        inside = np.arange(len(order))[None, :] < live[:, None]
        grid = symbols[np.where(inside, place, 0)] if len(symbols) else np.zeros(place.shape, np.int64)
        behind = np.flatnonzero(nth > 0)  # segments that another one of their text precedes
        out = np.zeros((len(texts), len(self.automata)))
        for k, a in enumerate(self.automata):
            marks, ends = parse(a, grid, live)
            begins = np.zeros(len(symbols), bool)
            begins[place[inside]] = marks[inside]
            state = np.empty(len(owner), np.int32)
            state[order] = ends
            count = np.concatenate([[0], np.cumsum(begins)])
            phrases = count[start + length] - count[start]
            if len(behind):
                end = start[behind] + length[behind]
                met, more = joined(a, symbols, start[behind], end, state[behind - 1], begins)
                phrases[behind] = count[end] - count[np.where(met < 0, end, met)] + more
                total = np.bincount(owner, phrases, len(texts))
                lost = behind[(met < 0) & (nth[behind] < parts[owner[behind]] - 1)]  # in a text's last segment the parse just ends
                for i in np.unique(owner[lost]).tolist():
                    total[i] = phrases_of(a, symbols[begin[i] : begin[i] + sizes[i]].tolist())
            else:
                total = np.bincount(owner, phrases, len(texts))
            out[:, k] = total * self.bits[k]
        return out, letters


def training_texts(docs: DataFrame) -> dict[str, str]:
    """Bounded text of each language, in the order of a hash of the row's id."""
    from pyspark.sql import Window

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64(F.col("doc_id").cast("string"))
    sieve = F.lit(False)
    for lang, n in ((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()):  # a row a language
        sieve = sieve | ((F.col("lang") == lang) & (F.pmod(h, F.lit(1_000_000)) < int(min(1.0, 2 * TRAIN_ROWS / n) * 1_000_000) + 1))
    rows = rows.filter(sieve).select("lang", h.alias("h"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= TRAIN_ROWS)
    enough = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    got = ranked.withColumn("before", F.coalesce(enough, F.lit(0))).filter(F.col("before") < 2 * TRAIN_CHARS).orderBy("lang", "n").collect()  # bounded by both parameters
    texts: dict[str, list[str]] = {}
    for r in got:
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: " ".join(v) for k, v in texts.items()}


def fit(docs: DataFrame) -> Model:
    """A model of the rows given: their text and non-null lang."""
    return Model(training_texts(docs))


_folds: dict[tuple, np.ndarray] = {}


def label(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score``: the margin to the next language, 0 to 1, and
    ``phrase_letters``: letters by phrase of the language told, which is near 1 where it explains nothing.

    Columns of those names in the input are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "phrase_letters")
    at = docs.schema.names.index("text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        key = tuple(m.symbol)
        if key not in _folds:
            _folds.clear()
            _folds[key] = m.fold_table()
        for b in text_parts(batches, at):
            texts = [t or "" for t in b.column(at).to_pylist()]
            cost, letters = m.costs(texts, _folds[key])
            names, scores, long = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if m.languages and len(texts):
                best = cost.argmin(axis=1)
                ordered = np.sort(cost, axis=1)
                if len(m.languages) > 1:
                    scores = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12)
                else:
                    scores = np.ones(len(texts))
                scores = np.clip(np.where(letters > 0, scores, 0), 0, 1)
                long = letters / np.maximum(cost.min(axis=1) / np.array(m.bits)[best], 1)
                names = [m.languages[k] if n else UNDETERMINED for k, n in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(long)], names=[*b.schema.names, "lang_pred", "score", "phrase_letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, phrase_letters double")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``."""
    return label(docs.select("doc_id", "text"), model)


def held_out(folds: int, which: int):
    """Whether a row belongs to the held-out fold: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == which, F.lit(False))
