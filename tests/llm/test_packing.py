import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tidemill.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """Piece by piece, largest first, into the least gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps), sorted(gaps)


def test_supersteps_are_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 120))]
        matches, used = P.supersteps({n: lengths.count(n) for n in lengths}, capacity)
        fill = [[] for _ in range(used)]
        for length, rank, n, each, first, offset in matches:
            for k in range(n):
                fill[first + k // each].append((offset + k % each * length, length))
        gaps = []
        for s in fill:
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= capacity
            gaps.append(capacity - at)
        assert (used, sorted(gaps)) == best_fit(lengths, capacity)
        assert sorted(n for s in fill for _, n in s) == sorted(lengths)


ODD = [None, "", " ", "a", "don't  STOP now", "x" * 9000, "é ́a\x1cb", "<|endoftext|> z", "İstanbul ΣΑΣ", "a\tb\r\nc d", "你好 world 123", "w " * 5000, "a", "a"]


def test_ids_are_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    e = P.Encoder(PATH, 1)
    for given in (ODD, ODD[5:], ["", ""], [], ODD[::-1]):
        ids, at = e.encode(pa.array(given, pa.string()))
        assert len(at) == len(given) + 1 and at[-1] == len(ids)
        for k, text in enumerate(given):
            assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


TOKENIZER = Tokenizer.from_file(PATH)


class Asked:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def check_ids(e, texts):
    ids, at = e.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]


def test_new_words_share_a_text():
    e = P.Encoder(PATH, 1)
    e.tokenizer = asked = Asked(e.tokenizer)
    check_ids(e, [f"Wort{i}, don't{i}" for i in range(1000)])
    assert len(asked.texts) <= 10  # 2000 words


def test_words_with_the_mark_or_without_ids():
    mark = P.Encoder(PATH, 1).mark
    rare = ["\x85", "\u3000", mark, f"a{mark}b", mark * 3, "\u0301x", "a\u0301", "<|endoftext|>", f"<|endoftext|>{mark}", "x" * 5000]
    for many in (0, 3, P.JOINED_WORDS, 2 * P.JOINED_WORDS + 1):
        plain = [f"w{i}!" for i in range(many)]
        for texts in ([" ".join(rare + plain)], [" ".join(plain + rare)], [*rare, *plain], [f"{x} {mark} {x}z" for x in rare] + plain):
            check_ids(P.Encoder(PATH, 1), texts)
    e = P.Encoder(PATH, 1)
    e.mark = ""  # a tokenizer without any: words one by one
    check_ids(e, ["a b", *rare])


def test_words_met_again_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 50)
    e = P.Encoder(PATH, 1)
    e.tokenizer = asked = Asked(e.tokenizer)
    common = " ".join(f"common{i}" for i in range(10))
    for k in range(40):  # 400 rare words, so that room is made many times
        check_ids(e, [common + "".join(f" rare{k}x{i}" for i in range(10))])
        assert len(e.keys) <= 50
    assert sum("common3" in x.split() for x in asked.texts) == 1
    check_ids(e, [" ".join(f"many{i}" for i in range(80))])  # more than there is room for
    check_ids(e, [common])
    rng = random.Random(2)
    for _ in range(60):
        check_ids(e, [" ".join(f"v{int(rng.paretovariate(0.7)) % 300}!" for _ in range(25)) for _ in range(3)])


def test_operator(spark, make_docs):
    t = Tokenizer.from_file(PATH)
    docs = make_docs(list(enumerate(ODD)) + [(None, "no id"), (3, "a")], extra="task")
    rows = P.pack_documents(spark, docs, PATH, capacity=64).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            ids = [*t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
            assert len(ids) == r.length and r.start == 64 * r.piece and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(sequences) == best_fit([r.length for r in rows], 64)[0]
    assert P.pack_documents(spark, docs.limit(0), PATH).count() == 0
