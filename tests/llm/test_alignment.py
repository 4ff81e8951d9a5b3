"""Alignment against token lists and dictionaries."""

import hashlib
import heapq
import json
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspan.llm import alignment
from loomspan.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def read(name):
    with open(tokenizer(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def sides():
    import sentencepiece

    a = Tokenizer.from_file(tokenizer(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))


def tokens(sides, text):
    """[(id, bytes)] of each side."""
    a, b = sides
    back = alignment.byte_values()
    first = [(k, bytes(back[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    second = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
    return first, second


def expected(sides, rows):
    per, count = [], Counter()
    for i, text in rows:
        first, second = tokens(sides, text) if text else ([], [])
        if any(b"".join(x for _, x in s) != (" " + (text or "")).encode() for s in (first, second)):
            first, second = [], []
        ends = []
        for s in (first, second):
            at, out = 0, {}
            for k, x in s:
                at += len(x)
                out.setdefault(at, []).append(k)
            ends.append(out)
        links = [(a, b) for e in ends[0] if e in ends[1] for a in ends[0][e] for b in ends[1][e]]
        count.update(links)
        groups, left, right, at = [], [], [], 0
        for e in sorted({*ends[0], *ends[1]}):
            left += ends[0].get(e, [])
            right += ends[1].get(e, [])
            if e in ends[0] and e in ends[1]:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        assert not left and not right
        per.append((i, len(first), len(second), groups, links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = Counter()
    for i, na, nb, groups, links in per:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows[(i, na, nb, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha)] += 1
    return rows, {(b, a, n, n == most[b]) for (a, b), n in count.items()}


def check(sides, docs, **sizes):
    rows, counts = alignment.aligned(docs, read(A), read(B), **sizes)
    want = expected(sides, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert Counter(map(tuple, rows.collect())) == want[0]
    assert {tuple(r) for r in counts.collect()} == want[1]


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_alignment(request, sides, name):
    check(sides, request.getfixturevalue(name))


def test_many_runs_and_merges(documents, sides, monkeypatch):
    """Small buffers, few ways and small chunks: runs are merged in several rounds, and copies of counts go to several slices."""
    monkeypatch.setattr(alignment, "WAYS", 2)
    monkeypatch.setattr(alignment, "SLICE", 3)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    check(sides, documents.where("doc_id % 4 = 1").repartition(3), radix=3, buffer=700)


STRANGE = [" two  spaces ", "<|endoftext|> and <s> </s> <unk>", "tab\tline\nend\n", "▁ already ▁▁", "é́ 漢字 😀🏳️‍🌈  ", "a\x00b", "ﬁ ① Å", "    ", " ", "\n", "'s 'll can't 1234567", "x" * 3000, " " * 5000 + "y", "ǅ ⅷ ١٢ a\u0300\u200d\ufeff \u2028 \xa0\u3000z", "WE'LL don'T _ __a1b2 \r\n\r\n \t x"]


def test_strange_texts(spark, sides):
    rows = [(k, t) for k, t in enumerate(STRANGE)] + [(None, "the same"), (None, "the same"), (2**62, "the same")]
    check(sides, spark.createDataFrame(rows, "doc_id long, text string").repartition(2))


def test_both_libraries_agree(documents):
    """The faster library's ids are those of the vocabulary's own one."""
    a = alignment.side(read(A))
    assert a.ranks
    texts = [r["text"] for r in documents.collect()] + STRANGE
    want = [e.ids for e in a.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert a.encode(texts) == want
    a.ranks = None
    assert a.encode(texts) == want


def test_byte_values():
    """In the vocabulary, the letters of the 256 bytes are all there."""
    values, vocabulary = alignment.byte_values(), json.load(open(tokenizer(A)))["model"]["vocab"]
    assert sorted(values.values()) == list(range(256)) and set(values) <= set(vocabulary)
    assert values["Ġ"] == 32 and values["Ċ"] == 10


def test_merge_of_chunks():
    """A heap over chunks that come by their first pair gives what sorting gives."""
    rng = random.Random(3)
    runs = [sorted(rng.sample(range(400), rng.randrange(1, 90))) for _ in range(7)]
    chunks = [(r[k : k + 11], [rng.randrange(1, 9) for _ in r[k : k + 11]]) for r in runs for k in range(0, len(r), 11)]
    chunks.sort(key=lambda c: c[0][0])
    want = Counter()
    for pairs, totals in chunks:
        want.update(dict(zip(pairs, totals)))
    got = list(alignment.merged((p[0], p, t) for p, t in chunks))
    assert got == sorted(want.items()) and got == list(heapq.merge(got))


def test_packing():
    for x in (np.array([], np.int64), np.array([0, 1, 2**32 - 1, 2**62])):
        assert alignment.unpacked(alignment.packed(x)).tolist() == x.tolist()
