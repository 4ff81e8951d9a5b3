"""Cross-tokenizer alignment by external spill counting (operator 13).

Two tokenizers cut the same bytes. Where tokens of both end together they are linked, and how good a link is depends on how
often its pair of ids is linked in the whole corpus. The links of all documents are too many to keep or to join, so they
are counted as an external sort would:

1. A task cuts its documents into tokens and gathers links. When the buffer is full, it is sorted by (side id, other id,
   document), parted by radix of the side id, and spilled: a run is a row of zstd blobs in a table of the shared folder.
2. Runs of a radix are merged, WAYS at a time, by a heap over the heads of their sorted pairs. Chunks of runs come in order
   of their first pair, so a task holds one chunk of each run. The last merge has a side id's pairs in one stretch, and so
   its highest count.
3. The runs are streamed once more, past the counts of their radix, and give each document its part.

A pair that every document has is one entry of each run, and a radix with a hot id is dealt out in slices of runs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import written

#: Parts of the side ids; links of a buffer; runs of one merge; runs that one task streams past the counts of a radix.
RADIX, BUFFER, WAYS, SLICE = 16, 2_000_000, 32, 128
#: Pairs of a chunk of a merged run, and characters of the texts that are cut into tokens at once.
CHUNK, PORTION = 200_000, 400_000

#: Stands for a missing id, so that tasks see whole numbers only.
_LAST = 2**63 - 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte plane by byte plane, under zstd."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


#: How a byte-level vocabulary of this kind cuts a text into words; a fixed value.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel(Side):
    """A byte-level vocabulary in JSON. Strings of its special tokens are cut like any text.

    If ids are in the order of merges, which makes them ranks, and words are cut in the usual way, a faster library encodes.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(model)
        self.model.encode_special_tokens = True
        vocabulary, letters = self.model.get_vocab(with_added_tokens=False), byte_values()
        pieces = [b""] * self.model.get_vocab_size()
        for piece, k in self.model.get_vocab().items():
            pieces[k] = bytes(letters[c] for c in piece) if piece in vocabulary and all(c in letters for c in piece) else piece.encode()
        super().__init__(pieces)
        self.ranks = self._ranks(json.loads(model), pieces)

    def _ranks(self, told: dict, pieces: list[bytes]):
        import tiktoken

        cut, merges = told.get("pre_tokenizer") or {}, told["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [told["model"]["vocab"].get("".join(m)) for m in merges]
        plain = not any(told["model"].get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not told.get("normalizer") and plain
        if not usual or ids != list(range(256, 256 + len(ids))) or any(len(p) != 1 for p in pieces[:256]):
            return None
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks={pieces[k]: k for k in range(256 + len(ids))}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self.ranks:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    """A sentence-piece model, which puts a space before a text by itself; <0xHH> is one byte."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        pieces = []
        for k in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(k)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def side(model: bytes) -> Side:
    return ByteLevel(model) if model.lstrip()[:1] == b"{" else Pieces(model)


class Cut:
    """Some texts cut by two tokenizers: tokens that end together, and what shows how they group.

    Texts that are empty, or that either tokenizer doesn't give back byte for byte, have no tokens.
    """

    def __init__(self, a: Side, b: Side, texts: list[str]):
        ids = [a.encode(texts), b.encode(texts)]
        for k, text in enumerate(texts):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if not text or any(b"".join([s.pieces[i] for i in x[k]]) != whole for s, x in zip((a, b), ids)):
                ids[0][k] = ids[1][k] = []
        self.counts = [np.array([len(x) for x in side_ids], np.int64) for side_ids in ids]
        self.ids = [np.array([i for x in side_ids for i in x], np.int64) for side_ids in ids]
        ends = [np.cumsum(s.sizes[x]) for s, x in zip((a, b), self.ids)]
        # texts are laid end to end, and both sides have the same bytes; so ends meet only within a text
        self.shared = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
        self.owner = np.repeat(np.arange(len(texts)), self.counts[0])[self.shared[0]]
        self.groups = np.bincount(self.owner, minlength=len(texts))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id of a, id of b): tokens have bytes, so one of each side ends at a place, and each group has one link."""
        return self.owner, self.ids[0][self.shared[0]], self.ids[1][self.shared[1]]

    def shown(self, signs: tuple[np.ndarray, int]) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2,b3. signs: what _signs gives."""
        table, width = signs
        before = [np.cumsum(s) - s for s in self.shared]  # groups that end before a token
        sizes = [np.bincount(g, minlength=len(self.owner)) for g in before]
        upto = [np.cumsum(s) for s in sizes]
        place = [np.arange(len(self.ids[0])) + (upto[1] - sizes[1])[before[0]], np.arange(len(self.ids[1])) + upto[0][before[1]]]
        line = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        line[place[0]] = self.ids[0] + np.where(self.shared[0], width, 0)
        line[place[1]] = self.ids[1] + np.where(self.shared[1], 2 * width, 0)
        words = table[line]
        ends = np.cumsum(self.counts[0] + self.counts[1])
        return ["".join(words[e - n : e].tolist())[:-1] for e, n in zip(ends.tolist(), (self.counts[0] + self.counts[1]).tolist())]


def _signs(width: int) -> tuple[np.ndarray, int]:
    """The texts of ids below width with the sign that follows: within a group, at the end of its a side, of its b side."""
    return np.array([f"{k}{sign}" for sign in ",|;" for k in range(width)], dtype=object), width


def _run(links: list[tuple[np.ndarray, ...]], radix: int, wide: int) -> pd.DataFrame:
    """Sorted runs of a buffer of (document, id of a, id of b), one row for each radix that has links."""
    doc, a, b = (np.concatenate(x) for x in zip(*links))
    base = int(doc.min())
    pair, doc = b * wide + a, doc - base
    order = np.lexsort((doc, pair, b % radix))
    pair, doc, part = pair[order], doc[order], (b % radix)[order]
    first = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(doc) != 0)])
    times = np.diff(np.r_[first, len(pair)])
    pair, doc, part = pair[first], doc[first], part[first]
    rows = []
    for k in np.unique(part):
        own = slice(*np.searchsorted(part, [k, k + 1]))
        p, d, n = pair[own], doc[own], times[own]
        head = np.flatnonzero(np.r_[True, np.diff(p) != 0])
        rows.append((int(k), base, int(p[0]), *_keys(p[head], wide), packed(np.add.reduceat(n, head)), packed(np.diff(np.r_[head, len(p)])), packed(d), packed(n)))
    return pd.DataFrame(rows, columns=_RUN)


def _keys(pair: np.ndarray, wide: int) -> tuple[bytes, bytes]:
    return packed(pair // wide), packed(pair % wide)


def _pairs(row: dict, wide: int) -> np.ndarray:
    return unpacked(row["b"]) * wide + unpacked(row["a"])


_RUN = ["radix", "base", "head", "b", "a", "total", "docs", "doc", "times"]
_RUN_TYPES = "radix int, base long, head long, b binary, a binary, total binary, docs binary, doc binary, times binary"
_DOC_TYPES = "id long, nameless boolean, row long, n_a long, n_b long, n_groups long, n_links long, sha string"


def tokenised(docs: DataFrame, a: bytes, b: bytes, *, id: str, text: str, radix: int = RADIX, buffer: int = BUFFER) -> DataFrame:
    """One written table of two kinds of rows: documents (row not null) and spilled runs (radix not null)."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("id"), F.col(id).isNull().alias("nameless"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    names = [x.split()[0] for x in (_DOC_TYPES + ", " + _RUN_TYPES).split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = side(a), side(b)
        wide, signs = len(left.pieces), _signs(max(len(left.pieces), len(right.pieces)))
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part in parts:
            for _, some in part.groupby(np.cumsum([len(t) for t in part["text"]]) // PORTION):
                cut = Cut(left, right, some["text"].tolist())
                shown = cut.shown(signs)
                sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
                done = some[["id", "nameless", "row"]].assign(n_a=cut.counts[0], n_b=cut.counts[1], n_groups=cut.groups, n_links=cut.groups, sha=sha)
                yield done.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
                owner, x, y = cut.links()
                held.append((some["row"].to_numpy()[owner], x, y))
                size += len(owner)
                if size >= buffer:
                    yield _run(held, radix, wide).reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
                    held, size = [], 0
        if size:
            yield _run(held, radix, wide).reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return written(rows.mapInPandas(run, f"{_DOC_TYPES}, {_RUN_TYPES}"))


def merged(chunks: Iterator[tuple[int, list[int], list[int]]]) -> Iterator[tuple[int, int]]:
    """(pair, total) in order, from chunks (first pair, pairs, totals) of sorted runs that come by their first pair."""
    heap: list[tuple[int, int, int]] = []  # (pair, chunk, place)
    open_chunks: dict[int, tuple[list[int], list[int]]] = {}
    now, total = -1, 0

    def upto(limit: float) -> Iterator[tuple[int, int]]:
        nonlocal now, total
        while heap and heap[0][0] < limit:
            pair, chunk, k = heap[0]
            pairs, totals = open_chunks[chunk]
            if pair != now:
                if total:
                    yield now, total
                now, total = pair, 0
            total += totals[k]
            if k + 1 < len(pairs):
                heapq.heapreplace(heap, (pairs[k + 1], chunk, k + 1))
            else:
                heapq.heappop(heap)
                del open_chunks[chunk]

    for number, (first, pairs, totals) in enumerate(chunks):
        yield from upto(first)
        open_chunks[number] = (pairs, totals)
        heapq.heappush(heap, (pairs[0], number, 0))
    yield from upto(float("inf"))
    if total:
        yield now, total


def _merge(runs: DataFrame, slices: int, wide: int, last: bool) -> DataFrame:
    """Runs (radix, run, head, b, a, total) merged slice by slice: (radix, run, head, b, a, total, best) by chunks.

    last: chunks end with a side id, and best marks its pairs of highest count.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for part in parts:
                yield from part.to_dict("records")

        stream = rows()
        row = next(stream, None)
        while row is not None:
            group = (row["radix"], row["slice"])

            def chunks() -> Iterator[tuple[int, list[int], list[int]]]:
                nonlocal row
                while row is not None and (row["radix"], row["slice"]) == group:
                    yield row["head"], _pairs(row, wide).tolist(), unpacked(row["total"]).tolist()
                    row = next(stream, None)

            pairs: list[int] = []
            totals: list[int] = []
            for pair, total in merged(chunks()):
                if len(pairs) >= CHUNK and (not last or pair // wide != pairs[-1] // wide):
                    yield out(group, pairs, totals)
                    pairs, totals = [], []
                pairs.append(pair)
                totals.append(total)
            if pairs:
                yield out(group, pairs, totals)

    def out(group: tuple[int, int], pairs: list[int], totals: list[int]) -> pd.DataFrame:
        p, n = np.array(pairs, np.int64), np.array(totals, np.int64)
        head = np.flatnonzero(np.r_[True, np.diff(p // wide) != 0])
        most = np.repeat(np.maximum.reduceat(n, head), np.diff(np.r_[head, len(p)]))
        return pd.DataFrame([(*group, int(p[0]), *_keys(p, wide), packed(n), packed(n == most))], columns=["radix", "run", "head", "b", "a", "total", "best"])

    dealt = runs.withColumn("slice", _slice(slices)).repartition("radix", "slice").sortWithinPartitions("radix", "slice", "head")
    return written(dealt.mapInPandas(run, "radix int, run long, head long, b binary, a binary, total binary, best binary"))


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("run"), F.lit(slices)).cast("int")


def _given_back(runs: DataFrame, counts: DataFrame, slices: int, wide: int) -> DataFrame:
    """(row, count_sum, n_best): what the runs add to each document. A slice of runs goes past a copy of its radix's counts."""
    none = F.lit(None).cast("binary")
    first = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "head", F.lit(0).cast("long").alias("base"), "b", "a", "total", "best", *[none.alias(c) for c in ("docs", "doc", "times")])
    then = runs.select("radix", _slice(slices).alias("slice"), F.lit(1).alias("kind"), "head", "base", "b", "a", none.alias("total"), none.alias("best"), "docs", "doc", "times")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, chunks, known = None, [], []
        for part in parts:
            for row in part.to_dict("records"):
                if (row["radix"], row["slice"]) != group:
                    group, chunks, known = (row["radix"], row["slice"]), [], []
                if row["kind"] == 0:
                    chunks.append((_pairs(row, wide), unpacked(row["total"]), unpacked(row["best"])))
                    continue
                if not known:
                    known = [np.concatenate(x) for x in zip(*chunks)]
                at = np.searchsorted(known[0], _pairs(row, wide))
                docs, doc, times = (unpacked(row[c]) for c in ("docs", "doc", "times"))
                order = np.argsort(doc, kind="stable")
                head = np.flatnonzero(np.r_[True, np.diff(doc[order]) != 0])
                sums = [np.add.reduceat((np.repeat(x[at], docs) * times)[order], head) for x in known[1:]]
                yield pd.DataFrame({"row": row["base"] + doc[order][head], "count_sum": sums[0], "n_best": sums[1]})

    dealt = first.unionByName(then).repartition("radix", "slice").sortWithinPartitions("radix", "slice", "kind", "head")
    return dealt.mapInPandas(run, "row long, count_sum long, n_best long")


def aligned(docs: DataFrame, a: bytes, b: bytes, *, id: str = "doc_id", text: str = "text", **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and the counts (b, a, total, best) of all pairs.

    a, b: files of a byte-level vocabulary (given a space before the text) and of a sentence-piece model, as bytes. Ids of rows
    are whole numbers. Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens:
    zeros, and '' for the digest. Repeated rows count each.
    """
    both = tokenised(docs, a, b, id=id, text=text, **sizes)
    wide = len(side(a).pieces)
    spilled = both.where("radix is not null").withColumn("run", F.col("base"))
    n = spilled.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    runs, ways = spilled.select("radix", "run", "head", "b", "a", "total"), n
    while ways > WAYS:
        ways = -(-ways // WAYS)
        runs = _merge(runs, ways, wide, False)
    counts = _merge(runs, 1, wide, True)
    parts = _given_back(spilled, counts, -(-n // SLICE), wide).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = both.where("row is not null").join(parts, "row", "left")
    zero = F.lit(0).cast("long")
    rows = out.select(
        F.when(~F.col("nameless"), F.col("id")).alias(id), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), F.col("sha").alias("groups_sha256"),
    )

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                yield pd.DataFrame({c: unpacked(row[c]) for c in ("b", "a", "total")} | {"best": unpacked(row["best"]) > 0})

    return rows, counts.mapInPandas(opened, "b int, a int, total long, best boolean")
