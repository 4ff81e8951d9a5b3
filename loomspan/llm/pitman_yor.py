"""Language-model scoring with a hierarchical Pitman-Yor model (operator 5).

A text is a sequence of words and one end. Each word is a customer of its context's restaurant. Contexts form a tree: the
word before (at the start of a text: the end sign), then the class of words with the same last two bytes, then no context,
then the uniform distribution over the words seen in training and one unknown word. A restaurant's tables are customers of
the next one, so all contexts of a class share a parent, and all classes share theirs.

Seating is collapsed to the number of tables of each dish. A Gibbs step draws that number for one dish from its conditional,
given all other tables and the parent's predictive probabilities without the dish's own customers there: in proportion to
the new tables' probabilities times a generalised Stirling number (how many ways there are to seat c customers at t
tables). Sweeps go on from one another; predictive probabilities are averaged over the sweeps after a burn-in.

Everything under a class is in one shard, so a task seats two levels of the tree by itself; the root's customers are summed
over shards by word. Shards and draws depend on counts and hashes only, so neither partitions nor their order matter. A class
with too many tokens for a shard is divided by its words; a context word with too many, by buckets of the word that
follows: the bucket is predicted first, then the word within it, under the root's distribution within the bucket.

Words are told apart by 64-bit hashes. Nothing is capped: all words, contexts and pairs of all training texts count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import written
from loomspan.llm.langid import fold

STRENGTH, BURN_IN, SAMPLES = 1.0, 3, 3
SMOOTH = 0.1
#: Tokens of a shard, on average.
SHARD = 1_200_000
#: Bytes of texts that a task bundles at once, and that it cuts into words at once; a longer text is a bundle of its own.
BUNDLE, PIECE = 5 << 20, 1 << 19
#: Most frequent words, which bundles write by number; others by hash. No word is treated otherwise.
HEAD = 1 << 16
#: Customers up to which Stirling numbers are exact; beyond, a saddle point gives them. Table numbers that a draw weighs there.
EXACT, WINDOW = 64, 48
#: Dishes of a restaurant are drawn in so many turns; what a turn draws at once doesn't see each other's new tables.
TURNS = 8
END = np.uint64(0x656E64)
START_CLASS = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_VALUE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        m = max(n + 1, 1 << 20)
        _POWERS["up"] = np.cumprod(np.r_[np.uint64(1), np.full(m, _ODD)])
        _POWERS["down"] = np.cumprod(np.r_[np.uint64(1), np.full(m, _BACK)])
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _tokens(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    buf = buf + (((buf - np.uint8(65)) < 26).astype(np.uint8) << 5)
    gap = (buf == 32) | ((buf - np.uint8(9)) < 5)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(buf) else np.empty(0, np.int64)
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1 if len(buf) else starts
    up, down = _powers(len(buf))
    sums = np.r_[np.uint64(0), np.cumsum(_VALUE[buf] * up[: len(buf)])]
    size = ends - starts
    words = mixed(mixed((sums[ends] - sums[starts]) * down[starts]) + size.astype(np.uint64))
    tails = buf[ends - 1].astype(np.int32) + 256 * np.where(size > 1, buf[ends - 2], 0).astype(np.int32)
    doc = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, "right")
    sizes = np.bincount(doc, minlength=len(data)) + 1
    h, tail = np.full(sizes.sum(), END), np.full(sizes.sum(), START_CLASS, np.int32)
    place = np.arange(len(words)) + doc
    h[place], tail[place] = words, tails
    return h, tail, sizes


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token of the texts, the ends included, and the number of each text's tokens.

    A-Z is lower-cased and words are cut at ASCII white space; a null text counts as empty. The end's class is that of the start.
    """
    found, data, size = [], [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if data and size + len(b) > PIECE:
            found.append(_tokens(data))
            data, size = [], 0
        data.append(b)
        size += len(b)
    found.append(_tokens(data))
    return tuple(np.concatenate(x) for x in zip(*found))


def _gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in larger pieces, of about BUNDLE bytes of text."""
    held, size = [], 0
    for part in parts:
        sizes = part["text"].str.len().fillna(0).to_numpy()
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > BUNDLE:
                yield pd.concat([*held, part.iloc[start:i]], ignore_index=True)
                held, size, start = [], 0, i
            size += n
        held.append(part.iloc[start:])
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, tail, c) over a column text: each distinct token's hash, its class as a context, and its count."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _gathered(parts):
            h, tail, _ = tokens(part["text"].tolist())
            words, at, back = _distinct(h)
            yield pd.DataFrame({"h": words.view(np.int64), "tail": tail[at], "c": np.bincount(back)})

    counted = texts.select("text").mapInPandas(run, "h long, tail int, c long")
    return counted.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


class Plan(NamedTuple):
    """How contexts are dealt to shards: parts of each class, and the buckets and counts of context words too frequent for a shard.

    head: the most frequent words, by hash.
    """

    shards: int
    parts: np.ndarray
    hot: np.ndarray
    ways: np.ndarray
    counts: np.ndarray
    head: np.ndarray

    def contexts(self, before: np.ndarray, tail: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and class of tokens with these words (and their classes) before them."""
        context = before.copy()
        group = mixed((before >> np.uint64(17)) % self.parts[tail] * np.uint64(1 << 20) + tail.astype(np.uint64) + np.uint64(1))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
            mine = np.flatnonzero(self.hot[at] == before)
            bucket = (word[mine] >> np.uint64(20)) & (self.ways[at[mine]] - np.uint64(1))
            context[mine] = group[mine] = bucketed(before[mine], bucket)
        return context, group


def bucketed(before: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return mixed(before + (bucket + np.uint64(1)) * _ODD)


def planned(words: DataFrame, n: int, shard: int) -> Plan:
    """From a written table of word_counts. Collected: HEAD rows, one row a class (65,537 at most) and the words with half a shard's tokens.

    Classes are divided at a quarter of a shard, so that shards come out even.
    """
    most = max(shard // 2, 1)
    hot = sorted((r["h"] % (1 << 64), r["c"]) for r in words.where(F.col("c") >= most).select("h", "c").collect())
    parts = np.ones(START_CLASS + 1, np.uint64)
    for r in words.where(F.col("c") < most).groupBy("tail").agg(F.sum("c").alias("c")).collect():
        parts[r["tail"]] = -(-4 * r["c"] // shard)
    ways = [1 << (4 * c // shard).bit_length() for _, c in hot]
    head = words.orderBy(F.desc("c"), "h").select("h").limit(HEAD).toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    return Plan(max(1, -(-n // shard)), parts, np.array([h for h, _ in hot], np.uint64), np.array(ways, np.uint64), np.array([c for _, c in hot], np.int64), np.sort(head))


_PACKED = "shard int, batch long, names array<{kind}>, before binary, tails binary, sizes binary, rare binary, word binary, weights binary, docs binary"
_TYPES = {"before": np.uint32, "tails": np.uint32, "sizes": np.uint32, "rare": np.uint64, "word": np.uint32, "weights": np.uint32, "docs": np.uint32}


def _pack(x: np.ndarray, kind: type) -> bytes:
    """Compressed integers; small ones by planes of bytes."""
    x = np.ascontiguousarray(x.astype(kind))
    planes = x if kind is not np.uint32 else x.view(np.uint8).reshape(-1, 4).T
    return _PACKER.compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = _UNPACKER.decompress(data)
    if kind is not np.uint32:
        return np.frombuffer(raw, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(kind).ravel()


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, an index of each, and of each element its value's number."""
    order = np.argsort(x)
    there = x[order]
    new = np.r_[True, there[1:] != there[:-1]] if len(x) else np.empty(0, bool)
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return there[new], order[new], back


def bundles(docs: DataFrame, plan: Plan, each: bool) -> DataFrame:
    """Rows of (doc_id, text, train) as bundles: the pairs (context, word) of many texts that go to one shard.

    A bundle lists its contexts (the word before, its class, the number of entries), and of each entry the word and its
    training weight. Words are numbers: below HEAD in plan.head, then in the bundle's list of rare ones; numbers ascend (the
    words' within a context) and are written as steps. Entries are pairs,
    mostly distinct; with `each`, every token is one and has its text's index, and each batch has a row of its texts' ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(plan)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, base = told.value, TaskContext.get().partitionId() << 32
        for number, part in enumerate(_gathered(parts)):
            h, tail, sizes = tokens(part["text"].tolist())
            words, _, word = _distinct(h)
            known = np.minimum(np.searchsorted(plan.head, words), max(len(plan.head) - 1, 0))
            usual = plan.head[known] == words if len(plan.head) else np.zeros(len(words), bool)
            before, btail = np.r_[END, h[:-1]], np.r_[np.int32(START_CLASS), tail[:-1]]
            start = np.searchsorted(words, END)
            previous = np.r_[start, word[:-1]]
            context, group = plan.contexts(before, btail, h)
            shard = (group % np.uint64(plan.shards)).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            weight = part["train"].to_numpy(bool)[doc].astype(np.int64)
            place = np.where(usual, known, HEAD + np.arange(len(words)))
            by = np.argsort(shard << 44 | place[previous] << 22 | place[word])
            shard, context, previous, btail, word, doc, weight = shard[by], context[by], previous[by], btail[by], word[by], doc[by], weight[by]
            if not each:
                new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
                weight = np.add.reduceat(weight, new)
                shard, context, previous, btail, word, doc = shard[new], context[new], previous[new], btail[new], word[new], doc[:0]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            rows, code = [], np.where(usual, known, 0)
            for a, b in zip(cuts[:-1], cuts[1:]):
                first = a + np.flatnonzero(np.r_[True, context[a + 1 : b] != context[a : b - 1]])
                ws = np.r_[previous[first], word[a:b]]
                rare = np.unique(ws[~usual[ws]])
                code[rare] = HEAD + np.arange(len(rare))
                at, above = code[word[a:b]], code[previous[first]]
                step = np.diff(at, prepend=0)
                step[first - a] = at[first - a]
                fields = (np.diff(above, prepend=0), btail[first], np.diff(np.r_[first, b]), words[rare], step, weight[a:b], doc[a:b])
                rows.append((shard[a], base + number, None, *(_pack(x, k) for x, k in zip(fields, _TYPES.values()))))
            if each:
                rows.append((number % plan.shards, base + number, part["doc_id"].tolist(), *[b""] * len(_TYPES)))
            yield pd.DataFrame(rows, columns=["shard", "batch", "names", *_TYPES])

    return docs.select("doc_id", "text", "train").mapInPandas(run, _PACKED.format(kind=kind))


@lru_cache(4)
def _stirling(d: float, most: int = 512) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] ways to seat c customers at t tables, for c up to `most`."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


@lru_cache(4)
def _saddle(d: float) -> tuple[np.ndarray, ...]:
    """Saddle points of the generating function (1 - (1 - z) ** d) ** t: c / t, log z, the exponent and the variance."""
    y = np.exp(np.r_[-np.exp(np.linspace(-25, -1, 8000)), np.linspace(-0.37, -30 / (1 - d), 24000)])
    s, inside = np.log1p(-y), -np.expm1(d * np.log(y))
    rate = np.exp(s) * d * y ** (d - 1) / inside
    bend = np.maximum(rate * (1 + (1 - d) * np.exp(s) / y - rate), 1e-12)
    up = np.r_[True, np.diff(np.maximum.accumulate(rate)) > 0]
    return tuple(x[up] for x in (rate, s, np.log(inside) - rate * s, bend))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - np.log(shift)


@lru_cache(16)
def _repaired(d: float) -> np.ndarray:
    """What the saddle point misses at 512 customers, by tables; it depends little on the customers."""
    t = np.arange(1, 257)
    out = _stirling(d)[512, 1:257] - _approached(np.full(256, 512.0), t.astype(float), d)
    return np.r_[0.0, out - out[-1], 0.0]


def _approached(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    rate, at, power, bend = _saddle(d)
    ratio = np.maximum(c / t, rate[0])
    i = np.searchsorted(rate, ratio, "right") - 1
    step = ratio - rate[i]
    exponent = power[i] - at[i] * step - step * step / (2 * bend[i])
    spread = bend[i] * (1 + np.where(i + 1 < len(rate), (bend[np.minimum(i + 1, len(rate) - 1)] / bend[i] - 1) * step / np.maximum(rate[np.minimum(i + 1, len(rate) - 1)] - rate[i], 1e-300), 0))
    return t * exponent - 0.5 * np.log(2 * np.pi * t * spread) + _log_gamma(c + 1) - _log_gamma(t + 1) - t * np.log(d)


def log_ways(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of a generalised Stirling number up to a constant of c, for many customers."""
    return _approached(c, t, d) + _repaired(d)[np.minimum(t, 257).astype(np.int64)]


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each key; its own in each turn."""
    return ((mixed(key ^ mixed(np.full(1, turn * 2 + 1, np.uint64) * _ODD)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class Parent(NamedTuple):
    """What a dish meets at its restaurant's parent, without the customers that it has sent there itself.

    The first new table's probability, and of the k-th after it (k from 1) (own + k) / (all + k).
    """

    first: np.ndarray
    own: np.ndarray
    all: np.ndarray

    def at(self, which: np.ndarray) -> Parent:
        return Parent(self.first[which], self.own[which], self.all[which])


def met(c, t, n, tables, d: float, base, sent) -> Parent:
    """Parent of dishes with c customers and t tables among n and `tables`, when `sent` customers are taken away."""
    left = c - sent
    mine = np.where(left > 0, np.clip(t, 1, np.maximum(left, 1)), 0)
    others, n = tables - t, n - sent
    first = (np.maximum(left - d * mine, 0) + (STRENGTH + d * (others + mine)) * base) / (STRENGTH + n)
    then = np.maximum(mine, 1)
    own = np.maximum(left - d * then, -d) + (STRENGTH + d * (others + then)) * base
    return Parent(first, np.maximum(own, 1e-300), STRENGTH + n)


def always(p: np.ndarray) -> Parent:
    """A parent whose probabilities don't depend on the customers sent to it."""
    return Parent(p, p * 1e15, np.full(len(p), 1e15))


def chance(c, t, n, tables, d: float, base) -> np.ndarray:
    """Predictive probability of a dish."""
    return (np.maximum(c - d * t, 0) + (STRENGTH + d * tables) * base) / (STRENGTH + n)


def drawn(c: np.ndarray, t: np.ndarray, others: np.ndarray, d: float, parent: Parent, key: np.ndarray, turn: int) -> np.ndarray:
    """A new number of tables of dishes with c > 1 customers, given `others` tables in the restaurant, from the conditional."""
    out, u = np.ones_like(c), uniform(key, turn)
    low = 2
    while low <= EXACT:
        high = min(2 * low - 1, EXACT)
        rows = np.flatnonzero((c >= low) & (c <= high))
        for a in range(0, len(rows), 1 << 16):
            at = rows[a : a + (1 << 16)]
            k = np.arange(1, high)[None, :]
            p = parent.at(at)
            step = np.log((STRENGTH + d * (others[at][:, None] + k)) * (p.own[:, None] + k) / (p.all[:, None] + k))
            logit = _stirling(d)[c[at], 1 : high + 1]
            logit[:, 1:] += np.cumsum(step, axis=1)
            out[at] = 1 + _picked(logit, u[at])
        low = high + 1
    rows = np.flatnonzero(c > EXACT)
    for a in range(0, len(rows), 1 << 14):
        at = rows[a : a + (1 << 14)]
        out[at] = _many(c[at].astype(float), t[at], others[at].astype(float), d, parent.at(at), u[at], turn)
    return out


def _picked(logit: np.ndarray, u: np.ndarray) -> np.ndarray:
    weight = np.cumsum(np.exp(logit - logit.max(1, keepdims=True)), axis=1)
    return np.minimum((weight < u[:, None] * weight[:, -1:]).sum(1), logit.shape[1] - 1)


def _weighed(c, t, others, d: float, p: Parent) -> np.ndarray:
    """Log conditional of t tables up to a constant; t has a column for each number weighed."""
    own, every, more = p.own[:, None], p.all[:, None], (STRENGTH / d + others)[:, None]
    new = t * np.log(d) + _log_gamma(more + t) + _log_gamma(own + t) - _log_gamma(every + t) - _log_gamma(own + 1) + _log_gamma(every + 1)
    return new + np.log(p.first)[:, None] + log_ways(np.broadcast_to(c[:, None], t.shape), t, d)


def _many(c, t, others, d: float, p: Parent, u: np.ndarray, turn: int) -> np.ndarray:
    """Dishes of many customers: t from a window of numbers around the last one, or for t = 0 (none yet) the best of a geometric grid.

    The window's place is random and its step doesn't depend on t, so the draw keeps the conditional.
    """
    t = t.astype(np.float64)
    none = np.flatnonzero(t == 0)
    if len(none):
        grid = np.floor(np.exp(np.log(c[none])[:, None] * np.linspace(0, 1, WINDOW)[None, :]) + 1e-9)
        t[none] = grid[np.arange(len(none)), _weighed(c[none], grid, others[none], d, p.at(none)).argmax(1)]
    step = np.maximum(1, np.floor(c ** (0.75 if turn % 2 else 0.5) / 32))
    place = np.floor(u * WINDOW)
    within = u * WINDOW - place
    table = t[:, None] + (np.arange(WINDOW)[None, :] - place[:, None]) * step[:, None]
    good = (table >= 1) & (table <= c[:, None])
    logit = np.where(good, _weighed(c, np.clip(table, 1, c[:, None]), others, d, p), -np.inf)
    return table[np.arange(len(c)), _picked(logit, within)].astype(np.int64)


def discount(c: np.ndarray) -> float:
    once, twice = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
    return round(float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)), 3)


class Root(NamedTuple):
    """The root's restaurant as dishes of a shard see it, and the uniform base; `known` is unigram counts."""

    c: np.ndarray
    t: np.ndarray
    n: int
    tables: int
    d: float
    base: float

    def parent(self, which: np.ndarray, sent: np.ndarray, share: np.ndarray) -> Parent:
        if not self.n:
            return always(self.base / share)
        c = self.c[which]
        got = met(c, self.t[which], self.n, self.tables, self.d, self.base, np.minimum(sent, c))
        return Parent(got.first / share, got.own / share, got.all)

    def chance(self, which: np.ndarray) -> np.ndarray:
        return chance(self.c[which], self.t[which], self.n, self.tables, self.d, self.base)


def flat_root(words: int, base: float) -> Root:
    """A root without customers: the base alone."""
    none = np.zeros(words, np.int64)
    return Root(none, none, 0, 0, 0.5, base)


class Tree:
    """The restaurants of the contexts and classes of a shard: table numbers of all dishes."""

    def __init__(self, key, context, group, word, count, root: Root, share):
        """Arrays over distinct pairs: a random key, indices of the context, its class and the word, and the training count.

        share: of each class, the root's mass that its dishes hold (1, or a bucket's).
        """
        self.key, self.context, self.word, self.c, self.root = key, context, word, count, root
        _, first, self.up = _distinct(group.astype(np.int64) * max(len(root.c), 1) + word)
        self.up_key, self.up_word, self.up_group = mixed(mixed(key[first])), word[first], group[first]
        self.share = share[self.up_group]
        self.base = root.chance(self.up_word) / self.share
        self.d = discount(count)
        self.t = (count > 0).astype(np.int64)
        self.n = np.bincount(context, count).astype(np.int64)
        self.tables = np.bincount(context, self.t).astype(np.int64)
        self.c1 = np.bincount(self.up, self.t).astype(np.int64)
        self.d1 = discount(self.c1)
        self.t1 = np.minimum(self.c1, 1)
        self.n1 = np.bincount(self.up_group, self.c1).astype(np.int64)
        self.tables1 = np.bincount(self.up_group, self.t1).astype(np.int64)
        self.turns = self._turns(np.flatnonzero(count > 1), context)
        self.made = 0

    @staticmethod
    def _turns(live: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """The dishes of `live` dealt so that each turn has one of each TURNS in a restaurant."""
        live = live[np.argsort(room[live], kind="stable")]
        if not len(live):
            return []
        new = np.flatnonzero(np.r_[True, np.diff(room[live]) != 0])
        rank = np.arange(len(live)) - np.repeat(new, np.diff(np.r_[new, len(live)]))
        return [x for k in range(TURNS) if len(x := live[rank % TURNS == k])]

    def sweep(self) -> None:
        """Draws every dish of every restaurant once, given the others' current tables."""
        first = self.made == 0
        base = self.base
        for x in self.turns:
            up = self.up[x]
            room = self.up_group[up]
            p = met(self.c1[up], self.t1[up], self.n1[room], self.tables1[room], self.d1, base[up], self.t[x])
            before = self.t[x]
            new = drawn(self.c[x], np.where(first & (self.c[x] > EXACT), 0, before), self.tables[self.context[x]] - before, self.d, p, self.key[x], self.made)
            self.t[x] = new
            np.add.at(self.tables, self.context[x], new - before)
            np.add.at(self.c1, up, new - before)
            np.add.at(self.n1, room, new - before)
        self._fit()
        for x in self._turns(np.flatnonzero(self.c1 > 1), self.up_group):
            p = self.root.parent(self.up_word[x], self.t1[x], self.share[x])
            before = self.t1[x]
            new = drawn(self.c1[x], np.where(first & (self.c1[x] > EXACT), 0, before), self.tables1[self.up_group[x]] - before, self.d1, p, self.up_key[x], self.made)
            self.t1[x] = new
            np.add.at(self.tables1, self.up_group[x], new - before)
        self.made += 1

    def _fit(self) -> None:
        """Classes' dishes have from one table to one for each customer."""
        self.t1 = np.clip(self.t1, np.minimum(self.c1, 1), self.c1)
        self.tables1 = np.bincount(self.up_group, self.t1, minlength=len(self.tables1)).astype(np.int64)

    def chance(self) -> np.ndarray:
        """Predictive probability of each pair's word in its context."""
        above = chance(self.c1, self.t1, self.n1[self.up_group], self.tables1[self.up_group], self.d1, self.base)
        return chance(self.c, self.t, self.n[self.context], self.tables[self.context], self.d, above[self.up])

    def averaged(self, burn_in: int, samples: int) -> np.ndarray:
        total = np.zeros(len(self.c))
        for k in range(burn_in + samples):
            self.sweep()
            if k >= burn_in:
                total += self.chance() / samples
        return total


def _summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of steps, from anew in each run."""
    upto, starts = np.cumsum(steps, dtype=np.int64), np.cumsum(sizes, dtype=np.int64) - sizes
    return upto - np.repeat(upto[starts] - steps[starts], sizes)


class Shard:
    """The distinct pairs of a shard's bundles, and of each entry its pair."""

    def __init__(self, rows: pd.DataFrame, plan: Plan):
        self.rows = rows = rows[rows["names"].isna()].sort_values("batch", kind="stable")
        got = {k: [_unpack(x, t) for x in rows[k]] for k, t in _TYPES.items()}
        self.docs, self.lengths = got["docs"], [len(x) for x in got["word"]]
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        hashes = np.unique(np.concatenate([plan.head, *got["rare"]]))
        usual = np.searchsorted(hashes, plan.head)
        code = [np.r_[usual, np.zeros(HEAD - len(usual), np.int64), np.searchsorted(hashes, r)] for r in got["rare"]]
        runs = cat([c[np.cumsum(b, dtype=np.int64)] for c, b in zip(code, got["before"])], np.int64)
        sizes, tails = cat(got["sizes"], np.uint32).astype(np.int64), cat(got["tails"], np.uint32)
        word = cat([c[_summed(w, n)] for c, w, n in zip(code, got["word"], got["sizes"])], np.int64)
        self.weights = cat(got["weights"], np.uint32)
        starts = np.cumsum(sizes) - sizes
        context, group = plan.contexts(hashes[runs], tails, hashes[word[starts]])
        self.contexts, at, run = _distinct(context)
        groups, _, group_of = _distinct(group[at])
        used = np.flatnonzero(np.bincount(word, minlength=len(hashes)))
        self.words, place = hashes[used], np.zeros(len(hashes), np.int64)
        place[used] = np.arange(len(used))
        n = max(len(used), 1)
        pairs, _, self.pair = _distinct(np.repeat(run, sizes) * n + place[word])
        del code, runs, tails, word, got
        self.context, self.word = pairs // n, pairs % n
        self.groups, self.group = groups, group_of[self.context]
        self.key = mixed(self.contexts[self.context] * _ODD ^ mixed(self.words[self.word]))
        self.count = np.bincount(self.pair, self.weights, minlength=len(pairs)).astype(np.int64)

    def tree(self, root: Root, share: np.ndarray) -> Tree:
        return Tree(self.key, self.context, self.group, self.word, self.count, root, share)


class Buckets(NamedTuple):
    """Contexts that are buckets of hot words: their keys in order, the root's mass in each, the word's count and buckets."""

    key: np.ndarray
    mass: np.ndarray
    count: np.ndarray
    ways: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are buckets, and their indices."""
        if not len(self.key):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        mine = np.flatnonzero(self.key[at] == keys)
        return mine, at[mine]

    def share(self, groups: np.ndarray) -> np.ndarray:
        out = np.ones(len(groups))
        mine, at = self.find(groups)
        out[mine] = self.mass[at]
        return out


def bucket_table(plan: Plan, mass: np.ndarray) -> Buckets:
    """mass: the root's, by the finest buckets (a power of two of them). As many rows as buckets, which shards bound."""
    rows = []
    for h, ways, c in zip(plan.hot.tolist(), plan.ways.tolist(), plan.counts.tolist()):
        b = np.arange(ways, dtype=np.uint64)
        keys = bucketed(np.full(ways, h, np.uint64), b)
        rows += zip(keys.tolist(), mass.reshape(-1, ways).sum(0).tolist(), [c] * ways, [ways] * ways)
    rows.sort()
    key, mass, count, ways = zip(*rows) if rows else [()] * 4
    return Buckets(np.array(key, np.uint64), np.maximum(np.array(mass, float), 1e-300), np.array(count, float), np.array(ways, float))


def _dealt(words: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """The places of the words that each part of the root's table holds, in order."""
    part = ((words >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, starts[1:])))


def _first_pass(bundled: DataFrame, plan: Plan, base: float, parts: int, burn_in: int) -> DataFrame:
    """(part, shard, words, tables): customers that shards send to the root, after a burn-in under the base alone."""
    finest = int(max(plan.ways.tolist(), default=1))
    buckets = bucket_table(plan, np.full(finest, 1 / finest))

    told = bundled.sparkSession.sparkContext.broadcast(plan)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number, shard = int(rows["shard"].iloc[0]), Shard(rows, told.value)
        tree = shard.tree(flat_root(len(shard.words), base), buckets.share(shard.groups))
        for _ in range(burn_in):
            tree.sweep()
        sent = np.bincount(tree.up_word, tree.t1, minlength=len(shard.words)).astype(np.int64)
        got = [(p, number, _pack(shard.words[m], np.uint64), _pack(sent[m], np.uint32)) for p, m in _dealt(shard.words, parts).items()]
        return pd.DataFrame(got, columns=["part", "shard", "words", "tables"])

    return bundled.groupBy("shard").applyInPandas(run, "part int, shard int, words binary, tables binary")


def _root_counts(sent: DataFrame, words: DataFrame) -> DataFrame:
    """(part, h, c, c0): unigram count and root customers of each word."""

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("h", ignore_index=True)
        h, total = known["h"].to_numpy(np.int64).view(np.uint64), np.zeros(len(known), np.int64)
        order = np.argsort(h)
        for w, t in zip(asked["words"], asked["tables"]):
            w, t = _unpack(w, np.uint64), _unpack(t, np.uint32)
            w, t = w[t > 0], t[t > 0]
            total[order[np.searchsorted(h[order], w)]] += t
        return known.assign(c0=total)[["part", "h", "c", "c0"]]

    return sent.groupBy("part").cogroup(words.groupBy("part")).applyInPandas(run, "part int, h long, c long, c0 long")


def _root_seated(counts: DataFrame, sweeps: int) -> tuple[DataFrame, int, int, float, float]:
    """(part, h, c, c0, t0) of the root's restaurant after some sweeps, its customers, tables, discount and base."""
    n, v, once, twice = counts.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.count("*"), F.count_if(F.col("c0") == 1), F.count_if(F.col("c0") == 2)).first()
    d, base = round(float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)), 3), 1 / (v + 1)
    placed, tables = counts.withColumn("t0", F.least("c0", F.lit(1))), v
    for k in range(sweeps):

        def run(parts: Iterator[pd.DataFrame], k: int = k, tables: int = tables) -> Iterator[pd.DataFrame]:
            for part in parts:
                c, t = part["c0"].to_numpy(np.int64), part["t0"].to_numpy(np.int64)
                live = np.flatnonzero(c > 1)
                p = always(np.full(len(live), base))
                t = t.copy()
                start = np.where(c[live] > EXACT, 0, t[live]) if k == 0 else t[live]
                t[live] = drawn(c[live], start, tables - t[live], d, p, mixed(part["h"].to_numpy(np.int64).view(np.uint64)[live]), k)
                yield part.assign(t0=t)

        placed = written(placed.mapInPandas(run, "part int, h long, c long, c0 long, t0 long"))
        tables = placed.agg(F.coalesce(F.sum("t0"), F.lit(0))).first()[0]
    return placed, int(n), int(tables), d, base


def _answers(sent: DataFrame, root: DataFrame) -> DataFrame:
    """(shard, part, c, c0, t0) of the words that each shard asked for, in its order; zeros for unknown ones."""

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        h = known["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, values = h[order], known[["c", "c0", "t0"]].to_numpy(np.int64)[order]
        out = []
        for shard, part, w in zip(asked["shard"], asked["part"], asked["words"]):
            w = _unpack(w, np.uint64)
            at = np.minimum(np.searchsorted(h, w), max(len(h) - 1, 0))
            got = np.where((h[at] == w)[:, None], values[at], 0) if len(h) else np.zeros((len(w), 3), np.int64)
            out.append((shard, part, *(_pack(got[:, k], np.uint64) for k in range(3))))
        return pd.DataFrame(out, columns=["shard", "part", "c", "c0", "t0"])

    return sent.groupBy("part").cogroup(root.groupBy("part")).applyInPandas(run, "shard int, part int, c binary, c0 binary, t0 binary")


def scored(docs: DataFrame, shard: int = SHARD, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """The digest of operator 5 of every row; documents with fold 0 of 10 are held out of training.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text counts as empty: one token, the end.
    Rows with a null doc_id are scored, but neither trained on nor held out. Repeated rows are counted and scored each.
    If nothing was learned, the one word known of is the unknown one, and the base scores are those of N = V = 0.
    Other columns of docs, whatever their names, take no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 10) != 0, F.lit(False)).alias("train"))
    words = written(word_counts(rows.where("train")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    plan, floor = planned(words, n, shard), n + SMOOTH * (v + 1)
    parts = plan.shards
    dealt = words.select(F.pmod(F.shiftrightunsigned("h", 8), F.lit(parts)).cast("int").alias("part"), "h", "c")
    sent = written(_first_pass(bundles(rows, plan, False), plan, 1 / (v + 1), parts, burn_in))
    root, customers, tables, d0, base = _root_seated(written(_root_counts(sent, dealt)), burn_in)
    finest = int(max(plan.ways.tolist(), default=1))
    mass = np.zeros(finest)
    if len(plan.hot):
        p0 = (F.greatest(F.col("c0") - d0 * F.col("t0"), F.lit(0.0)) + (STRENGTH + d0 * tables) * base) / (STRENGTH + customers)
        for r in root.groupBy(F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(finest - 1)).alias("b")).agg(F.sum(p0).alias("p")).collect():
            mass[r["b"]] = r["p"]
    buckets = bucket_table(plan, mass)

    held = docs.sparkSession.sparkContext.broadcast(plan)

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        named = rows[rows["names"].notna()]
        out = [(b, x, b"", b"", b"", b"", b"") for b, x in zip(named["batch"], named["names"])]
        mine = Shard(rows, held.value)
        if len(mine.key):
            c, c0, t0 = (np.zeros(len(mine.words), np.int64) for _ in range(3))
            places = _dealt(mine.words, parts)
            for p, *got in zip(told["part"], told["c"], told["c0"], told["t0"]):
                at = places[p]
                c[at], c0[at], t0[at] = (_unpack(x, np.uint64).view(np.int64) for x in got)
            above = Root(c0, t0, customers, tables, d0, base)
            p = mine.tree(above, buckets.share(mine.groups)).averaged(burn_in, samples)
            unknown = chance(0, 0, customers, tables, d0, base)
            hot, at = buckets.find(mine.contexts[mine.context])
            if len(hot):
                inside = np.bincount(mine.context, mine.count)[mine.context[hot]]
                told_bucket = (inside + 1) / (buckets.count[at] + buckets.ways[at])
                p[hot] = np.where(c[mine.word[hot]] > 0, (1 - unknown) * told_bucket * p[hot], unknown)
            logp, flat = np.log10(p), np.log10((c + SMOOTH) / floor)
            start = 0
            for batch, doc, size in zip(mine.rows["batch"], mine.docs, mine.lengths):
                pair = mine.pair[start : start + size]
                word = mine.word[pair]
                start += size
                sums = [np.bincount(doc, x) for x in (np.ones(size), c[word] == 0, flat[word], logp[pair])]
                i = np.flatnonzero(sums[0])
                out.append((batch, None, _pack(i, np.uint32), *(_pack(x[i], k) for x, k in zip(sums, (np.uint32, np.uint32, np.float64, np.float64)))))
        return pd.DataFrame(out, columns=["batch", "names", "i", "n", "unknown", "base", "score"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        """The sums of a batch's texts over shards."""
        names = next(x for x in rows["names"] if x is not None)
        rows = rows[rows["names"].isna()].sort_values("n")  # floating-point sums in an order that depends on contents alone
        sums = np.zeros((4, len(names)))
        for i, *values in zip(rows["i"], rows["n"], rows["unknown"], rows["base"], rows["score"]):
            for s, x, k in zip(sums, values, (np.uint32, np.uint32, np.float64, np.float64)):
                s[_unpack(i, np.uint32)] += _unpack(x, k)
        n, unknown = sums[:2].astype(np.int64)
        return pd.DataFrame({"doc_id": list(names), "n": n, "known": n - unknown, "base": sums[2], "score": sums[3]})

    each = bundles(rows, plan, True).groupBy("shard").cogroup(_answers(sent, root).groupBy("shard"))
    sums = each.applyInPandas(run, f"batch long, names array<{kind}>, i binary, n binary, unknown binary, base binary, score binary")
    return sums.groupBy("batch").applyInPandas(summed, f"doc_id {kind}, n long, known long, base double, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
