"""Substring dedup by relative Lempel-Ziv parsing (operator 11).

The corpus is its own reference. It is cut into blocks by content: every window of `length` words has an anchor, the gram of
least hash in it, and a block holds what lies around one anchor's occurrences. Equal windows have equal anchors, so a document
meets all of the reference that can hold a long factor of it, and no more.

1. A run of windows that share an anchor is one row. Anchors that occur once can't repeat and go.
2. Runs that are equal as a whole enter a block once, by their first occurrence; the others are duplicate spans.
3. Tasks take blocks of runs in corpus order, index all of their suffixes (prefix doubling on exact word numbers), and factor
   each run greedily: the longest match with what came before is the next factor. Windows inside a factor are duplicates.
   A window that repeats but lies across two factors is looked up in the index at the factor boundary.

Blocks are of bounded size. What lies around a hot anchor, one with more runs than that, is told apart window by window with
a grouped minimum, which no key can overload. Digests (12 bytes of BLAKE2) stand for whole runs and windows of hot anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import dropped, or_empty, sized, written
from loomspan.llm.repeats import least_places

#: Words of an anchor.
GRAM = 8
#: Runs of an anchor up to which its block is factored in one task.
BLOCK = 4096
#: Bytes of text that are cut into words at once, and words of the blocks that are indexed at once.
TEXT_BYTES, INDEX_WORDS = 4_000_000, 150_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=12).digest()


def _grams(words: list[bytes], size: int) -> np.ndarray:
    """A hash of the `size` words from each place on; it only chooses anchors and deals them to tasks."""
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(kinds, categorize=False)[codes]
    n = len(h) - size + 1
    out = h[:n].copy()
    for j in range(1, size):
        out = out * _ODD + h[j : j + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def runs(texts: list[list[bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(text, gram, low, n): the n windows of a text from word low on share an anchor, and the next doesn't."""
    size = min(GRAM, length)
    ends = np.cumsum([len(t) for t in texts])
    words = [w for t in texts for w in t]
    if len(words) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    value = _grams(words, size)
    best = least_places(value, length - size + 1)
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(best)]
    whole = np.arange(len(best)) + length <= ends[text]  # windows within one text
    fresh = whole & np.r_[True, (best[1:] != best[:-1]) | ~whole[:-1]]
    low = np.flatnonzero(fresh)
    upto = np.cumsum(whole)
    n = upto[np.r_[low[1:], len(best)] - 1] - upto[low] + 1
    first = ends - np.diff(ends, prepend=0)
    return text[low], value[best[low]].view(np.int64), low - first[text[low]], n


def _portions(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows whose texts have few bytes together, or one row."""
    size = np.cumsum([len(t) for t in part["text"]])
    yield from (rows for _, rows in part.groupby(size // TEXT_BYTES))


def previous_factors(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest match of what follows with what follows an earlier place.

    Suffixes are ranked by prefix doubling; the best earlier match of a suffix is one of its two nearest neighbours in
    suffix order that begin earlier. Symbols are whole numbers; one that occurs once ends every match.
    """
    n, span = len(symbols), 1
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max(initial=0) < n - 1:
        last = ranks[-1]
        ahead = np.r_[last[span:], np.full(min(span, n), -1)]
        ranks.append(np.unique(last * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64))
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    best = np.zeros(n, np.int64)
    for way in (1, -1):
        line = order[::way]
        at, todo = np.arange(n) - 1, np.arange(1, n)  # the nearest entry before that begins earlier, by jumps over those that begin later
        while len(todo := todo[(at[todo] >= 0) & (line[at[todo]] > line[todo])]):
            at[todo] = at[at[todo]]
        here, there = line[at >= 0], line[at[at >= 0]]
        same = np.zeros(len(here), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            a, b = here + same, there + same
            fits = np.flatnonzero((a < n) & (b < n))
            same[fits[ranks[j][a[fits]] == ranks[j][b[fits]]]] += 1 << j
        best[here] = np.maximum(best[here], same)
    return best


def factored(texts: list[list[bytes]], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows of `length` words that also start earlier in a text of their group; texts are in order."""
    sizes = np.array([len(t) + 1 for t in texts])
    codes, kinds = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    begin = np.cumsum(sizes) - sizes
    symbols = np.empty(sizes.sum(), np.int64)
    ends = begin + sizes - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = codes
    symbols[ends] = len(kinds) + np.arange(len(texts))  # each text ends in a sign of its own
    text = np.repeat(np.arange(len(texts)), sizes)
    longest = previous_factors(groups[text] * (len(kinds) + len(texts)) + symbols)
    at, found = begin.copy(), []
    before = begin.copy()  # where the factor before began; all texts take a step at a time
    live = np.flatnonzero(at < ends)
    while len(live):
        start, size = at[live], np.maximum(longest[at[live]], 1)
        long = size >= length
        found.append(_each(start[long], start[long] + size[long] - length))
        # windows across the boundary of two factors
        low, high = np.maximum(before[live] + 1, start - length + 1), np.minimum(start - 1, start + size - length)
        across = _each(low, high)
        found.append(across[longest[across] >= length])
        before[live], at[live] = start, start + size
        live = live[at[live] < ends[live]]
    starts = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return text[starts], starts - begin[text[starts]]


def _each(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges low..high, those with high < low being empty."""
    n = np.maximum(high - low + 1, 0)
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _stretches(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of consecutive starts."""
    fresh = np.r_[True, (np.diff(start) != 1) | (np.diff(text) != 0)][: len(start)]
    first = np.flatnonzero(fresh)
    return text[first], start[first], start[np.r_[first[1:], len(start)] - 1] if len(start) else start


_PLACE, _KEY = ["doc", "tie", "low"], "doc long, tie long"


#: Stands for a missing id, so that tasks see whole numbers only.
_LAST = 2**63 - 1


def duplicates(texts: DataFrame, length: int) -> DataFrame:
    """(doc, tie, low, high): starts of the windows of texts (doc, tie, text) that also start earlier in the corpus."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows in _portions(part):
                words = [_words(t) for t in rows["text"]]
                text, gram, low, n = runs(words, length)
                whole = [_digest(words[t][a : a + m + length - 1]) for t, a, m in zip(text.tolist(), low.tolist(), n.tolist())]
                yield pd.DataFrame({"doc": rows["doc"].to_numpy()[text], "tie": rows["tie"].to_numpy()[text], "gram": gram, "whole": whole, "low": low, "n": n})

    every = written(texts.mapInPandas(cut, f"{_KEY}, gram long, whole binary, low int, n int"))
    shared = written(every.groupBy("gram").agg(F.count("*").alias("runs")).where("runs > 1"))
    rows = written(_of_anchors(every, shared, "runs").drop("runs"))
    dropped(every)
    kinds = rows.groupBy("whole").agg(F.count("*").alias("c"), F.first("gram").alias("gram"), F.min(F.struct(*_PLACE, "n")).alias("at"))
    kinds = written(kinds.select("whole", "c", "gram", *[F.col(f"at.{c}").alias(c) for c in (*_PLACE, "n")]))
    twice = written(kinds.where("c > 1").select("whole", F.struct(*_PLACE).alias("at")))
    # merged at every size, as texts are below: such tables grow with the corpus
    found = rows.join(twice.hint("merge"), "whole").where(F.struct(*_PLACE) != F.col("at")).select("doc", "tie", "low", (F.col("low") + F.col("n") - 1).alias("high"))
    blocks = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    going = written(_of_anchors(kinds, blocks, "kinds").select("doc", "tie", "gram", "low", "n", (F.col("kinds") > BLOCK).alias("hot")))
    found = found.unionByName(_parsed(texts, going.where("not hot"), length))
    if not (hot := going.where("hot")).isEmpty():
        found = found.unionByName(_told_apart(texts, hot, length))
    return found


def _of_anchors(rows: DataFrame, anchors: DataFrame, count: str) -> DataFrame:
    """rows of the anchors (gram, count; written), with the count.

    Hot anchors are few and meet their rows where these lie, so no task gets all of one; the others are merged at every size.
    """
    hot = anchors.where(F.col(count) > BLOCK)
    if hot.isEmpty():
        return rows.join(anchors.hint("merge"), "gram")
    few = sized(hot, 16)
    cold = rows.join(few.select("gram"), "gram", "left_anti").join(anchors.where(F.col(count) <= BLOCK).hint("merge"), "gram")
    return cold.unionByName(rows.join(few, "gram"))


def _with_text(texts: DataFrame, going: DataFrame) -> DataFrame:
    """(doc, tie, text, runs): the texts that have runs left, each with them."""
    lists = going.groupBy("doc", "tie").agg(F.collect_list(F.struct("gram", "low", "n")).alias("runs"))
    return texts.join(lists.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "runs")


def _parsed(texts: DataFrame, going: DataFrame, length: int) -> DataFrame:
    """duplicates' rows inside blocks, by factors."""

    def content(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows in _portions(part):
                out = []
                for doc, tie, text, left in zip(rows["doc"], rows["tie"], rows["text"], rows["runs"]):
                    words = _words(text)
                    out += [(doc, tie, r["gram"], r["low"], b" ".join(words[r["low"] : r["low"] + r["n"] + length - 1])) for r in left]
                yield pd.DataFrame(out, columns=["doc", "tie", "gram", "low", "words"])

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come one after the other; many small ones are indexed together."""

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            groups = np.cumsum(np.r_[0, np.diff(rows["gram"].to_numpy()) != 0])
            text, first, last = _stretches(*factored([w.split(b" ") for w in rows["words"]], groups, length))
            rows = rows.iloc[text]
            return rows[["doc", "tie"]].assign(low=rows["low"].to_numpy() + first, high=rows["low"].to_numpy() + last)

        held: list[pd.DataFrame] = []
        size = 0
        for part in parts:
            held.append(part)
            size += sum(map(len, part["words"])) // 6
            if size > INDEX_WORDS:
                rows = pd.concat(held, ignore_index=True)
                last = rows["gram"].to_numpy()
                k = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0  # the last block may go on
                if k:
                    yield done(rows.iloc[:k])
                    held, size = [rows.iloc[k:]], 0
        if held and sum(map(len, held)):
            yield done(pd.concat(held, ignore_index=True))

    pieces = _with_text(texts, going).mapInPandas(content, f"{_KEY}, gram long, low int, words binary")
    order = pieces.repartition("gram").sortWithinPartitions("gram", *_PLACE)
    return order.mapInPandas(parse, f"{_KEY}, low int, high int")


def _told_apart(texts: DataFrame, going: DataFrame, length: int) -> DataFrame:
    """duplicates' rows around hot anchors: every window is a row, and a grouped minimum finds the first of equal ones."""

    def content(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows in _portions(part):
                out = []
                for doc, tie, text, left in zip(rows["doc"], rows["tie"], rows["text"], rows["runs"]):
                    words = _words(text)
                    out += [(doc, tie, a, _digest(words[a : a + length])) for r in left for a in range(r["low"], r["low"] + r["n"])]
                yield pd.DataFrame(out, columns=["doc", "tie", "low", "whole"])

    windows = written(_with_text(texts, going).mapInPandas(content, f"{_KEY}, low int, whole binary"))
    firsts = written(windows.groupBy("whole").agg(F.count("*").alias("c"), F.min(F.struct(*_PLACE)).alias("at")).where("c > 1").select("whole", "at"))
    again = windows.join(sized(firsts, 64), "whole").where(F.struct(*_PLACE) != F.col("at"))
    return again.select("doc", "tie", "low", F.col("low").alias("high"))


def without_duplicates(docs: DataFrame, length: int = 20, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, spans, kept) of every row: word spans (start, end exclusive) that go, and the words left, joined by spaces.

    A word goes if it lies in a window of `length` words that also starts earlier: in a document of smaller id or before in
    its own. Ids are whole numbers; rows without id count as having the largest. Documents of equal id and other text are
    ordered by a hash of the text, and rows of equal id and text are one document. Null and empty texts have no words.
    """
    content = or_empty(F.col(text))
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(id).isNull().alias("nameless"), content.alias("text"), F.sha2(content, 256).alias("digest"))
    tied = rows.count() != rows.select("doc").distinct().count()
    rows = rows.withColumn("tie", F.xxhash64("digest") if tied else F.lit(0).cast("long"))
    place = F.struct("doc", "tie")
    copies = rows.groupBy("digest").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    copies = written(copies.select(F.unhex("digest").alias("hash"), "first"))
    few = sized(copies, 64)
    rows = rows.withColumn("hash", F.unhex("digest")).join(few, "hash", "left")
    rows = rows.select("doc", "tie", "nameless", "text", F.coalesce(F.col("first") != place, F.lit(False)).alias("copy"))
    if few is copies:
        rows = written(rows)  # many groups of copies: texts are shuffled for them once
    texts = rows.where("not copy").select("doc", "tie", "text")
    if tied:
        texts = texts.dropDuplicates(["doc", "tie"])
    spans = duplicates(texts, length).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("starts"))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["doc", "tie"]].assign(spans=[_merged(s, length) for s in part["starts"]])

    spans = written(spans.mapInPandas(merge, f"{_KEY}, spans array<int>"))
    told = rows.join(spans.hint("merge"), ["doc", "tie"], "left").select("doc", "nameless", "text", "copy", "spans")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, copy, spans in zip(part["text"], part["copy"], part["spans"]):
                words = _words(text)
                gone = [0, len(words)] if copy and len(words) >= length else [] if spans is None else list(spans)
                edges = [0, *gone, len(words)]
                kept = b" ".join([w for k in range(0, len(edges), 2) for w in words[edges[k] : edges[k + 1]]])
                out.append((len(words), [{"start": a, "end": b} for a, b in zip(gone[::2], gone[1::2])], kept.decode("utf-8", "surrogatepass")))
            done = pd.DataFrame(out, columns=["n_words", "spans", "kept"])
            yield done.assign(doc=part["doc"].to_numpy(), nameless=part["nameless"].to_numpy())

    out = told.mapInPandas(cut, "n_words long, spans array<struct<start: int, end: int>>, kept string, doc long, nameless boolean")
    return out.select(F.when(~F.col("nameless"), F.col("doc")).alias(id), "n_words", "spans", "kept")


def _merged(starts: list, length: int) -> list[int]:
    """Borders of the words that windows with these starts cover."""
    out: list[int] = []
    for low, high in sorted((s["low"], s["high"]) for s in starts):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high + length)
        else:
            out += [low, high + length]
    return out


def digest(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_duplicates(docs, length).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "kept")
