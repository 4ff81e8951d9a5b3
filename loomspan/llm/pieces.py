"""SentencePiece encoding and decoding by weighted finite-state transducers (operator 6).

A model file is compiled into machines, held as arrays: the normaliser (rewrites of the longest match, spaces to U+2581,
dummy prefix), the lexicon (a trie over characters whose final states put out pieces, with an arc to byte pieces for each
character in no piece) and, for BPE models, an acceptor of piece pairs. An input is composed with the lexicon by walking
the trie from all its places at once; the arcs found are the composed machine. Its shortest path in the tropical semiring
is taken place by place, for many inputs at once.

For unigram models an arc weighs minus the piece's score. Scores of a BPE model are merge priorities, not path weights: a
segmentation is the merge result exactly if each neighbouring pair of pieces is the merge result of its own concatenation,
so the acceptor's arcs weigh 0 for such pairs and infinity for others, and one path of finite weight is left. The acceptor
is compiled too: a pair is refused if, of the parts that the two pieces were merged from, two that met at the border would
have merged first.

Text is cut only where no piece can span (before a run of U+2581 and, if the vocabulary never joins them, between letters
and other characters); paths of short segments are remembered, so a corpus costs one composition for each distinct segment and worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import unused

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: What an unknown character costs a unigram path beyond the worst piece.
PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            byte = data[i]
            i += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class Table:
    """Arrays of 64-bit keys and their values, looked up many at once; -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            out[left] = np.where(there == keys[left], self.values[slot[left]], -1)
            left = left[(there != keys[left]) & (there != -1)]
        return out


class Normaliser:
    """The machine in front: rewrites of longest matches, then white space."""

    def __init__(self, spec: dict[int, int | bytes]):
        self.dummy, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.rules = self._rules(spec.get(2, b""))
        self.longest = max(map(len, self.rules), default=0)
        heads = "".join(sorted({re.escape(k[0]) for k in self.rules}))
        self.heads = re.compile(f"[{heads}]") if heads else None

    @staticmethod
    def _rules(data: bytes) -> dict[str, str]:
        """The rewrites of a compiled character map: a double-array trie over UTF-8 bytes, and the texts that its values point to."""
        if not data:
            return {}
        size = int.from_bytes(data[:4], "little")
        units, texts = np.frombuffer(data[4 : 4 + size], "<u4").tolist(), data[4 + size :]
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        rules, stack = {}, [(b"", offset(units[0]))]
        while stack:
            key, base = stack.pop()
            for c in range(1, 256):
                unit = units[base ^ c] if base ^ c < len(units) else 0
                if unit & 0x800000FF == c:
                    after = (base ^ c) ^ offset(unit)
                    if unit & 256:
                        start = units[after] & 0x7FFFFFFF
                        rules[key + bytes([c])] = texts[start : texts.index(b"\0", start)]
                    stack.append((key + bytes([c]), after))
        return {k.decode("utf-8", "surrogateescape"): v.decode("utf-8", "replace") for k, v in rules.items()}

    def _rewritten(self, text: str) -> Iterator[str]:
        at = 0
        while found := self.heads.search(text, at):
            start = found.start()
            yield text[at:start]
            size = next((n for n in range(min(self.longest, len(text) - start), 0, -1) if text[start : start + n] in self.rules), 0)
            yield self.rules[text[start : start + size]] if size else text[start]
            at = start + max(size, 1)
        yield text[at:]

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        if self.heads is not None and self.heads.search(text):
            text = "".join(self._rewritten(text))
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return ""
        text = " " * self.dummy + text
        return text.replace(" ", SPACE) if self.escape else text


class Pieces:
    """The compiled machines of one model file."""

    REMEMBERED = 48  # characters of the longest segment whose path is remembered
    ROOM = 150_000  # remembered segments, and pairs; beyond, memory is cleared
    TOGETHER = 1 << 20  # characters of the texts whose new segments are composed at once
    LONG = 400  # characters from which a segment is composed by itself

    def __init__(self, model: bytes):
        self.kind, norm, pieces = UNIGRAM, {}, []
        for field, value in _fields(model):
            if field == 1:
                got = dict(_fields(value))
                score = float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
        if self.kind not in (UNIGRAM, BPE) or any(kind == USER for _, _, kind in pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.normaliser = Normaliser(norm)
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unk = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.raw = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() if kind == NORMAL else b""
            for p, _, kind in pieces
        ]
        self.longest = max(map(len, self.id), default=1)
        self.cut = self._cuts()
        self.weight = np.array([s for _, s, _ in pieces], np.float32)
        self.lost = np.float32(min(self.score.values(), default=0.0) - PENALTY)
        # the acceptor's nodes: the pieces, and characters that are parts of pieces without being one
        self.names = [p for p, _, _ in pieces]
        self.node = {**{c: len(pieces) + k for k, c in enumerate(sorted({c for p in self.id for c in p} - set(self.id)))}, **self.id}
        self.parts: dict[str, tuple[str, str]] = {}
        good = self.id if self.kind == UNIGRAM else {p: i for p, i in self.id.items() if len(self._merged(p)) == 1}
        if self.kind == BPE:
            self._compile_acceptor(good)
        self._compile_lexicon(good)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.seen_keys, self.seen_ok = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)
        self.paths: dict[str, bytes] = {}

    def _cuts(self) -> re.Pattern | None:
        """Matches the segments of a text: no piece spans two of them."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            return None
        letter = re.compile(r"[^\W\d_]")
        inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(a != SPACE and bool(letter.match(a)) != bool(letter.match(b)) for a, b in inside):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[^\\W\\d_]+|{SPACE}*(?:(?!{SPACE})[\\W\\d_])+|{SPACE}+")

    def _merged(self, text: str) -> list[str]:
        """Merges of highest score, leftmost first; used on one or two pieces at a time. What a whole was merged from last is noted."""
        parts, get = list(text), self.score.get
        ranks = [get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) > -np.inf:
            k = ranks.index(best)
            if len(parts) == 2:
                self.parts[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], -np.inf)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], -np.inf)
        return parts

    def _compile_lexicon(self, good: dict[str, int]) -> None:
        """The trie's arcs as a table of state and character; of each state the piece that it puts out, or -1."""
        arcs: dict[int, int] = {}
        out = [-1]
        for piece, i in good.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                state = arcs.get(key, 0)
                if not state:
                    state = arcs[key] = len(out)
                    out.append(-1)
            out[state] = i
        self.roots = np.full(0x110000, -1, np.int32)
        for key, state in arcs.items():
            if key < 1 << 21:
                self.roots[key] = state
        self.arcs = Table(np.array(list(arcs.keys()), np.int64), np.array(list(arcs.values()), np.int64))
        self.out = np.array(out, np.int64)

    def _compile_acceptor(self, good: dict[str, int]) -> None:
        """Of each node its merge's rank and parts; the ranks of pairs that merge. Tangled are those merged no later than their parts."""
        order = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        n = len(self.names) + sum(i >= len(self.names) for i in self.node.values())
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for p, i in good.items():
            if len(p) > 1:
                a, b = (self.node[x] for x in self.parts[p])
                self.rank[i], self.left[i], self.right[i] = order[self.score[p]], a, b
        self.tangled = np.zeros(n, bool)
        for p, i in sorted(good.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                parts = [self.left[i], self.right[i]]
                self.tangled[i] = self.tangled[parts].any() or self.rank[i] <= self.rank[parts].max()
        keys, ranks = [], []
        for p in self.id:
            for k in range(1, len(p)):
                a, b = self.node.get(p[:k]), self.node.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    ranks.append(order[self.score[p]])
        self.joins = Table(np.array(keys, np.int64), np.array(ranks, np.int64))

    def _accepts(self, left: str, right: str) -> bool:
        """Whether right may follow left, by merging them."""
        if len(self.pairs) > self.ROOM:
            self.pairs.clear()
        got = self.pairs.get((left, right))
        if got is None:
            got = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return got

    def _judged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether right may follow left, for arrays of pieces: back in time, over the parts that met at the border."""
        tangled = self.tangled[left] | self.tangled[right]
        ok, which = np.ones(len(left), bool), np.flatnonzero(~tangled)
        for k in np.flatnonzero(tangled).tolist():
            ok[k] = self._accepts(self.names[left[k]], self.names[right[k]])
        a, b = left[which], right[which]
        until_a, until_b = np.full(len(a), 1 << 60), np.full(len(a), 1 << 60)
        while len(which):
            rank = self.joins.get(a << 24 | b)
            joined = (rank >= 0) & (rank < until_a) & (rank <= until_b)  # of equal ranks the left one merges first
            ok[which[joined]] = False
            later = self.rank[a] > self.rank[b]  # else b was made last, or neither was made
            until_a, until_b = np.where(later, self.rank[a], until_a), np.where(later, until_b, self.rank[b])
            live = ~joined & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            a, b = np.where(later, self.right[a], a)[live], np.where(later, b, self.left[b])[live]
            which, until_a, until_b = which[live], until_a[live], until_b[live]
        return ok

    def _accepted(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The acceptor's answers (all pieces may follow -1, a start or an unknown character), through a table of recent ones."""
        key = (before << 24) | piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        ok = (before < 0) | self.seen_ok[slot]
        new = np.flatnonzero((before >= 0) & (self.seen_keys[slot] != key))
        if len(new):
            ask, back = np.unique(key[new], return_inverse=True)
            told = self._judged(ask >> 24, ask & 0xFFFFFF)
            ok[new] = told[back]
            slot = (ask.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
            self.seen_keys[slot], self.seen_ok[slot] = ask, told
            lost = self.seen_keys[slot] != ask  # two new keys of one slot: the last one stays, with its own answer
            kept = np.flatnonzero(~lost)
            self.seen_ok[slot[kept]] = told[kept]
        return ok

    def _composed(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of the arcs over characters; left: how many characters the segment has from each on."""
        at = np.arange(len(codes))
        state = self.roots[codes].astype(np.int64)
        found, depth = [], 1
        while True:
            live = state >= 0
            at, state = at[live], state[live]
            if not len(at):
                break
            piece = self.out[state]
            ends = np.flatnonzero(piece >= 0)
            found.append((at[ends], np.full(len(ends), depth), piece[ends]))
            live = left[at] > depth
            at, state = at[live], state[live]
            state = self.arcs.get(state << 21 | codes[at + depth])
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at, at)

    def _paths(self, segs: list[str]) -> list[bytes]:
        """Ids on the shortest paths of many segments at once, place by place."""
        size = np.array(list(map(len, segs)))
        codes = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        offset = np.arange(len(codes)) - np.repeat(first, size)
        start, length, piece = self._composed(codes, np.repeat(size, size) - offset)
        end = start + length - 1  # a state is named by the character before it
        by = np.argsort((offset[end] << 44) | (end << 12) | (4095 - length))
        start, length, piece, end = start[by], length[by], piece[by], end[by]
        stops = np.searchsorted(offset[end], np.arange(int(size.max(initial=0)) + 1))
        last, step = np.full(len(codes) + 1, -1, np.int64), np.ones(len(codes) + 1, np.int64)
        cost = np.zeros(len(codes) + 1, np.float32)  # of unigram paths; the element at the end is that of starts
        places = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[places], np.arange(int(size.max(initial=0)) + 1))
        for j in range(int(size.max(initial=0))):
            a, b = stops[j], stops[j + 1]
            origin = np.where(length[a:b] == j + 1, len(codes), start[a:b] - 1)
            if self.kind == BPE:
                self._only_path(end[a:b], origin, piece[a:b], length[a:b], last, step)
            else:
                here = places[cuts[j] : cuts[j + 1]]
                self._best_path(here, end[a:b], origin, piece[a:b], length[a:b], last, step, cost, j)
        mark = np.zeros(len(codes), bool)
        rows, at = np.arange(len(segs)), first + size - 1
        while len(rows):
            mark[at] = True
            at = at - step[at]
            live = at >= first[rows]
            rows, at = rows[live], at[live]
        return self._told(codes, last, np.flatnonzero(mark), first, size)

    def _only_path(self, end, origin, piece, length, last, step) -> None:
        """The one arc of finite weight into each state, longest first; a character in no piece keeps -1."""
        at = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.empty(0, np.int64)
        while len(at):
            good = (length[at] == 1) | self._accepted(last[origin[at]], piece[at])
            mine = at[good]
            last[end[mine]], step[end[mine]] = piece[mine], length[mine]
            at = at[~good]
            after = at + 1
            at = after[(after < len(end)) & (end[np.minimum(after, len(end) - 1)] == end[at])]

    def _best_path(self, here, end, origin, piece, length, last, step, cost, j: int) -> None:
        """The arc of least weight into each state, the longest of equal ones; scores are added up as 32-bit numbers."""
        single = np.zeros(len(cost), bool)
        single[end[length == 1]] = True
        lone = here[~single[here]]
        before = np.full(len(lone), len(cost) - 1) if j == 0 else lone - 1
        end, length = np.r_[end, lone], np.r_[length, np.ones(len(lone), np.int64)]
        total = np.r_[cost[origin] + self.weight[piece], cost[before] + self.lost]
        piece = np.r_[piece, np.full(len(lone), -1)]
        by = np.lexsort((-length, -total, end))
        best = by[np.flatnonzero(np.r_[True, end[by][1:] != end[by][:-1]])] if len(by) else by
        last[end[best]], step[end[best]], cost[end[best]] = piece[best], length[best], total[best]

    def _told(self, codes, last, ends, first, size) -> list[bytes]:
        """The ids of each segment, from the last characters of its pieces; byte pieces for a character in none."""
        ids = last[ends]
        lost = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        ids = np.where(ids < 0, self.unk, ids)
        if len(lost) and self.byte_id:
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in codes[ends[lost]].tolist()]
            counts[lost] = list(map(len, spelt))
            ids = np.repeat(ids, counts)
            place = np.repeat(np.cumsum(counts)[lost] - counts[lost], counts[lost])
            within = np.concatenate([np.arange(len(x)) for x in spelt])
            ids[place + within] = [self.byte_id[b] for x in spelt for b in x]
        upto = np.r_[0, np.cumsum(counts)]
        a, b = upto[np.searchsorted(ends, first)] * 4, upto[np.searchsorted(ends, first + size)] * 4
        data = ids.astype("<i4").tobytes()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist())]

    def _long_path(self, seg: str) -> bytes:
        """The ids of a long segment, which is composed by itself, one place after the other."""
        if self.kind == UNIGRAM:
            return b"".join(self._paths([seg]))
        n, good = len(seg), self.parts
        last = [""] * (n + 1)
        for j in range(1, n + 1):
            last[j] = seg[j - 1]
            for k in range(min(j, self.longest), 1, -1):
                piece = seg[j - k : j]
                if piece in self.id and piece in good:
                    before = last[j - k]
                    if not before or before not in self.id or self._accepts(before, piece):
                        last[j] = piece
                        break
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        ids = []
        for p in reversed(out):
            if p in self.id:
                ids.append(self.id[p])
            else:
                ids += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]
        return np.array(ids, "<i4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text; none for a null or empty one."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(self.normaliser(text))
            size += len(held[-1])
            if size > self.TOGETHER:
                out += self._encoded(held)
                held, size = [], 0
        return out + self._encoded(held)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.cut.findall(t) if self.cut else [t] if t else [] for t in texts]
        if len(self.paths) > self.ROOM:
            self.paths.clear()
        paths = self.paths
        new = list({s for segs in lists for s in segs if s not in paths})
        once: dict[str, bytes] = {s: self._long_path(s) for s in new if len(s) >= self.LONG}
        short = [s for s in new if len(s) < self.LONG]
        for seg, path in zip(short, self._paths(short) if short else ()):
            (paths if len(seg) <= self.REMEMBERED else once)[seg] = path
        out = []
        for segs in lists:
            ids = np.frombuffer(b"".join([paths[s] if s in paths else once[s] for s in segs]), "<i4")
            if not self.byte_id and len(ids):  # neighbouring unknown characters are one piece
                ids = ids[np.r_[True, (ids[1:] != self.unk) | (ids[:-1] != self.unk)]]
            out.append(ids)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; U+2581 becomes a space, the dummy prefix goes, broken byte runs become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if (self.normaliser.dummy or self.normaliser.trim) and text.startswith(" ") else text


_COMPILED: dict[str, Pieces] = {}


def _compiled(name: str) -> Pieces:
    """The model that SparkFiles holds under this name, compiled once a worker."""
    if name not in _COMPILED:
        _COMPILED[name] = Pieces(Path(SparkFiles.get(name)).read_bytes())
    return _COMPILED[name]


def sent(spark: SparkSession, model_file: str) -> str:
    """Gives every executor the model file (under 10 MB); its name there."""
    if Path(model_file).stat().st_size > 10_000_000:
        raise ValueError(f"{model_file} is no model file of ordinary size")
    spark.sparkContext.addFile(model_file)
    return Path(model_file).name


def encoded(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs, all columns, and last the piece ids of a text column (empty for null and empty texts); texts are whole.

    If docs has a column named like `ids`, the new one gets an underscore more. Repeated rows are encoded alike.
    """
    name = sent(docs.sparkSession, model_file)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _compiled(name)
        for part in parts:
            yield pd.Series(model.encode_all(part.tolist()), dtype=object)

    return docs.withColumn(*unused(docs.columns, ids), run(F.col(text)))


def decoded(df: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df, all columns, and last the text of a column of piece ids (null for null); a clash of names as in encoded."""
    name = sent(df.sparkSession, model_file)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _compiled(name)
        for part in parts:
            yield pd.Series([None if x is None else model.decode(np.asarray(x)) for x in part], dtype=object)

    return df.withColumn(*unused(df.columns, text), run(F.col(ids)))


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, restored) of every row.

    ids_sha256 digests the ids, comma-joined; restored tells whether decoding gives the text again, U+2581 counting as a
    space and null as an empty text.
    """
    both = decoded(encoded(docs.select("doc_id", "text"), model_file), model_file)
    text = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == text).alias("restored"),
    )
