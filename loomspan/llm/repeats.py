"""Suffix-array dedup by depth-limited radix sort (operator 7).

Only repeated windows of a threshold length matter, so suffixes are ordered by their first `length` bytes and no further,
digit by digit from the most significant, and a suffix alone in its group is dropped at once. Equal groups after the last
digit are exactly the repeated windows.

The first digit is a gram: the one of least hash in a window, which depends on the window's content alone. Consecutive
windows share it, so a run of windows is one row (gram, run). Each further digit halves nothing but looks at more bytes: a
run is cut into pieces by distance from the gram, and a piece's digit is its core, the bytes that all windows of the piece
have in common. Pieces whose core is nowhere else are dropped. Pieces that are equal as a whole repeat as a whole: they are
reported and one of them goes on, for the others' sake. What is left is cut into smaller pieces, at last single windows.
So the many runs around a frequent passage are told apart by a few rows each, and no group is ever held in one place.

Equal texts repeat as a whole and enter once. Positions are bytes. Polynomial hashes only choose grams; what counts as equal is
decided by digests of the bytes themselves (16 bytes of BLAKE2).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import BROADCAST_BYTES, or_empty, sized, written

GRAM = 64
#: Windows of a piece, digit by digit; the first digit's pieces are whole runs.
PIECES = (64, 8, 1)
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), 1 << 20
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n + 1:
        m = max(n + 1, _STEP)
        _POWERS["up"] = np.cumprod(np.r_[np.uint64(1), np.full(m, _ODD)])
        _POWERS["down"] = np.cumprod(np.r_[np.uint64(1), np.full(m, _BACK)])
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any stretches of a byte string: polynomial prefix sums modulo 2^64 over random byte values.

    Different strings of one hash can be made, so they serve only to choose grams and to deal rows.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.r_[np.uint64(0), np.cumsum(_VALUES[data] * up[: len(data)])]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, *lie: np.ndarray) -> list[bytes]:
    """A digest of each stretch of data and of whole numbers that say how it lies."""
    view, step = memoryview(data.tobytes()), 8 * len(lie)
    lies = np.stack(lie, axis=1).astype("<i8").tobytes()
    out = []
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        h = hashlib.blake2b(lies[k * step : (k + 1) * step], digest_size=16)
        h.update(view[a:b])
        out.append(h.digest())
    return out


def runs(data: np.ndarray, length: int) -> tuple:
    """(gram, whole, place, low, high): windows starting at low..high have their least gram at place.

    whole digests the run's content and where it lies around the gram.
    """
    gram = min(GRAM, length)
    h, n = Hashes(data), len(data) - gram + 1
    at = np.arange(n)
    value = h(at, at + gram)
    best = least_places(value, length - gram + 1)
    low = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    high = np.r_[low[1:] - 1, len(best) - 1]
    place = best[low]
    whole = _digests(data, low, high + length, place - low, high - low)
    return value[place].view(np.int64), whole, place, low, high


def least_places(value: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the least of `width` consecutive values; the first one of equal ones."""
    best, span = np.arange(len(value)), 1
    while span * 2 <= width:
        best = _lesser(value, best, span)
        span *= 2
    return _lesser(value, best, width - span) if span < width else best


def _lesser(value: np.ndarray, best: np.ndarray, shift: int) -> np.ndarray:
    """For each start, the place of the lesser of two minima `shift` apart; the left one if equal."""
    a, b = best[: len(best) - shift], best[shift:]
    return np.where(value[b] < value[a], b, a)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)


def _pieces(part: pd.DataFrame, length: int, width: int) -> dict[str, object]:
    """The pieces of `width` windows of stretches (run, gram, place, low, high, data): columns of _SCHEMA.

    Piece q holds the windows that start from q width to (q + 1) width - 1 bytes before the gram. data starts at low.
    """
    data = [np.frombuffer(d, np.uint8) for d in part["data"]]
    sizes = np.array([len(d) for d in data])
    base = np.cumsum(sizes) - sizes
    place, low, high = (part[c].to_numpy(np.int64) for c in ("place", "low", "high"))
    first = (place - high) // width
    count = (place - low) // width - first + 1
    row = np.repeat(np.arange(len(data)), count)
    q = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = place[row] - q * width  # of the windows that the piece could have
    begin, end = np.maximum(last - width + 1, low[row]), np.minimum(last, high[row])
    gram = part["gram"].to_numpy(np.int64)[row]
    every, at = np.concatenate(data), base[row] - low[row]
    core = _digests(every, at + last, at + last - width + 1 + length, gram, q)
    whole = _digests(every, at + begin, at + end + length, gram, q, begin - last, end - begin)
    return {"core": core, "whole": whole, "text_id": part["text_id"].to_numpy()[row], "run": part["run"].to_numpy()[row], "gram": gram, "place": place[row], "low": begin, "high": end}


_SCHEMA = "core binary, whole binary, text_id binary, run int, gram long, place int, low int, high int"


def repeated(texts: DataFrame, length: int) -> DataFrame:
    """(text_id, low, high): starts of the windows of distinct texts (text_id binary, text) that occur again."""

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for i, text in zip(part["text_id"], part["text"]):
                data = _bytes(text)
                if len(data) >= length:
                    gram, whole, place, low, high = runs(data, length)
                    got.append(pd.DataFrame({"core": b"", "whole": whole, "text_id": i, "run": low, "gram": gram, "place": place, "low": low, "high": high}))
            if got:
                yield pd.concat(got)

    every = written(texts.mapInPandas(first, _SCHEMA))
    shared = written(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    rows = written(every.join(sized(shared), "gram").select(*every.columns))
    key, held, found = ["gram", "core"], None, None
    for width in sorted({min(w, max(length // 2, 1)) for w in PIECES}, reverse=True):
        going, entire = _divided(rows, key)
        found = entire if found is None else found.unionByName(entire)
        if held is None:

            def content(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    data = [_bytes(t)[a : b + length].tobytes() for t, a, b in zip(part["text"], part["low"], part["high"])]
                    yield part[["text_id", "run"]].assign(data=data, start=part["low"])

            runs_left = going.select("text_id", "run", "low", "high")
            # merged at every size: runs are about as many as texts
            held = written(texts.join(runs_left.hint("merge"), "text_id").select("text_id", "run", "low", "high", "text").mapInPandas(content, "text_id binary, run int, data binary, start int"))

        def cut(parts: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            for part in parts:
                for k in range(0, len(part), 2048):
                    piece = part.iloc[k : k + 2048].reset_index(drop=True)
                    piece["data"] = [d[a - s : b - s + length] for d, a, b, s in zip(piece["data"], piece["low"], piece["high"], piece["start"])]
                    yield pd.DataFrame(_pieces(piece, length, width))

        rows = written(going.join(held, ["text_id", "run"]).select("text_id", "run", "gram", "place", "low", "high", "data", "start").mapInPandas(cut, _SCHEMA))
        key = ["core"]
    return found.unionByName(_divided(rows, key)[1])


def _divided(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pieces that go on to the next digit, and the stretches (text_id, low, high) of those that repeat as a whole.

    Of pieces that are equal as a whole one goes on, and none if its digit's other pieces all repeat as a whole too.
    """
    fields = ["text_id", "run", "gram", "place", "low", "high"]
    kinds = rows.groupBy(*dict.fromkeys([*key, "whole"])).agg(F.count("*").alias("n"), F.min(F.struct(*[c for c in fields if c not in key])).alias("r"))
    kinds = written(kinds.select(*key, "whole", "n", "r.*"))
    twice = written(kinds.where("n > 1").select("gram", "whole"))
    entire = rows.join(sized(twice, 24), ["gram", "whole"], "left_semi").select("text_id", "low", "high")
    groups = kinds.groupBy(*key).agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("open"))
    groups = written(groups.where("kinds > 1 and open > 0").select(*key))
    return written(kinds.join(sized(groups, 24), key, "left_semi").select(*fields)), entire


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the removed byte spans (start, end exclusive) and the bytes left.

    A byte goes if it lies in a window of `length` bytes that also starts elsewhere, be it in the same text. Texts are
    judged as they come in; a null text counts as empty; repeated rows are copies of each other like any equal texts.
    """
    text = or_empty(F.col("text"))
    digest = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = docs.select("doc_id", text.alias("text"), digest.alias("text_id"))
    counts = rows.groupBy("text_id").agg(F.count("*").alias("copies"))
    copied = written(counts.where("copies > 1").select("text_id"))
    keyed = rows.select("text_id", "text")
    once = keyed.join(sized(copied, 16), "text_id", "left_anti").unionByName(
        keyed.join(sized(copied, 16), "text_id", "left_semi").dropDuplicates(["text_id"])
    )
    spans = repeated(once, length)
    spans = spans.groupBy("text_id").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("starts"))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of starts whose windows touch become one."""
        for part in parts:
            out = []
            for starts in part["starts"]:
                runs: list[dict[str, int]] = []
                for s in starts:
                    if runs and s["low"] <= runs[-1]["high"] + length:
                        runs[-1]["high"] = max(runs[-1]["high"], s["high"])
                    else:
                        runs.append({"low": s["low"], "high": s["high"]})
                out.append(runs)
            yield part[["text_id"]].assign(starts=out)

    spans = written(spans.mapInPandas(merge, spans.schema))
    few = spans.agg(F.sum(40 + 8 * F.size("starts"))).first()[0] or 0
    told = rows.join(F.broadcast(spans) if few <= BROADCAST_BYTES else spans, "text_id", "left")
    told = told.join(sized(copied.withColumn("copied", F.lit(True)), 16), "text_id", "left").select("doc_id", "text", "starts", F.coalesce("copied", F.lit(False)).alias("copied"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, starts, copied in zip(part["text"], part["starts"], part["copied"]):
                data = text.encode("utf-8", "surrogatepass")
                gone: list[list[int]] = []
                if copied and len(data) >= length:
                    gone = [[0, len(data)]]
                elif starts is not None:
                    for s in starts:
                        a, b = s["low"], s["high"] + length
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(b, gone[-1][1])
                        else:
                            gone.append([a, b])
                edges = [0, *[x for g in gone for x in g], len(data)]
                kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((len(data), [{"start": a, "end": b} for a, b in gone], kept))
            done = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
            done.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield done

    kind = docs.schema["doc_id"].dataType.simpleString()
    return told.mapInPandas(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept) of every row; kept is the text left.

    Bytes left of a character that was cut in two show as U+FFFD in kept; kept_sha256 and n_kept are of the bytes.
    """
    return without_repeats(docs, length).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"),
    )
