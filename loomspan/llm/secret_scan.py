"""Secret scans (operator 2), with DataFrame functions only.

Base spans come from three patterns. The method adds spans: runs of key characters are scored by two first-order character
Markov models, one of random strings and one of ordinary identifiers, and are reported if the log-likelihood ratio is
large, in all and per character. Both are trained from labelled samples of the corpus itself: what the base patterns found
(random) and other long runs (ordinary), from all documents; their tables are bounded by the squared size of the alphabet.

Spark has no function for match offsets. A text's pieces between matches and the matches themselves have lengths, whose
running sums are the offsets (code points, end exclusive).
"""

from __future__ import annotations

import math
from collections import Counter
from random import Random
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import or_empty, unused, written

KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
RUN = "[A-Za-z0-9+/_=-]{16,}"
ORDINARY = "[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
KINDS = ("assign", "access", "hex", "model")
LEAST_VALUE = 8
MASK = "[SECRET]"
#: Log-likelihood ratio, in nats, from which a run is taken for random.
RATIO = 12.0
#: Share of the prior in the ordinary model, and its chances of the next class (lower case, upper case, digit, sign) after each.
PRIOR = 0.2
TURNS = ((0.85, 0.03, 0.03, 0.09), (0.03, 0.85, 0.03, 0.09), (0.03, 0.03, 0.85, 0.09), (0.4, 0.15, 0.35, 0.1))
#: What a pair weighs in the model of small letters if it isn't two of them.
OTHER = -50.0
#: Steps of the average ratio, and how many misses a false alarm weighs, when its bound is set.
STEP, ALARM = 0.05, 10
_CHUNK = 64


def _sums(a: Column) -> Column:
    """Running sums of an array of ints; in two levels, so that long arrays are not copied once an element."""
    parts = F.sequence(F.lit(0), F.ceil(F.size(a) / _CHUNK).cast("int") - 1)
    cut = lambda c: F.slice(a, c * _CHUNK + 1, F.lit(_CHUNK))
    add = lambda s, x: s + x

    def grow(values: Column, first: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        return F.aggregate(values, F.array(first), step)

    firsts = grow(F.transform(parts, lambda c: F.aggregate(cut(c), F.lit(0), add)), F.lit(0))
    inner = F.transform(parts, lambda c: F.slice(grow(cut(c), F.get(firsts, c)), F.lit(2), F.lit(_CHUNK)))
    return F.when(F.size(a) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def _matches(df: DataFrame, text: str, kind: str, pattern: str, good) -> DataFrame:
    """Adds of one kind: its pieces, matches, which of them are good, and (as <kind>_starts) where they start."""
    t, p, m, g = F.col(text), f"{kind}_pieces", f"{kind}_matches", f"{kind}_good"
    none, here = F.array().cast("array<string>"), F.col(text).rlike(pattern)
    df = df.withColumn(f"{kind}_any", here)
    here = F.col(f"{kind}_any")
    df = df.withColumn(m, F.when(here, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(p, F.when(here, F.split(t, pattern, -1)).otherwise(none))
    df = df.withColumn(g, F.when(here, good(F.col(m))).otherwise(F.array().cast("array<boolean>")))
    steps = F.transform(F.col(m), lambda x, i: F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
    df = df.withColumn(f"{kind}_steps", F.when(here, steps).otherwise(F.array().cast("array<int>")))
    return df.withColumn(f"{kind}_starts", F.when(here, _sums(F.col(f"{kind}_steps"))).otherwise(F.array().cast("array<int>")))


def _spans(kind: str) -> Column:
    """Array of (start, kind number, end) of a kind's good matches."""
    m, s = F.col(f"{kind}_matches"), f"{kind}_starts"
    make = lambda x, i: F.struct(F.get(s, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(s, i) + F.length(x)).alias("end"), F.get(f"{kind}_good", i).alias("good"))
    return F.filter(F.transform(m, make), lambda x: x["good"])


def _all_good(m: Column) -> Column:
    return F.transform(m, lambda x: F.lit(True))


def _long_value(m: Column) -> Column:
    """Whether the value, what follows the keyword and sign, is long enough."""
    return F.transform(m, lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= LEAST_VALUE)


BASE = {"assign": (ASSIGN, _long_value), "access": (ACCESS, _all_good), "hex": (HEX, _all_good)}


class Model(NamedTuple):
    """Log-likelihood ratio of each pair of ALPHABET characters, random to ordinary; and the least ratio of a pair, on average.

    Of random strings there are two models, and the better one counts: of any characters, and of small letters alone.
    """

    tables: tuple[list[float], list[float]]
    least: float


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _ordinary(seen: dict[str, int]) -> dict[str, float]:
    """Chance of each pair's second character after its first, from counts of pairs in ordinary identifiers.

    The next class of character, then the character: a letter after a letter by case-folded pairs. Both are mixed with
    fixed shares of a prior, so what the sample lacks (digits, say) costs the same at every size of it.
    """
    turns, letters = [[0] * 4 for _ in range(4)], Counter()
    for pair, n in seen.items():
        turns[_class(pair[0])][_class(pair[1])] += n
        if pair.isalpha():
            letters[pair.lower()] += n
    sizes, low = Counter(map(_class, ALPHABET)), ALPHABET[:26]
    turn = [[p if not sum(row) else (1 - PRIOR) * n / sum(row) + PRIOR * p for n, p in zip(row, prior)] for row, prior in zip(turns, TURNS)]
    after = {a: sum(letters[a + b] for b in low) for a in low}

    def within(a: str, b: str) -> float:
        if (a + b).isalpha() and after[a.lower()]:
            return (1 - PRIOR / 2) * letters[(a + b).lower()] / after[a.lower()] + PRIOR / 2 / 26
        return 1 / sizes[_class(b)]

    return {a + b: turn[_class(a)][_class(b)] * within(a, b) for a in ALPHABET for b in ALPHABET}


def _tables(random: dict[str, int], ordinary: dict[str, int]) -> tuple[list[float], list[float]]:
    size = len(ALPHABET)
    after = {a: sum(random.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    into = {b: sum(random.get(a + b, 0) for a in ALPHABET) + 1 for b in ALPHABET}
    total, chance = sum(into.values()), _ordinary(ordinary)

    def of_random(a: str, b: str) -> float:
        return (random.get(a + b, 0) + size * into[b] / total) / (after[a] + size)

    # half of the random model's weight is uniform: samples of a few formats must not make others look ordinary
    pairs = [(a, b) for a in ALPHABET for b in ALPHABET]
    any_sign = [math.log((of_random(a, b) + 1 / size) / 2) - math.log(chance[a + b]) for a, b in pairs]
    return any_sign, [math.log(1 / 26) - math.log(chance[a + b]) if (a + b).islower() and (a + b).isalpha() else OTHER for a, b in pairs]


def _keys() -> list[str]:
    """Random strings of common key formats."""
    rng = Random(2)
    low, up, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    return ["".join(rng.choices(a, k=rng.randint(16, 40))) for a in (low + up + digits + "+/", low + up + digits, low + digits, up + digits, digits + low[:6], low + up, low) for _ in range(200)]


def _least(tables: tuple[list[float], list[float]], held: dict[int, int]) -> float:
    """The average ratio that best parts held-out ordinary runs (a false alarm weighs ALARM misses) from random strings that RATIO lets pass.

    `held` counts runs by their average ratio in steps of STEP; of equally good bounds the middle one is taken.
    """
    score = lambda run: max(sum(t[ALPHABET.index(a) * len(ALPHABET) + ALPHABET.index(b)] for a, b in zip(run, run[1:])) for t in tables)
    found = [(score(k), len(k) - 1) for k in _keys()]
    keys, n = Counter(math.floor(s / k / STEP) for s, k in found if s >= RATIO), max(sum(held.values()), 1)
    cost = {}
    for t in range(min([*keys, *held], default=0), max([*keys, *held], default=0) + 2):
        missed, alarms = sum(c for x, c in keys.items() if x < t), sum(c for x, c in held.items() if x >= t)
        cost[t] = missed / max(keys.total(), 1) + ALARM * alarms / n
    best = [t for t, c in cost.items() if c == min(cost.values())]
    return (best[0] + best[-1]) / 2 * STEP


def trained(docs: DataFrame) -> Model:
    """The two models' ratios, with the bound set on a fifth of the distinct ordinary runs, which are held out.

    Ordinary are, outside base spans, runs of digits or without them, and those with both that several documents hold.
    """
    t = F.col("text")
    value = lambda pattern, group: F.when(t.rlike(pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)))
    random = F.filter(F.coalesce(value(ASSIGN, 1), F.array().cast("array<string>")), lambda x: F.length(x) >= LEAST_VALUE)
    random = F.concat(random, *[F.coalesce(value(p, 0), F.array().cast("array<string>")) for p in (ACCESS, HEX)])
    rest = t
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.when(t.rlike(pattern), F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    there, doc = docs.where(t.isNotNull()), F.col("doc_id").cast("string").alias("doc")
    keys = there.select(F.explode(random).alias("run")).groupBy("run").agg(F.count("*").alias("c")).select(F.lit(1).alias("label"), "run", "c")
    plain = there.select(doc, F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("run"))
    plain = plain.groupBy("run").agg(F.count("*").alias("c"), (F.min("doc") < F.max("doc")).alias("several"))
    both = F.col("run").rlike("[0-9]") & F.col("run").rlike("[A-Za-z]")
    held = F.pmod(F.xxhash64("run"), F.lit(5)) == 0
    plain = plain.where(~both | F.coalesce("several", F.lit(False))).select(F.when(held, -1).otherwise(0).alias("label"), "run", "c")
    runs = written(keys.unionAll(plain).where(F.length("run") > 1))
    at = runs.where("label >= 0").select("label", "run", "c", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i"))
    rows = at.groupBy("label", F.substring("run", F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("c").alias("n")).collect()
    tables = _tables(*({r["pair"]: r["n"] for r in rows if r["label"] == k} for k in (1, 0)))
    average = F.floor(_ratio(F.col("run"), tables) / (F.length("run") - 1) / STEP)
    bins = runs.where("label < 0").groupBy(average.alias("bin")).count().collect()
    return Model(tables, _least(tables, {r["bin"]: r["count"] for r in bins}))


def _ratio(run: Column, tables: tuple[list[float], list[float]]) -> Column:
    """Log-likelihood ratio of a run of two or more characters, to the better of the two models of random strings."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i, F.lit(1))) - 1

    def of(table: list[float]) -> Column:
        values = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
        step = lambda acc, i: acc + F.coalesce(F.get(values, place(i) * len(ALPHABET) + place(i + 1)), F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(1), F.length(run) - 1), F.lit(0.0), step)

    return F.greatest(of(tables[0]), F.when(run.rlike("^[a-z]+$"), of(tables[1])))


def _random(model: Model):
    bound = lambda x: F.greatest(F.lit(RATIO), F.lit(model.least) * (F.length(x) - 1))
    return lambda m: F.transform(m, lambda x: _ratio(x, model.tables) >= bound(x))


#: Spans that are looked through together.
BLOCK = 128


def _apart(spans: str, others: str) -> Column:
    """The spans that overlap none of the others, which are ordered by start.

    The others are taken in blocks with their furthest reach, so a span is held against blocks, and against single spans
    only in blocks that it touches. The blocks are bound to a name, for else they were built anew for every span.
    """
    n = F.size(others)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def block(k: Column) -> Column:
        part = F.slice(others, k * BLOCK + 1, F.lit(BLOCK))
        return F.struct(part.alias("part"), part[0]["start"].alias("low"), F.array_max(F.transform(part, lambda y: y["end"])).alias("high"))

    meets = lambda x, low, high: (low < x["end"]) & (x["start"] < high)
    hit = lambda blocks, x: F.exists(blocks, lambda b: meets(x, b["low"], b["high"]) & F.exists(b["part"], lambda y: meets(x, y["start"], y["end"])))
    return F.flatten(F.transform(F.array(F.transform(numbers, block)), lambda blocks: F.filter(spans, lambda x: ~hit(blocks, x))))


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, the base spans' counts and all spans of every row of docs.

    spans is an array of (start, kind, end), ordered by start, then kind (as in KINDS). A null text counts as empty. A run
    that overlaps a base span is not reported again. Ties and repeated rows are scanned each for itself.
    """
    model = trained(docs) if model is None else model
    df = docs.select("doc_id", or_empty(F.col("text")).alias("text"))
    for kind, (pattern, good) in BASE.items():
        df = _matches(df, "text", kind, pattern, good)
    df = _matches(df, "text", "model", RUN, _random(model))
    df = df.select("doc_id", *[_spans(k).alias(k) for k in KINDS])
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = _apart("model", "base")
    df = df.withColumn("spans", F.when(F.size("model") > 0, F.array_sort(F.concat("base", free))).otherwise(F.col("base")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, "base", "spans")


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) of every row."""
    found = scanned(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns and rows, with every secret in text replaced by MASK and n_chars (if there) counted anew.

    A null text stays null and an empty one empty; repeated rows are masked each for itself; other columns are kept as they
    are, whatever their names.
    """
    model = trained(docs) if model is None else model
    now, found, parts, good_ones = unused(docs.columns, "secret_text", "secret_found", "secret_parts", "secret_good")
    df, names = docs.withColumn(now, F.col("text")), docs.columns
    for pattern, good in [*BASE.values(), (RUN, _random(model))]:
        df = df.withColumn(found, F.when(F.col(now).rlike(pattern), F.regexp_extract_all(now, F.lit(pattern), F.lit(0))))
        df = df.withColumn(parts, F.when(F.col(found).isNotNull(), F.split(now, pattern, -1))).withColumn(good_ones, F.when(F.col(found).isNotNull(), good(F.col(found))))
        told = F.transform(F.col(parts), lambda x, i: F.concat(x, F.when(F.coalesce(F.get(good_ones, i), F.lit(False)), F.lit(MASK)).otherwise(F.coalesce(F.get(found, i), F.lit("")))))
        df = df.withColumn(now, F.when(F.col(found).isNotNull(), F.array_join(told, "")).otherwise(F.col(now))).drop(found, parts, good_ones)
    df = df.withColumn("text", F.col(now))
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*names)
