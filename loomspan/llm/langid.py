"""Language ID with hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1. A trigram binds its three letters' vectors, permuted by place, by
elementwise product; a text bundles (sums) the vectors of its trigrams; a language's prototype bundles its training texts.
A text gets the language whose prototype has the largest cosine with the text's bundle.

Sums stay exact integers, so the result doesn't depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import unused

DIMS, SYMBOLS = 1024, 64
UNKNOWN = "und"
#: Texts are bundled in blocks of so many characters and documents; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 1 << 20, 256


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (0: not a letter) and the three permuted vectors of each symbol."""
    points = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            points[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    base = np.random.default_rng(4).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMS))
    return points, np.stack([np.roll(base, k, axis=1) for k in (2, 1, 0)])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t) > BLOCK_CHARS or i - start >= BLOCK_DOCS):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if len(texts) > start:
        yield start, len(texts)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each trigram: its text's index and its code; and whether each text has a letter."""
    points, _ = _letters()
    padded = [f" {t.lower()} " for t in texts]
    sym = points[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    has = np.bincount(doc[sym > 0], minlength=len(texts)) > 0
    keep = (sym > 0) | np.r_[True, (sym[:-1] > 0) | (doc[1:] != doc[:-1])]
    sym, doc = sym[keep].astype(np.int32), doc[keep]
    same = doc[2:] == doc[:-2]
    return doc[2:][same], ((sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:])[same], has


def _bundles(group: np.ndarray, tri: np.ndarray, groups: int) -> np.ndarray:
    """The bundled trigram vectors of each group."""
    _, vec = _letters()
    there = np.bincount(tri, minlength=SYMBOLS**3) > 0
    used = np.flatnonzero(there)
    place = np.cumsum(there) - 1
    counts = np.bincount(group * len(used) + place[tri], minlength=groups * len(used)).reshape(groups, -1)
    bound = vec[0][used // SYMBOLS**2] * vec[1][used // SYMBOLS % SYMBOLS] * vec[2][used % SYMBOLS]
    return counts.astype(np.float32) @ bound


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each non-null lang of (text, lang). Tasks pre-add their rows; languages x DIMS sums are collected."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            names, lang = np.unique(part["lang"].to_numpy(str), return_inverse=True)
            texts = part["text"].tolist()
            for a, b in _blocks(texts):
                doc, tri, _ = _trigrams(texts[a:b])
                if len(tri):
                    for name, v in zip(names, _bundles(lang[a:b][doc], tri, len(names))):
                        sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pd.DataFrame({"lang": name, "dim": np.arange(DIMS), "value": v})

    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInPandas(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    return {name: g.sort_values("dim")["value"].to_numpy() for name, g in sums.groupby("lang") if (g["value"] != 0).any()}


def predicted(docs: DataFrame, protos: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """The `keep` columns of docs, then lang_pred and score, the cosine (0 to 1); a clash of names makes these lang_pred_ and score_.

    A null text or one without a letter gets 'und' and 0, as does every text if nothing was learned; ties go to the
    language first in alphabetical order.
    """
    names = sorted(protos)
    proto = np.stack([protos[n] / np.linalg.norm(protos[n]) for n in names]).astype(np.float32) if names else np.zeros((0, DIMS), np.float32)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t or "" for t in part["text"]]
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for a, b in _blocks(texts) if names else ():
                doc, tri, has = _trigrams(texts[a:b])
                if has.any():
                    v = _bundles(doc, tri, b - a)
                    cos = (v @ proto.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    best = cos.argmax(1)
                    lang[a:b][has] = np.array(names, object)[best[has]]
                    score[a:b][has] = np.clip(cos[np.arange(b - a), best][has], 0, 1)
            yield part.drop(columns="text").assign(lang_pred=lang, score=score)

    kept = docs.select(*keep).schema.fields
    inner = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text"))
    return rows.mapInPandas(run, inner).toDF(*keep, *unused(keep, "lang_pred", "score"))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; documents with fold 2 of 4 are held out of training.

    A null doc_id is neither trained on nor held out.
    """
    out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    protos = prototypes(docs.where(fold(F.col("doc_id"), 4) != 2))
    return predicted(docs.withColumn("held_out", out), protos, ["doc_id", "held_out"])


def in_known_language(docs: DataFrame, least: float = 0.1, letters: int = 10) -> DataFrame:
    """docs, all columns, without texts that are null or have no letters, or that resemble no learned language.

    These have a score below `least` (three times what a text of unknown trigrams gets by chance from a few languages) in
    `letters` letters or more; shorter texts tell too little to reject them. If nothing was learned, only texts without
    letters go. Repeated rows are judged alike; other columns are kept, whatever their names.
    """
    protos = prototypes(docs)
    if not protos:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = predicted(docs, protos, docs.columns)
    lang, score = told.columns[-2:]
    short = F.length(F.regexp_replace("text", r"\P{L}", "")) < letters
    return told.where((F.col(lang) != UNKNOWN) & ((F.col(score) >= least) | short)).select(*docs.columns)
