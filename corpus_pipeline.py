"""A corpus pipeline of five stages: documents in, documents (at last with piece ids) out.

Every stage works on all rows that its predecessor kept, is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import scratch, shipped, sized, unused, written
from loomspan.llm.langid import in_known_language
from loomspan.llm.mixing import mixed
from loomspan.llm.near_dedup import without_near_duplicates
from loomspan.llm.pieces import encoded
from loomspan.llm.queries import tokenizer
from loomspan.llm.secret_scan import redacted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or like no learned language go: null and empty texts, too. Repeated rows are judged alike."""
    shipped(spark)
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity of 0.75 or more.

    Rows without doc_id and texts without words stay; rows that share a doc_id stay or go together.
    """
    shipped(spark)
    return without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay, null and empty texts as they are. Repeated rows are masked alike."""
    return redacted(docs)


def in_mix(docs: DataFrame) -> DataFrame:
    """docs and last each document's place in the mix of sources; it depends on the rows alone, not on their order.

    Rows that share a doc_id share the first of their places.
    """
    key, slot = unused(docs.columns, "id", "slot")
    slots = written(mixed(docs).groupBy(F.col("doc_id").alias(key)).agg(F.min("slot").alias(slot)))
    return docs.join(sized(slots, 16), docs["doc_id"].eqNullSafe(F.col(key))).drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix of their sources; files hold consecutive slots.

    A null source counts as one named ''. Repeated rows stay.
    """
    shipped(spark)
    rows = in_mix(docs)
    order = [rows.columns[-1], "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (of pieces), n_pieces and slot last: (slot, doc_id) is the order of the mix.

    Files are read again in any order, so the slots of the stage before are worked out anew. A null or empty text has no
    pieces. If the documents have a column named like one of the three, the new one gets an underscore more.
    """
    shipped(spark)
    rows = in_mix(docs)
    rows = encoded(rows, tokenizer())
    slot, ids = rows.columns[-2:]
    names = unused(docs.columns, "ids", "n_pieces", "slot")
    return rows.select(*docs.columns, F.col(ids).alias(names[0]), F.size(ids).cast("long").alias(names[1]), F.col(slot).alias(names[2]))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Trained models and merge paths are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
