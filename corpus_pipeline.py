"""The training-data pipeline over `documents`: quality, repeated lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of `documents`. A document that loses all of its text stays, empty; only the quality
and the near-duplicate stage take documents away.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import jaccard, lines, packing, quality, substrings
from premia.llm.common import fold, table, written
from premia.llm.queries import QUALITY_LEAST


def _aside(docs: DataFrame) -> DataFrame:
    """Key, text and all other columns as one struct, so that no column of a document meets one that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("document") if others else F.lit(None).cast("string").alias("document"))


def _with_text(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """`columns` in their order with another text, and n_chars to match; `found` has what `_aside` set apart."""
    new = found.select("doc_id", "document", text.alias("text"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("document.n_chars")) if "n_chars" in columns else None}
    return new.select(*[(own[c] if c in own else F.col(f"document.`{c}`")).alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the least; the model learns from labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    teaching = docs.where(fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(written(quality.labelled(quality.features(teaching), labels)))
    return quality.keep(docs, model, QUALITY_LEAST)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines, long single lines and one-line documents go."""
    return _with_text(lines.deduplicate(_aside(docs), alone=lines.ALONE), docs.columns, F.col("kept"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; so do documents without an id."""
    found = jaccard.components_of(docs)
    later = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document that loses none keeps its white space."""
    found = substrings.deduplicate(_aside(docs))
    return _with_text(found, docs.columns, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training windows."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("retrieval_packing", retrieval_packing),
]

#: A fitted model, retrieval and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
