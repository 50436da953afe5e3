"""The registered queries of the corpus operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import byte_bpe, conversations, jaccard, language, lattice, lines, packing, quality, substrings, templates, vectors, whitening
from premia.llm.common import fold, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x, model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(x, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


#: Score from which a document counts as good.
QUALITY_LEAST = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, quality.Discriminant]:
    """Statistics of all documents, and the model of those whose label may be learnt."""
    x = written(quality.features(docs))
    return x, quality.fit(quality.labelled(x.where(fold(F.col("doc_id"), 5) != 0), labels))


@query
def op2_retrieval_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_language_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = language.predict(docs, profiles)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.deduplicate(docs, alone=lines.ALONE)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_lattice_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lattice.fit(docs.where(fold(F.col("doc_id"), 7) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    scored = lattice.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_embedding_dedup(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), 0.98)


@query
def op10_nearest_neighbours(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "key % 20 = 0")


@query
def op11_conversation_repair(spark, sf_dir):
    turns = written(conversations.damage(table(spark, sf_dir, "conversations")))
    report = written(conversations.repair(turns, gone="gone"))
    hashed = conversations.digests(turns, report, gone="gone")
    same = F.col("r.conv_id").eqNullSafe(F.col("h.conv_id"))
    return report.alias("r").join(hashed.alias("h"), same).select("r.*", "h.repaired_sha256")


@query
def op12_template_removal(spark, sf_dir):
    found = templates.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op13_lanczos_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
