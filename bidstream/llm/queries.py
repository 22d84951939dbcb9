"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from bidstream.llm import statements
from bidstream.llm.tables import table

TOKENIZER = "byte_bpe_50k.json"


def _fold(doc_id="doc_id", folds=5):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def mixing(spark, sf_dir):
    from bidstream.llm.mixing import mixed

    return mixed(_documents(spark, sf_dir)).drop("source")


def near_dedup(spark, sf_dir):
    from bidstream.llm.near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def neighbours(spark, sf_dir):
    from bidstream.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def packing(spark, sf_dir):
    from bidstream.llm.packing import packed

    return packed(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def line_quality(spark, sf_dir):
    from bidstream.llm.line_quality import cleaned

    return cleaned(_documents(spark, sf_dir).select("doc_id", "text")).drop("text", "cleaned_text")


def toxicity_training():
    """Condition on labels.doc_id of the rows to learn from."""
    return _fold() != 0


def toxicity(spark, sf_dir):
    from bidstream.llm.toxicity import scores

    return scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), _fold() == 0, toxicity_training())


def language_model(spark, sf_dir):
    from bidstream.llm.language_model import scores

    return scores(_documents(spark, sf_dir), _fold() == 1)


def suffix_dedup(spark, sf_dir):
    from bidstream.llm.suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def token_counts(spark, sf_dir):
    from bidstream.llm.token_counts import token_counts as counts

    return counts(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def pairwise_quality(spark, sf_dir):
    from bidstream.llm.pairwise_quality import scores

    held_out = _fold(folds=4) == 2
    return scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out, ~held_out)


def vector_codes(spark, sf_dir):
    from bidstream.llm.vector_codes import compressed

    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def secret_scan(spark, sf_dir):
    from bidstream.llm.secret_scan import BASE, secrets, spans_text

    found = secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text("secrets", tuple(BASE)), 256).alias("base_sha256"),
        spans_text("secrets").alias("spans"), "n_entropy")


def hard_negatives(spark, sf_dir):
    from bidstream.llm.hard_negatives import hard_negatives as mined

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_mixing": mixing,
    "op2_near_dedup": near_dedup,
    "op3_neighbours": neighbours,
    "op4_packing": packing,
    "op5_line_quality": line_quality,
    "op6_toxicity": toxicity,
    "op7_language_model": language_model,
    "op8_suffix_dedup": suffix_dedup,
    "op9_token_counts": token_counts,
    "op10_pairwise_quality": pairwise_quality,
    "op11_vector_codes": vector_codes,
    "op12_secret_scan": secret_scan,
    "op13_hard_negatives": hard_negatives,
}

STATEMENTS = {name: getattr(statements, name.upper()) for name in QUERIES if hasattr(statements, name.upper())}
