"""The corpus queries: thin contract digests over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import functions as F

from cartoflow.llm import exact_dedup, fingerprints, langid, lm_score, mixing, ngram_join, packing, pii, suffix_dedup, token_counts
from cartoflow.llm.common import documents, staged


def tokenizer_path(name: str) -> str:
    """A public tokenizer file: in the folder CARTOFLOW_TOKENIZERS if that is set, else in the installed package."""
    folder = os.environ.get("CARTOFLOW_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def op1_pii(spark, sf_dir):
    return pii.digest(documents(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    sized = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "source", mixing.words().alias("size"))
    mixed = mixing.mix(staged(sized, "sizes"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_lm_score(spark, sf_dir):
    return lm_score.lm_scores(documents(spark, sf_dir))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(documents(spark, sf_dir)).drop("text_hash", "root")


def op9_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_exact_dedup, op4_fingerprints, op5_lm_score, op6_suffix_dedup, op7_packing, op8_jaccard_join, op9_language_id, op10_token_counts)}
ORACLES = {"op2_mixing": mixing.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE}
