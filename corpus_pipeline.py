"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes to the
shared folder and reads again as the next stage's docs.  All but the last return the columns
of documents; what a stage drops is gone for those after it, and a document that the mix takes
twice is there twice.

Defined results of every stage: an empty table gives an empty result; further columns, also
such as clash with names used inside, pass unchanged; texts are processed whole however long.
Of rows equal in id and text that are duplicates of each other exactly one stays, whichever
(they are the same document); a null id is an id of its own, after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoflow.llm import exact_dedup, langid, mixing, ngram_join, packing
from cartoflow.llm.common import drop_staged, staged, staged_count, text_or_empty
from cartoflow.llm.queries import tokenizer_path

#: Words of a shingle and similarity (numerator, denominator) of near duplicates.
SHINGLE, ALIKE = 5, (80, 100)
#: Keys of rows to drop up to which they are broadcast; beyond, the rows are shuffled to them.
MOST_BROADCAST = 500_000


def _id() -> F.Column:
    """The id as a key that null has too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _chosen(docs: DataFrame, digest: F.Column, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; ``told`` has the __id, __digest and __stay of every one.

    Rows are not shuffled to their verdicts: only keys of rows that go, or that several rows
    share, are sent, and what shares a key and stays is thinned to one row.
    """
    keys = told.groupBy("__id", "__digest").agg(F.max("__stay").alias("__stay"), F.count("*").alias("__n"))
    odd = staged(keys.where("not __stay or __n > 1"), "odd")
    n, shared = odd.agg(F.count("*"), F.count_if(F.col("__stay"))).first()
    sent = F.broadcast(odd) if n <= MOST_BROADCAST else odd
    rows = docs.select(F.struct("*").alias("__row"), _id().alias("__id"), digest.alias("__digest")).join(sent, ["__id", "__digest"], "left")
    kept = rows.where("__n is null").select("__row")
    if shared:
        rank = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(F.lit(0)))
        kept = kept.unionByName(rows.where("__stay").withColumn("__rank", rank).where("__rank = 1").select("__row"))
    return kept.select("__row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter in it) go; nothing else does, whatever the score."""
    return langid.predict(docs, langid.fit(docs)).where("__lang_pred <> 'und'").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space (null: empty) the one with the smallest id stays."""
    found = exact_dedup.exact_dedup(docs.select("doc_id", "text"))
    told = found.select(_id().alias("__id"), F.col("text_sha256").alias("__digest"), F.col("kept").alias("__stay"))
    return _chosen(docs, F.sha2(exact_dedup.normalised(text_or_empty()).cast("binary"), 256), told)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (ties: the least text hash).

    Near duplicates share 80 percent of their distinct five-word shingles or more, groups are
    connected through them; documents without words are in no group and stay.
    """
    found = staged(ngram_join.jaccard_components(docs.select("doc_id", "text"), SHINGLE, *ALIKE).select("doc_id", "text_hash", "root"), "near")
    mine = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.where("root is not null").groupBy("root").agg(F.min(mine).alias("first"), F.count("*").alias("n")).where("n > 1")
    judged = found.join(first, "root", "left").withColumn("__stay", F.col("first").isNull() | (mine == F.col("first")))
    told = judged.select(_id().alias("__id"), F.col("text_hash").alias("__digest"), "__stay")
    return _chosen(docs, F.xxhash64(text_or_empty().cast("string")), told)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once, or up to three times); null is a source of its own.

    Where ids are unique only they and the copies are mixed, and the rows meet them afterwards.
    """
    sized = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mixing.words().alias("size")]
    n, different = docs.agg(F.count("*"), F.count_distinct(_id())).first()
    if n == different:
        copies = staged(mixing.mix(staged(docs.select(*sized), "sizes")).where("copies > 0").select(_id().alias("__id"), "copies"), "copies")
        copies = F.broadcast(copies) if n <= MOST_BROADCAST else copies
        mixed = docs.select(F.struct("*").alias("__row"), _id().alias("__id")).join(copies, "__id")
    else:
        mixed = mixing.mix(docs.select(F.struct("*").alias("__row"), *sized)).where("copies > 0")
    return mixed.select("__row", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("__copy")).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the mix: one row per piece; copies of a document are packed apart."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]
#: The language model and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = staged_count()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(spark, since)  # what the stage and its predecessor wrote
    return docs
