"""From raw documents to packed sequences: five stages, each one operator of genospark.llm.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and rereads them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.llm import language_id, quality_trees
from genospark.llm.common import bound_batches, documents, stored
from genospark.llm.line_dedup import line_dedup
from genospark.llm.mixing import mix, word_count
from genospark.llm.ngram_join import ngram_join
from genospark.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction below this posterior is no decision.
LEAST_CERTAINTY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays uncertain; a null lang takes the prediction."""
    found = language_id.identify(docs.select(COLUMNS))
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_CERTAINTY))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay in their first place only; a document left without a word goes."""
    out = line_dedup(docs.select(COLUMNS), min_docs=10, min_chars=1, keep_first=True)
    out = out.where((F.col("n_dropped") == 0) | (word_count(F.col("kept_text")) > 0))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id: 5 words, similarity 0.8.

    Rows without an id are told apart by their texts and come after all others.  Rows that share an id stay or go
    together, but of rows that also share the text one stays.
    """
    stand_in = F.shiftright(F.xxhash64("text"), 2).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 61)
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", stand_in).alias("_key"))
    found = ngram_join(keyed, k=5, percent=80, id_col="_key")
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    kept = keyed.join(stay, "_key", "left_semi").withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    return kept.dropDuplicates(["_key", "_text"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 150% of all words, at most two epochs of a source.

    Weights are the quality classifier's scores, learned from ``labels``.
    """
    docs = docs.select(COLUMNS)
    trees = quality_trees.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_trees.score(docs, trees, with_text=True)
    mixed = mix(scored, budget_share=1.5, max_epochs=2.0, keep=("text", "lang", "n_chars"), weight_col="score", size_col="n_words")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")
    return mixed.select(*COLUMNS, copies).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their places in sequences."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
