"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. Null texts count as empty. A document is an identifier with a text: rows that share an identifier but not the
text, and rows without an identifier, are judged one by one. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoplex.llm.decontamination import decontaminate
from chronoplex.llm.exact_dedup import exact_dedup, kept_documents
from chronoplex.llm.near_copies import near_copies, one_of_each_group
from chronoplex.llm.packing import pack
from chronoplex.llm.quality import fit_quality, keep_good
from chronoplex.plans.lineage import cut

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more)."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier; rows of equal identifier and text count as copies too."""
    return kept_documents(docs, exact_dedup(docs, keep="smallest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8; the smallest identifier stays, nulls come last."""
    return one_of_each_group(docs, near_copies(docs, similarity=0.8, words_per_shingle=5))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), capacity=CAPACITY, end_id=END_ID, with_ids=False).drop("ids")


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: SQL can express neither the classifier nor the sketches; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each intermediate result is a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
