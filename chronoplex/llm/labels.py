"""Labelled documents for the classifiers: all of them, or bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import crc_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int,
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, label`` (and ``extra``) of at most ``per_class`` labelled rows of each class.

    Rows whose CRC-32 fold is ``held_out`` never take part. The choice follows a hash of the identifier, so it is the same on each
    run and at any partitioning. An identifier with several labels counts with the highest one, one with several rows counts with the text of the
    smallest hash; labels other than 0 and 1, and null identifiers, are left out.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    )
    chosen = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    # two times per_class identifiers at most, and one row of each, so the bound holds for rows
    chosen_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra).join(F.broadcast(sample), "doc_id")
    first = F.min_by(F.struct("text", "label", *extra), F.struct(F.xxhash64("text"), *extra)).alias("row")
    return chosen_rows.groupBy("doc_id").agg(first).select("doc_id", "row.*")


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id, text_hash, label`` of all labelled identifiers of ``docs`` outside the fold, with the rules of ``labelled_sample``; no text is moved."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash")).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash")).join(usable, "doc_id")
