"""Labelled training rows: all of them for counts, a bounded sample for models that are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a NULL id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def training_labels(labels: DataFrame, column: str, modulus: int = 5, rest: int = 0) -> DataFrame:
    """``doc_id`` and ``y`` (0 or 1) of rows that are not held out; one row per id, the larger label wins."""
    return (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y")))


def labelled_sample(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of at most ``most`` labelled rows, in hash order.

    The sample's ids are the only thing broadcast: ``most`` rows of 12 bytes.
    """
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
