"""Registered queries of the operators, with the SQL that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fillmiddle, langid, linededup, mixing, nndescent, packing, prefixtrie, quality, simhash, toxicity, warc
from .common import read_table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(read_table(spark, sf_dir, "pages")).drop("chunks", "digest_ok")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(chat.with_probe(read_table(spark, sf_dir, "conversations")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(read_table(spark, sf_dir, "conversations")).drop("x1", "x2")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.transformed_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc": op2_warc,
    "op3_chat_format": op3_chat_format,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_packing": op12_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "op1_embedding_near_dedup": nndescent.ORACLE,
    "op2_warc": warc.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op11_conversation_trie": prefixtrie.ORACLE,
    "op13_fill_in_middle": fillmiddle.ORACLE,
}
