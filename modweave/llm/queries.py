"""The queries ``opN_<name>`` and their SQL, each applying its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.llm import oracles
from modweave.llm.chat import format_chats, read_back
from modweave.llm.jaccard_join import near_duplicates
from modweave.llm.language import languages
from modweave.llm.mixing import mix
from modweave.llm.packing import pack
from modweave.llm.permutation_index import nearest
from modweave.llm.pstable import near_vectors
from modweave.llm.quality import quality
from modweave.llm.runtime import table
from modweave.llm.substring_dedup import substring_dedup
from modweave.llm.tokens import token_counts


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_PROBE = "\\### Assistant: </turn> ok"  # both turns of conversation -7, which must come back as it went in


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(chats.unionByName(probe)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_permutation_index": op7_permutation_index,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": oracles.CHAT,
    "op5_embedding_dedup": oracles.VECTORS,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op10_jaccard_join": oracles.JACCARD,
}
