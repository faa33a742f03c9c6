"""The queries of the operators of this subpackage, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, chat, decontaminate, langid, minhash, mixing, oracles, pii, sharding, token_counts, token_files
from quern.llm.shared import new_path

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The key of the pseudonyms; a real one is given by its holder.
PII_KEY = "public test key"
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "n_replaced", "text")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return token_files.token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def three_edits(text: str) -> list[token_counts.Edit]:
    """A replacement in the middle, an insertion in the first quarter, a deletion in the third, as a test of any text."""
    n = len(text)
    return [(n // 2, min(n, n // 2 + 12), " edited here"), (n // 4, n // 4, "new words, 42 "), (3 * n // 4, min(n, 3 * n // 4 + 30), "")]


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PRETOKENS, three_edits)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    ops = (op1_minhash, op2_chat, op3_ann, op4_mixing, op5_pii, op6_tokens, op7_langid, op8_token_counts, op9_decontamination, op10_sharding)
    return {f.__name__: f for f in ops} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": oracles.OP1, "op10_sharding": oracles.OP10}
