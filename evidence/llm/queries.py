"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, quality, quotes, resampling, spelling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("clean_text", 256).alias("clean_sha256"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(_table(spark, sf_dir, "conversations"))


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import encoded_digests

    return encoded_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_tokens": op3_tokens,
    "op4_quotes": op4_quotes,
    "op5_suffix": op5_suffix,
    "op6_lines": op6_lines,
    "op7_forest": op7_forest,
    "op8_pieces": op8_pieces,
    "op9_langid": op9_langid,
    "op10_packing": op10_packing,
    "op11_resampling": op11_resampling,
    "op12_mixing": op12_mixing,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {"op1_quality": quality.SQL, "op4_quotes": quotes.SQL, "op11_resampling": resampling.SQL, "op12_mixing": mixing.SQL, "op13_spelling": spelling.SQL}
