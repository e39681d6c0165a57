"""Corpus preparation as a sequence of stages over documents.

Each stage works on the whole table that its predecessor left and returns a table with the
columns of documents, but for the last, which says where each piece of a text is packed:

1. quality rules: rejected documents go, and the lines that a host repeats too often;
2. line dedup: of near-equal lines of all documents the first stays;
3. near-dedup: of documents that share four fifths of their five-word shingles one stays;
4. suffix dedup: bytes go that a string of 100 bytes covers which also starts earlier;
5. packing into sequences of at most 1024 tokens.

Documents that stage 2 or 4 leaves without a word go; those that came without one were
rejected in stage 1.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence.llm.common import WORD, Scratch
from evidence.llm.lines import line_dedup
from evidence.llm.minhash import near_duplicates
from evidence.llm.packing import pack
from evidence.llm.quality import quality_rules
from evidence.llm.suffix import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents with a new text and its length."""
    length = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return docs.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", length).select(*COLUMNS)


def _owning(out: DataFrame, scratch: Scratch) -> DataFrame:
    """A stage's result with the intermediate tables it reads, to be closed once it is written."""
    out._scratch = scratch
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1."""
    out = quality_rules(docs, with_text=True, carry=("lang", "source"))
    return _documents(out.where("kept"), F.col("clean_text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    s = Scratch(spark, "lines")
    out = line_dedup(docs, carry=("lang", "source"), scratch=s)
    return _owning(_documents(out.where((F.col("n_lines") == F.col("n_kept")) | F.regexp_like("clean_text", F.lit(WORD))), F.col("clean_text")), s)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2."""
    s = Scratch(spark, "minhash")
    out = near_duplicates(docs, scratch=s).where("kept").select("doc_id").distinct()
    return _owning(docs.join(out, docs["doc_id"].eqNullSafe(out["doc_id"]), "left_semi").select(*COLUMNS), s)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5."""
    s = Scratch(spark, "suffix")
    out = suffix_dedup(docs, carry=("lang", "source"), as_text=True, scratch=s)
    return _owning(_documents(out.where((F.col("n_removed") == 0) | F.regexp_like("kept", F.lit(WORD))), F.col("kept")), s)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("suffix dedup", suffixes), ("packing", packing)]

#: Line components and suffix order have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    What a stage kept for itself, and its predecessor's table, go once its own table is written.
    """
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        new = s.save(out)
        if hasattr(out, "_scratch"):
            out._scratch.close()
        if hasattr(docs, "_scratch_path"):
            s.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
