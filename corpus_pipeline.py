"""Corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of `documents`, whatever further columns there are. An empty
table gives an empty one, null ids and repeated rows are rows like others, a null text is
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import decontaminate, packing, quality, simhash
from spikeloom.llm.common import fresh_path, table
from spikeloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer doesn't reject; wordless texts stay, as no heuristic votes on them."""
    return quality.keep_good(docs, quality.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: the smallest doc_id; of wordless texts one."""
    return simhash.keep_one(docs, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are hit by benchmark windows."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of at most 2048 tokens; an empty text is one piece, its end id."""
    placed, _ = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), "word", end_id=1)
    return placed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("packing", packing_stage)]

#: Tokenization, shingle similarity and the trained scorer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = fresh_path(spark, STAGES[-1][0])
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
