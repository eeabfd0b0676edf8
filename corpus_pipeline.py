"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and read again.

Every stage calls one operator of quern.llm on all rows that its predecessor kept. All but the last return the columns of
documents; the last adds what SentencePiece encoding gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from quern.llm.common import saved

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_dedup.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("SentencePiece encoding and decoding", sentencepiece_codec.stage),
]

#: SQL can express neither the determinant estimates nor the alignments; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, encoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, "stage", "zstd")
    return docs
