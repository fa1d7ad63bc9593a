"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, piece ids."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secframe.llm import decontaminate, lines, neardup, pieces, quality
from secframe.llm.common import Scratch, table

STAGES = [
    ("quality_rules", quality.stage_quality),
    ("line_dedup", lines.stage_lines),
    ("near_dedup", neardup.stage_neardup),
    ("decontamination", decontaminate.stage_decontaminate),
    ("sentencepiece", pieces.stage_pieces),
]

#: The last stage's ids cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
