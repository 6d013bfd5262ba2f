"""A training corpus from raw documents: classified, deduplicated, decontaminated, packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactlake.llm._batch import load, materialised
from redactlake.llm.decontamination import stage_decontamination
from redactlake.llm.line_dedup import stage_lines
from redactlake.llm.ngram_join import stage_near_duplicates
from redactlake.llm.packing import stage_packing
from redactlake.llm.quality_classifier import stage_quality

STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: The classifier, the edit search and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
