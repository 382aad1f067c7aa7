"""Corpus pipeline: each stage reads what its predecessor kept, written as Parquet in between.

Stages: texts in no learned language go; of each class of near duplicates the row with the least id
stays; documents that hold any window of a benchmark item go; sources are mixed to their target
weights; what is left is written as token ids and read back.

Defined cases: rows with a null, empty or wordless text are in no language and go in the first stage;
a very long text passes through whole; a null ``doc_id`` stays null, and of such near copies one stays;
rows that are equal, or share an id, are told apart as the stages' docstrings say; a null source is a
source of its own; other columns stay, whatever their names, up to the last stage; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, language_id, mixing, simhash, token_output
from graphloom.llm.common import table
from graphloom.session import materialise

STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("token_ids", token_output.stage),
]

#: SQL can express neither the classifier nor the fingerprints; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
