"""Documents to packed training sequences: every stage works on all that its predecessor kept."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import structweave  # noqa: E402
from structweave.llm.common import saved, table  # noqa: E402
from structweave.llm.decontaminate import decontamination_stage  # noqa: E402
from structweave.llm.language_id import language_stage  # noqa: E402
from structweave.llm.packing import packing_stage  # noqa: E402
from structweave.llm.simhash import near_duplicate_stage  # noqa: E402
from structweave.llm.suffix_dedup import suffix_dedup_stage  # noqa: E402

# Python workers need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(structweave)

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language models, fingerprints and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
