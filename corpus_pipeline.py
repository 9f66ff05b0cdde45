"""Corpus preparation: documents in, token ids of the kept and mixed documents out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm.common import shared_dir, table
from pairlens.llm.near_copies import keep_first
from pairlens.llm.orc_tokens import tokens
from pairlens.llm.rank_langid import known_language
from pairlens.llm.temperature_mix import mixed
from pairlens.llm.template_decontam import drop_leaks

STAGES = [
    ("language_id", known_language),
    ("near_duplicates", keep_first),
    ("decontamination", drop_leaks),
    ("mixing", mixed),
    ("token_ids", tokens),
]

#: Fingerprints, profiles and token ids are beyond SQL; tests/llm tests each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
