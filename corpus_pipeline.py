"""The corpus pipeline: toxicity, language, near copies, benchmark passages, tokens."""

from __future__ import annotations

from packspan.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None  # stages apply fitted models, which SQL can't express; tests/llm hold the pipeline against its parts


def run(spark, sf_dir):
    return pipeline.run(spark, sf_dir)
