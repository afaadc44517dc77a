"""Pipeline over ``documents``: stages written as Parquet and reread."""

from __future__ import annotations

from postline.llm import stages

#: (name, function); each takes (spark, docs, sf_dir).
STAGES = stages.STAGES

#: The stages are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply all stages to ``documents``."""
    return stages.run(spark, sf_dir)
