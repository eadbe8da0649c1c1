"""Decisions from XML files as they arrive: the batch scan on a streaming reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.sources.decisions import final_decisions, flatten_decisions, split_records


def stream_decisions(spark: SparkSession, path: str, latin1: bool = False) -> DataFrame:
    """Decision columns (without ``id_materia``) of the UTF-8 files that arrive in ``path``.

    Stateless: each record is filtered and flattened on its own. Subject numbers depend on
    all decisions, so they are left to ``with_subject_index`` over the written table.
    """
    records = split_records(spark.readStream, path)
    return flatten_decisions(final_decisions(records), F.col("file"), latin1)
