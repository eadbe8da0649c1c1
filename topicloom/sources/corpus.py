"""Decision table to corpus: one row per document with text, language and metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.schema import DECISIONS, require_columns

# Metadata name of the corpus -> column of the decision table.
METADATA = {
    "heading": "materia",
    "Id_doc": "doc_id",
    "TipoProvvedimento": "tipo_prov",
    "AnnoDecisione": "anno_dec",
    "NumeroDecisione": "num_dec",
    "NumeroSezione": "num_sez",
    "AnnoNrgSic": "anno_nrg_sic",
    "NrgSic": "nrg_sic",
    "AnnoProvOriginale": "anno_prov_orig",
    "NumProvOriginale": "num_prov_orig",
    "Autorita": "autorita",
    "Localita": "localita",
    "Materia": "materia",
    "Id_materia": "id_materia",
    "Dispositivo": "dispositivo",
}
LANGUAGE = "it"


def decisions_to_corpus(
    decisions: DataFrame,
    mapping: Mapping[str, str] = METADATA,
    content: str = "testo",
    language: str = LANGUAGE,
) -> DataFrame:
    """``(doc_id, text, lang, metadata...)``; ``mapping`` names metadata after their columns.

    The default mapping needs the whole decision table; a custom one only what it names.
    """
    needed = DECISIONS.fieldNames() if mapping is METADATA else [*mapping.values()]
    require_columns(decisions, "doc_id", content, *needed, what="decisions")
    return decisions.select(
        "doc_id",
        F.col(content).alias("text"),
        F.lit(language).alias("lang"),
        *[F.col(column).alias(name) for name, column in mapping.items()],
    )


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    """``(doc_id, n)`` for ids that occur more than once; the operators need unique ids."""
    return corpus.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
