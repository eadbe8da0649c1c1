"""Tf-idf weights with cosine normalisation, and what the normalisation cannot reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.dtm import Dtm, document_frequency
from topicloom.stash import join_on_term, stash


def idf(n_docs: int, df: Column) -> Column:
    """``log2(N / df)``; a term of no document gets 0."""
    return F.when(df > 0, F.log2(F.lit(float(n_docs)) / df)).otherwise(F.lit(0.0))


def tfidf_weights(dtm: Dtm, normalize: bool = True) -> DataFrame:
    """``(doc_id, term, weight)``: tf * log2(N/df), each document scaled to unit length.

    df is counted over the matrix as given, which may hold fewer rows than the one its
    vocabulary was counted on. A document whose weights are all 0 keeps weight 0.
    """
    terms = stash(
        document_frequency(dtm.entries).withColumn("idf", idf(dtm.n_docs, F.col("df"))),
        "idf",
    )
    raw = join_on_term(dtm.entries, terms).select(
        "doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight")
    )
    if not normalize:
        return raw
    squares = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id"))
    return raw.withColumn("squares", squares).select(
        "doc_id",
        "term",
        F.when(F.col("squares") > 0, F.col("weight") / F.sqrt("squares"))
        .otherwise(F.lit(0.0))
        .alias("weight"),
    )


def tfidf_diagnostics(dtm: Dtm) -> tuple[DataFrame, DataFrame]:
    """Terms of the vocabulary found in no document, and documents of zero norm.

    A norm is zero when the document has no entry or only terms that every document has.
    """
    df = document_frequency(dtm.entries)
    unreferenced = dtm.vocabulary.select("term").join(df.select("term"), "term", "left_anti")
    informative = stash(df.where(F.col("df") < dtm.n_docs), "informative")
    weighted = join_on_term(dtm.entries, informative, "left_semi").select("doc_id").distinct()
    return unreferenced, dtm.docs.join(weighted, "doc_id", "left_anti")
