"""Saved reductions and sweeps, read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from topicloom.operators import lasso
from topicloom.operators.dtm import Dtm
from topicloom.operators.topics import top_terms, top_topic
from topicloom.sources.exports import MANIFEST


@dataclass(frozen=True)
class Saved:
    """A complete result: its kind, tables by name, and facts as texts."""

    kind: str
    tables: dict[str, DataFrame]
    facts: dict[str, str]


@dataclass(frozen=True)
class SavedReduction(Saved):
    """A vocabulary cut; one by the lasso also predicts."""

    @property
    def reduced(self) -> Dtm:
        return Dtm(self.tables["docs"], self.tables["matrix_vocabulary"], self.tables["entries"], self.kind)

    def predict(self, values: DataFrame, docs: DataFrame, value: str = "weight") -> DataFrame:
        """``(doc_id, pred)`` by the chosen model, for values weighted as those it was fitted on."""
        if "intercepts" not in self.tables:
            raise ValueError(f"a reduction of kind {self.kind} has no model")
        return lasso.predict(values, docs, self.tables["terms_by_class"], self.tables["intercepts"], value)


@dataclass(frozen=True)
class SavedSweep(Saved):
    """A sweep over k: its runs, and the tables of the best model or of any other that was fitted."""

    @property
    def best_k(self) -> int:
        return int(self.facts["best_k"])

    def posteriors(self, k: int | None = None) -> DataFrame:
        return self.tables[f"k={k or self.best_k}/posteriors"]

    def phi(self, k: int | None = None) -> DataFrame:
        return self.tables[f"k={k or self.best_k}/phi"]

    def top_terms(self, k: int | None = None, n: int = 10) -> DataFrame:
        return top_terms(self.phi(k), n)

    def top_topic(self, k: int | None = None) -> DataFrame:
        return top_topic(self.posteriors(k))


def _load(spark: SparkSession, path: str, what: str) -> tuple[str, dict[str, DataFrame], dict[str, str]]:
    path = path.rstrip("/")
    schema = "what string, kind string, tables array<string>, facts map<string, string>"
    try:
        manifest = spark.read.schema(schema).json(f"{path}/{MANIFEST}").first()
    except AnalysisException as error:
        raise ValueError(f"{path} holds no complete result") from error
    if manifest is None or manifest["what"] != what:
        raise ValueError(f"{path} holds no {what}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    return manifest["kind"], tables, manifest["facts"] or {}


def load_reduction(spark: SparkSession, path: str) -> SavedReduction:
    """The reduction saved under ``path``; a half-written or other result is a ``ValueError``."""
    return SavedReduction(*_load(spark, path, "reduction"))


def load_sweep(spark: SparkSession, path: str) -> SavedSweep:
    """The sweep saved under ``path``; a half-written or other result is a ``ValueError``."""
    return SavedSweep(*_load(spark, path, "sweep"))
