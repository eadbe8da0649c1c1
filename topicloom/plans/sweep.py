"""LDA over a grid of topic counts, and the count whose mixtures predict the class best."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.classify import CompositionErrors, classify_compositions
from topicloom.operators.dtm import Dtm
from topicloom.operators.evaluate import best_k
from topicloom.operators.lasso import PathOptions, in_threads
from topicloom.operators.lda import METHODS, LdaOptions, TopicInput, TopicModel, fit_together, prepare, shared_scans
from topicloom.operators.split import DEFAULT_SEED, stratified_split
from topicloom.operators.topics import top_terms, top_topic
from topicloom.plans.deadline import within
from topicloom.schema import require_columns
from topicloom.sources import exports
from topicloom.stash import stash

RECORD = (
    "k int, fit_seconds double, e0_train double, e1_train double, e2_train double, "
    "e0_test double, e1_test double, e2_test double, error string, iterations int, converged boolean"
)


@dataclass(frozen=True)
class Sweep:
    """Every run of a sweep, and tables of the best model."""

    kind: str
    method: str
    runs: DataFrame
    models: dict[int, TopicModel]
    errors: dict[int, CompositionErrors]
    split: DataFrame
    empty_docs: DataFrame
    best: TopicModel

    @property
    def top_topic(self) -> DataFrame:
        return top_topic(self.best.posteriors)

    @property
    def top_terms(self) -> DataFrame:
        return top_terms(self.best.phi)


def topic_counts(first: int = 2, last: int = 2, step: int = 1) -> list[int]:
    """Grid of topic counts, ``last`` included when a step reaches it."""
    return list(range(first, last + 1, step))


def how_it_ended(model: TopicModel | None) -> tuple[int | None, bool | None]:
    """Iterations of a variational fit, and whether it converged."""
    record = model.record if model is not None else None
    return (len(record.iterations), record.converged) if record else (None, None)


def sweep_topics(
    dtm: Dtm,
    classes: DataFrame,
    ks: Sequence[int] = (2,),
    method: str = "VEM",
    repeated_cv: bool = False,
    options: PathOptions = PathOptions(),
    lda: LdaOptions = LdaOptions(),
    parallelism: int = 4,
    out_dir: str | None = None,
    fit: Callable[..., TopicModel] | None = None,
    deadlines: Mapping[int, float] | None = None,
) -> Sweep:
    """Fit every ``k``, classify its compositions, and pick the ``k`` of lowest test error.

    Documents without a word are left out and reported; one split serves all runs. Variational fits share their
    passes over the documents as far as their topic rows can be sent out together; whatever remains is
    submitted from a few driver threads. A run that fails is recorded and skipped: where a shared
    pass fails, each of its ``k`` is fitted alone. ``fit``, if given, fits one ``k`` at a time instead.

    ``deadlines`` holds seconds for some or all ``k``: for the fit, and again for the classification. Whichever of the two
    takes longer is cancelled, its Spark jobs with it, and recorded as failed with the reason. A ``k`` with a deadline is
    fitted alone, since a shared pass cannot be cancelled for one of its ``k`` only.
    """
    if not isinstance(dtm, Dtm):
        raise ValueError("dtm must be a Dtm")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    require_columns(classes, "doc_id", "label", what="classes")
    data: TopicInput = prepare(dtm)
    labelled = data.ids.join(
        classes.select("doc_id", F.col("label").cast("string").alias("label")), "doc_id"
    )
    split = stash(stratified_split(labelled, DEFAULT_SEED), "split")
    spark = split.sparkSession

    limits = dict(deadlines or {})
    ks = list(dict.fromkeys(ks))

    def fits_of(group: list[int], start: float) -> dict[int, tuple[TopicModel, float, None]]:
        models = {k: fit(data, k, method, options=lda) for k in group} if fit else fit_together(data, group, method, options=lda)
        done = {}
        for k, model in models.items():
            begin = time.time() if model.record else start
            posteriors = stash(model.posteriors, "posteriors")
            seconds = time.time() - begin + (model.record.seconds if model.record else 0.0)
            done[k] = replace(model, posteriors=posteriors), seconds, None
        return done

    def fitted(group: list[int]) -> dict[int, tuple[TopicModel | None, float, str | None]]:
        start = time.time()
        try:
            return within(spark, limits.get(group[0]), lambda: fits_of(group, start))
        except Exception as failure:  # a failing k must not stop the others
            if len(group) > 1:
                return {k: outcome for k in group for outcome in fitted([k]).values()}
            return {group[0]: (None, time.time() - start, f"{type(failure).__name__}: {failure}")}

    alone = [k for k in ks if fit or k in limits]
    groups = [[k] for k in alone] + shared_scans([k for k in ks if k not in alone], data.size, method)
    fits = {}
    for found in in_threads(spark, [lambda group=group: fitted(group) for group in groups], parallelism):
        fits |= found

    def run(k: int):
        model, seconds, failure = fits[k]
        if model is None:
            return k, None, None, seconds, failure
        try:
            found = within(spark, limits.get(k), lambda: classify_compositions(model.posteriors, split, repeated_cv, options))
        except Exception as failure:
            return k, None, None, seconds, f"{type(failure).__name__}: {failure}"
        return k, model, found, seconds, None

    outcomes = in_threads(spark, [lambda k=k: run(k) for k in fits], parallelism)

    names = ("e0_train", "e1_train", "e2_train", "e0_test", "e1_test", "e2_test")
    records = [
        (k, seconds, *(found.errors[name] if found else None for name in names), failure, *how_it_ended(model))
        for k, model, found, seconds, failure in outcomes
    ]
    runs = spark.createDataFrame(records, RECORD)
    winner = best_k(runs).first()
    if winner is None:
        raise RuntimeError("every k failed: " + "; ".join(str(r[-3]) for r in records))
    models = {k: model for k, model, *_ in outcomes if model is not None}
    result = Sweep(
        kind=dtm.kind,
        method=method,
        runs=runs,
        models=models,
        errors={k: found for k, _, found, *_ in outcomes if found is not None},
        split=split,
        empty_docs=data.empty,
        best=models[winner["k"]],
    )
    if out_dir is not None:
        exports.export_sweep(result, f"{out_dir.rstrip('/')}/{method}/{dtm.kind}")
    return result
