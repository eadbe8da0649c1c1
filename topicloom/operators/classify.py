"""How well topic compositions predict a known class: three logistic methods."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators import lasso, newton
from topicloom.operators.evaluate import cv_summary
from topicloom.operators.topics import ilr_coordinates
from topicloom.schema import require_columns
from topicloom.stash import stash

# Seed of the folds, elastic-net mixing grid, repeats of the cross-validation.
CV_SEED = 2010
ALPHAS = tuple(round(a / 10, 1) for a in range(1, 11))
REPEATS = 10


@dataclass(frozen=True)
class CompositionErrors:
    """Train and test errors, with a confusion table, per method.

    e0  lasso path, lambda of the lowest train error
    e1  lasso path, lambda by cross-validation and the one-standard-error rule; its train
        error is the lowest cross-validation error
    e2  elastic-net grid by repeated cross-validation; None unless asked for
    """

    errors: dict[str, float | None]
    confusion: dict[str, DataFrame]


def classify_compositions(
    posteriors: DataFrame,
    split: DataFrame,
    repeated_cv: bool = False,
    options: lasso.PathOptions = lasso.PathOptions(),
    repeats: int = REPEATS,
    alphas: tuple[float, ...] = ALPHAS,
) -> CompositionErrors:
    """Fit the methods on the ilr coordinates of ``(doc_id, p)``.

    ``split`` is ``(doc_id, label, is_train)``. Compositions are closed and transformed
    inside the row; the only shuffle before the fits joins them to their labels.
    """
    require_columns(posteriors, "doc_id", "p", what="posteriors")
    require_columns(split, "doc_id", "label", "is_train", what="split")
    labels = split.select("doc_id", F.col("label").cast("string").alias("label"), "is_train")
    coordinates = ilr_coordinates(posteriors.select("doc_id", "p")).select("doc_id", "z")
    joined = stash(coordinates.join(labels, "doc_id"), "coordinates")
    long = joined.select("doc_id", F.posexplode("z").alias("coord", "weight"))
    # Positions in front keep the order of coordinates in that of the names.
    long = long.select("doc_id", F.format_string("%05d", "coord").alias("term"), "weight")
    data = lasso.path_data(long, joined.select("doc_id", "label", "is_train"))

    fit0 = lasso.fit_by_train_error(data, options)
    fit1 = lasso.fit_by_cv(data, "lambda_1se", CV_SEED, options)
    errors = {
        "e0_train": fit0.err_train,
        "e1_train": fit1.err_train,
        "e2_train": None,
        "e0_test": fit0.err_test,
        "e1_test": fit1.err_test,
        "e2_test": None,
    }
    confusion = {"cm0": fit0.confusion, "cm1": fit1.confusion}
    if repeated_cv:
        grid = elastic_net_grid(data, fit0.lambdas, options, repeats, alphas)
        errors["e2_train"], errors["e2_test"], confusion["cm2"] = grid.error, grid.err_test, grid.confusion
    return CompositionErrors(errors, confusion)


@dataclass(frozen=True)
class GridFit:
    """The winning pair of an alpha x lambda grid; ``cells`` has the mean accuracy of every pair."""

    alpha: float
    lam: float
    error: float
    err_test: float | None
    confusion: DataFrame
    cells: DataFrame
    passes: int
    converged: bool


def elastic_net_grid(
    data: lasso.PathData,
    lambdas: tuple[float, ...],
    options: lasso.PathOptions = lasso.PathOptions(),
    repeats: int = REPEATS,
    alphas: tuple[float, ...] = ALPHAS,
) -> GridFit:
    """Repeated cross-validation over alpha x lambda: the pair of highest mean accuracy over all resamples.

    Each repeat draws new folds; the models of all repeats and folds of an alpha go along the path together. Resamples
    count alike, whatever their size. Ties go to the larger lambda, then the smaller alpha, the simpler model.
    """
    spark = data.table.sparkSession
    best, cells, passes, converged = None, None, 0, True
    for alpha in alphas:
        setting = replace(options, alpha=alpha)
        with lasso.fitting_rows(data, [CV_SEED + r for r in range(repeats)], options.folds) as rows:
            steps = list(newton.solve_path(rows, lasso.path_rule(data, setting, lambdas)))
            found = spark.createDataFrame(lasso.held_out_errors(rows, steps, options.folds), lasso.CELLS)
        summary = stash(cv_summary(found.drop("n")).withColumn("alpha", F.lit(alpha)), "grid")
        cells = summary if cells is None else cells.unionByName(summary)
        top = summary.orderBy("cvm", F.desc("lambda")).first()
        passes, converged = passes + sum(s.passes for s in steps), converged and all(s.converged for s in steps)
        model = next(s.models[0] for s in steps if s.lam == top["lambda"])
        ranked = (top["cvm"], -top["lambda"], alpha)
        if best is None or ranked < best[0]:
            best = ranked, model
    (error, negative, alpha), sparse = best
    err_test, confusion = lasso.evaluated(lasso.PathModel(data, sparse))
    accuracy = cells.select("alpha", "lambda", (F.lit(1.0) - F.col("cvm")).alias("accuracy"), "cvsd")
    return GridFit(alpha, -negative, error, err_test, confusion, accuracy, passes, converged)
