"""Contingency tables, misclassification, and the rules that pick a lambda or a k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.schema import require_columns
from topicloom.stash import stash


def confusion_cells(rows: DataFrame) -> DataFrame:
    """``(pred, truth, n)`` of the pairs that occur; all that the rates below need, however many labels there are."""
    require_columns(rows, "pred", "truth", what="predictions")
    return rows.groupBy("pred", "truth").agg(F.count("*").alias("n"))


def confusion_table(rows: DataFrame, levels: list | None = None) -> DataFrame:
    """``(pred, truth, n)`` over the full square of levels, zero cells included.

    ``levels`` are the class labels; without them the levels are those of the rows, a null
    being a level of its own. The square is as large as the labels squared and is made block by block from the
    table of levels; for very many labels take ``confusion_cells``.
    """
    counts = confusion_cells(rows)
    if levels is None:
        sides = counts.select(F.explode(F.array("pred", "truth")).alias("v")).distinct()
    else:
        kind = rows.schema["truth"].dataType
        sides = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in levels])).alias("v"))
    numbers = stash(sides, "levels")
    square = numbers.select(F.col("v").alias("pred")).crossJoin(numbers.select(F.col("v").alias("truth")))
    cells = counts.select(F.col("pred").alias("cell_pred"), F.col("truth").alias("cell_truth"), F.col("n").alias("cell_n"))
    same = F.col("pred").eqNullSafe(F.col("cell_pred")) & F.col("truth").eqNullSafe(F.col("cell_truth"))
    return square.join(cells, same, "left").select(
        "pred", "truth", F.coalesce("cell_n", F.lit(0)).cast("long").alias("n")
    )


def misclassification(rows: DataFrame) -> DataFrame:
    """One row: number of rows, accuracy, and error = 1 - accuracy."""
    hit = F.avg((F.col("pred") == F.col("truth")).cast("double"))
    return rows.agg(
        F.count("*").alias("n"), hit.alias("accuracy"), (F.lit(1.0) - hit).alias("error")
    )


def class_stats(confusion: DataFrame) -> DataFrame:
    """Per-class rates from the cells of a confusion table, zero cells or not; one row per class."""
    n = F.col("n")
    side = F.explode(
        F.array(
            F.struct(F.col("truth").alias("label"), n.alias("actual"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("actual"), n.alias("predicted")),
        )
    )
    hit = F.when(F.col("pred").eqNullSafe(F.col("truth")), n).otherwise(0)
    # Each cell counts once for its truth and once for its prediction; hits only the first time.
    margins = (
        confusion.select(side.alias("s"), hit.alias("hit"))
        .groupBy("s.label")
        .agg(
            F.sum("s.actual").alias("actual"),
            F.sum("s.predicted").alias("predicted"),
            F.sum(F.when(F.col("s.actual") > 0, F.col("hit")).otherwise(0)).alias("hits"),
        )
    )
    by_class = margins.crossJoin(F.broadcast(confusion.agg(F.sum("n").alias("total"))))

    def ratio(above, below):
        return F.when(below != 0, above / below)

    hits, actual, predicted = F.col("hits"), F.col("actual"), F.col("predicted")
    others = F.col("total") - actual
    true_negatives = F.col("total") - actual - predicted + hits
    sensitivity = ratio(hits, actual)
    specificity = ratio(true_negatives, others)
    return by_class.select(
        "label",
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        ratio(hits, predicted).alias("pos_pred_value"),
        ratio(true_negatives, F.col("total") - predicted).alias("neg_pred_value"),
        ratio(actual, F.col("total")).alias("prevalence"),
        ratio(hits, F.col("total")).alias("detection_rate"),
        ratio(predicted, F.col("total")).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
    )


def overall_stats(confusion: DataFrame) -> DataFrame:
    """One row: n, accuracy, error, no-information rate, kappa."""
    n = F.col("n")
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("label"), n.alias("actual"), F.lit(0).alias("predicted")),
            F.struct(F.col("pred").alias("label"), F.lit(0).alias("actual"), n.alias("predicted")),
        )
    )
    hit = F.when(F.col("pred") == F.col("truth"), n).otherwise(0)
    margins = (
        confusion.select(sides.alias("s"))
        .groupBy("s.label")
        .agg(F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))
    )
    # Two one-row tables side by side.
    cells = confusion.agg(F.sum(n).alias("total"), F.sum(hit).alias("hits"))
    total = F.col("total").cast("double")
    observed = F.col("hits").cast("double") / total
    expected = F.col("products") / (total * total)
    sums = margins.agg(
        F.sum(F.col("actual").cast("double") * F.col("predicted").cast("double")).alias("products"),
        F.max("actual").alias("largest"),
    )
    return sums.crossJoin(cells).select(
        F.col("total").cast("long").alias("n"),
        observed.alias("accuracy"),
        (F.lit(1.0) - observed).alias("error"),
        (F.col("largest") / total).alias("no_information_rate"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"),
    )


def accuracy_by_lambda(rows: DataFrame) -> DataFrame:
    """``(lambda, accuracy)`` from one row per document and lambda."""
    require_columns(rows, "lambda", "pred", "truth", what="path predictions")
    return rows.groupBy("lambda").agg(
        F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy")
    )


def best_train_lambda(accuracy: DataFrame) -> DataFrame:
    """The row of highest accuracy; ties go to the larger lambda."""
    return accuracy.orderBy(F.desc("accuracy"), F.desc("lambda")).limit(1)


def cv_summary(errors: DataFrame) -> DataFrame:
    """``(lambda, cvm, cvsd)`` from ``(lambda, fold, error)``, with ``n`` as fold weight if given.

    cvm is the weighted mean over folds; cvsd the weighted deviation over the root of
    ``folds - 1``. With equal weights that is the sample standard error of the mean. Rows are
    first added up to one cell per lambda and fold, so a group holds as many cells as folds.
    """
    require_columns(errors, "lambda", "fold", "error", what="fold errors")
    weight = F.col("n").cast("double") if "n" in errors.columns else F.lit(1.0)
    w, e = F.col("w"), F.col("error")
    cells = (
        errors.select("lambda", "fold", "error", weight.alias("w"))
        .groupBy("lambda", "fold")
        .agg((F.sum(w * e) / F.sum(w)).alias("error"), F.sum(w).alias("w"))
    )
    sums = cells.groupBy("lambda").agg(
        (F.sum(w * e) / F.sum(w)).alias("cvm"),
        F.sum(w).alias("total"),
        F.count("*").alias("folds"),
        F.collect_list(F.struct("error", "w")).alias("cells"),
    )
    spread = F.aggregate(
        "cells",
        F.lit(0.0),
        lambda acc, c: acc + c["w"] * (c["error"] - F.col("cvm")) * (c["error"] - F.col("cvm")),
    )
    return sums.select(
        "lambda",
        "cvm",
        F.when(
            F.col("folds") > 1, F.sqrt(spread / F.col("total") / (F.col("folds") - 1))
        ).alias("cvsd"),
    )


def lambda_rules(summary: DataFrame) -> DataFrame:
    """One row ``(lambda_min, lambda_1se, cvm_min, cvsd_min)`` from ``cv_summary``.

    lambda_min has the lowest error, the larger one on ties. lambda_1se is the largest
    lambda whose error is within one standard error of it.
    """
    require_columns(summary, "lambda", "cvm", "cvsd", what="cv summary")
    # min over structs orders by error, then by the larger lambda. One row joins the path.
    best = summary.agg(F.min(F.struct("cvm", (-F.col("lambda")).alias("neg"), "cvsd")).alias("best"))
    limit = F.col("best.cvm") + F.coalesce(F.col("best.cvsd"), F.lit(0.0))
    within = F.max(F.when(F.col("cvm") <= limit, F.col("lambda")))
    return (
        summary.crossJoin(F.broadcast(best))
        .groupBy("best")
        .agg(within.alias("lambda_1se"))
        .select(
            (-F.col("best.neg")).alias("lambda_min"),
            "lambda_1se",
            F.col("best.cvm").alias("cvm_min"),
            F.col("best.cvsd").alias("cvsd_min"),
        )
    )


def best_k(sweep: DataFrame) -> DataFrame:
    """The first k with the lowest test error; a failed k (``error`` set) is skipped."""
    require_columns(sweep, "k", "e1_test", "error", what="sweep")
    usable = F.col("error").isNull() & F.col("e1_test").isNotNull()
    return sweep.where(usable).orderBy("e1_test", "k").limit(1)
