"""Classification metrics, pseudo-labels, soft labels and paired model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SCORE_DEFAULT_MB, SCORE_MAX_MB, SCORE_WEIGHTS
from ..functions.vectors import argmax, confidence, ensemble_mean
from .ordered import scan


def class_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class of truth or prediction: support, predicted, tp, precision, recall, f1 (zero division is 0)."""
    by = list(by)
    c = df.groupBy(*by, F.col(truth).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    sides = F.array(
        F.struct(F.col("_y").alias("class"), F.col("_c").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_c").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    r = c.select(*by, F.inline(sides)).groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return r.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), focus: int = 3) -> DataFrame:
    """Macro scores over classes of truth or prediction, balanced accuracy over classes of truth.

    One counting aggregate, then arithmetic on class rows; all folds in one pass.
    """
    r = class_report(df, truth, pred, by)

    def of_focus(col):
        return F.coalesce(F.max(F.when(F.col("class") == focus, F.col(col))), F.lit(0.0))

    return r.groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        of_focus("precision").alias("precision_focus"), of_focus("recall").alias("recall_focus"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"),
    )


def confusion(df: DataFrame, truth: str, pred: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Rows per true class, one column per predicted class."""
    return df.groupBy(*by, truth).agg(*[F.count_if(F.col(pred) == c).alias(f"pred_{c}".replace("-", "m")) for c in classes])


def binary_metrics(df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and the 2 x 2 confusion for 0/1 classes (remap before or in the Columns)."""
    t, p = truth.cast("int"), pred.cast("int")
    r = df.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return r.withColumns(
        {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def pseudo_label(pred: DataFrame, prob: str, threshold: float) -> DataFrame:
    """Predictions whose confidence is strictly above the threshold, with their class."""
    out = pred.withColumns({"pseudo_label": argmax(F.col(prob)), "confidence": confidence(F.col(prob))})
    return out.where(F.col("confidence") > threshold)


def pseudo_label_report(pred: DataFrame, prob: str, threshold: float) -> DataFrame:
    """Kept and total windows per predicted class."""
    out = pred.withColumns({"pseudo_label": argmax(F.col(prob)), "_keep": confidence(F.col(prob)) > threshold})
    return out.groupBy("pseudo_label").agg(F.count_if("_keep").alias("kept"), F.count(F.lit(1)).alias("total"))


def add_pseudo_labels(labeled: DataFrame, accepted: DataFrame, label: str) -> DataFrame:
    """Labelled windows plus the accepted ones under their pseudo label."""
    extra = accepted.withColumn(label, F.col("pseudo_label").cast(labeled.schema[label].dataType))
    return labeled.withColumn("pseudo", F.lit(False)).unionByName(extra.select(*labeled.columns).withColumn("pseudo", F.lit(True)))


def soft_labels(df: DataFrame, probs: Sequence[str]) -> DataFrame:
    """Mean of the predictors' distributions as ``soft_label``."""
    return df.withColumn("soft_label", ensemble_mean(*[F.col(p) for p in probs]))


def soft_label_report(df: DataFrame, truth: str, probs: Sequence[str]) -> DataFrame:
    """Accuracy of each predictor and of the ensemble, and whether the ensemble beats the best one."""
    scored = soft_labels(df, probs)
    names = [*probs, "soft_label"]
    acc = scored.agg(*[F.avg((argmax(F.col(p)) == F.col(truth)).cast("double")).alias(f"acc_{p}") for p in names])
    best = F.greatest(*[F.col(f"acc_{p}") for p in probs]) if len(probs) > 1 else F.col(f"acc_{probs[0]}")
    return acc.withColumns({"best_single": best, "go": F.col("acc_soft_label") > best})


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """W+, W-, W, number of pairs and tie correction of the Wilcoxon signed-rank test.

    Ranks come from counts per distinct difference and a running sum, so ties and size do not matter. The tie correction grows with the
    cube of the counts: it is an exact decimal, since from 2 097 152 pairs on a long may not hold it.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    g = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("pos")).withColumn("_k", F.lit(1))
    g = scan(g, ["_k"], ["m"], {"cum": ("cumsum", "c")})
    rank = F.col("cum") - F.col("c") + (F.col("c") + 1) / 2.0
    c = F.col("c").cast("decimal(12,0)")  # a cube of it has 38 digits at most
    r = g.agg(
        F.sum(rank * F.col("pos")).alias("w_plus"), F.sum(rank * (F.col("c") - F.col("pos"))).alias("w_minus"), F.sum("c").alias("n"),
        F.sum((c * c).cast("decimal(24,0)") * c - F.col("c")).cast("decimal(38,0)").alias("ties"),
    )
    return r.withColumn("w", F.least("w_plus", "w_minus"))


def signed_rank_method(n: int, ties: float, method: str = "auto") -> str:
    """``exact`` or ``normal``; ``auto`` is the customary rule, exact for up to 50 untied pairs."""
    if method == "exact" and ties:
        raise ValueError("the exact distribution needs untied pairs")
    return ("exact" if n <= 50 and ties == 0 else "normal") if method == "auto" else method


def signed_rank_p(w: float, n: int, ties: float, method: str = "auto") -> float:
    """Two-sided p: ``exact`` counts all sign patterns of untied pairs, ``normal`` is the tie-corrected approximation."""
    if n == 0:
        return float("nan")
    if signed_rank_method(n, ties, method) == "exact":
        ways = [1]
        for k in range(1, n + 1):
            longer = [0] * (len(ways) + k)
            for i, x in enumerate(ways):
                longer[i] += x
                longer[i + k] += x
            ways = longer
        return min(1.0, 2.0 * sum(ways[: int(w) + 1]) / 2.0**n)
    mean = n * (n + 1) / 4.0
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return math.erfc(abs((w - mean) / sd) / math.sqrt(2.0)) if sd > 0 else 1.0


def wilcoxon(df: DataFrame, a: str, b: str, method: str = "auto") -> DataFrame:
    """Signed-rank statistics with a p-value and the method that gave it."""

    def add_p(batches):
        for pdf in batches:
            given = list(zip(pdf["w"].fillna(0.0), pdf["n"].fillna(0).astype(int), pdf["ties"].fillna(0)))
            p = [signed_rank_p(w, n, t, method) for w, n, t in given]
            yield pdf.assign(p=pd.Series(p, index=pdf.index, dtype="float64"), p_method=[signed_rank_method(n, t, method) for _, n, t in given])

    s = signed_ranks(df, a, b).select("w_plus", "w_minus", "n", F.col("ties").cast("double").alias("ties"), "w")
    return s.mapInPandas(add_p, "w_plus double, w_minus double, n long, ties double, w double, p double, p_method string")


def composite_score(f1: Column, std: Column, size_mb: Column) -> Column:
    """0.5 F1 + 0.3 smallness + 0.2 stability; an unknown size counts as the default."""
    w1, w2, w3 = SCORE_WEIGHTS
    small = F.greatest(F.lit(0.0), 1 - F.coalesce(size_mb, F.lit(SCORE_DEFAULT_MB)) / SCORE_MAX_MB)
    return F.round(w1 * f1 + w2 * small + w3 * F.greatest(F.lit(0.0), 1 - std), 3)


def grade(value: Column, kind: str) -> Column:
    """excellent / good / poor bucket of a score column."""
    # fixed values: thresholds per kind
    high, mid = {"f1": (0.8, 0.6), "score": (0.7, 0.5), "size": (10.0, 50.0)}[kind]
    if kind == "size":
        return F.when(value <= high, "excellent").when(value <= mid, "good").when(value.isNotNull(), "poor")
    return F.when(value >= high, "excellent").when(value >= mid, "good").when(value.isNotNull(), "poor")


def compare_models(summary: DataFrame, sizes: DataFrame, model: str = "model") -> DataFrame:
    """Fold summary (f1_mean, f1_std, f1_min, f1_max, n_folds) with size, composite score, rank and grades."""
    t = summary.join(sizes.select(model, "size_mb", "size_kb", "n_files"), model, "left")
    t = t.withColumns({"score": composite_score(F.col("f1_mean"), F.col("f1_std"), F.col("size_mb")), "n_files": F.coalesce("n_files", F.lit(0))})
    one = Window.partitionBy().orderBy(F.col("score").desc(), model)  # one row per model
    return t.withColumns(
        {
            "rank": F.row_number().over(one), "grade_f1": grade(F.col("f1_mean"), "f1"),
            "grade_size": grade(F.col("size_mb"), "size"), "grade_score": grade(F.col("score"), "score"),
        }
    )
