"""Leave-one-out evaluation of windows: balance, window, weight, fit, pseudo-label, refit, score."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PSEUDO_LABEL_MIN
from ..session import cut_lineage
from .balance import smote
from .evaluate import add_pseudo_labels, metrics, pseudo_label
from .neighbours import as_vector
from .readout import with_features
from .windows import window_stats


def balanced_rows(rows: DataFrame, keys: Sequence[str], id_col: str, time: str, signals: Sequence[str], label: str, unlabelled: int = -1) -> DataFrame:
    """Labelled rows with oversampled ones, told apart by ``_tie``; written once."""
    known = rows.where(F.col(label) != unlabelled)
    return cut_lineage(smote(known, keys, signals, label, id_col, time).withColumn("_tie", F.monotonically_increasing_id()))


def evaluation_windows(
    rows: DataFrame, keys: Sequence[str], id_col: str, time: str, signals: Sequence[str], label: str, size: int, step: int, unlabelled: int = -1,
    balanced: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, test, unlabelled) window statistics, each written once for all folds.

    Oversampling stays inside a session, so a training window never holds a row made from a left-out session; test windows come
    from the rows as they are.
    """
    known = rows.where(F.col(label) != unlabelled)
    balanced = balanced_rows(rows, keys, id_col, time, signals, label, unlabelled) if balanced is None else balanced
    train = window_stats(balanced, keys, [time, "_tie"], signals, size, step, label=label)
    test = window_stats(known, keys, [time, id_col], signals, size, step, label=label)
    open_rows = rows.where(F.col(label) == unlabelled)
    unknown = window_stats(open_rows, keys, [time, id_col], signals, size, step)
    return cut_lineage(train), cut_lineage(test), cut_lineage(unknown.withColumn(label, F.lit(None).cast(rows.schema[label].dataType)))


def scaled_windows(windows: DataFrame, scaler: dict[str, tuple[float, float]], features: Sequence[str]) -> DataFrame:
    """Window statistics as if the rows had been scaled before: (x - center) / scale, for deviations x / scale.

    ``features`` are named <signal>_<statistic>; a scaler is positive, so order statistics keep their rows.
    """
    out = {}
    for name in features:
        signal, stat = name.rsplit("_", 1)
        center, scale = scaler.get(signal, (0.0, 1.0))
        out[name] = F.col(name) / F.lit(scale) if stat == "std" else (F.col(name) - F.lit(center)) / F.lit(scale)
    return windows.withColumns(out)


def run_folds(
    windows: tuple[DataFrame, DataFrame, DataFrame], fold: str, folds: Sequence, features: Sequence[str], label: str, estimator,
    threshold: float = PSEUDO_LABEL_MIN, parallelism: int = 4, scalers: DataFrame | None = None, exclude_test_session: bool = False,
) -> DataFrame:
    """Per left-out fold: scores of the refitted model, with the numbers of training, test and pseudo-labelled windows.

    A fold is fitted on the balanced windows of the others with class weights; unlabelled windows whose top probability is above the
    threshold join under their predicted class, weights follow, and the model is fitted again. Folds without a test window
    are left out. ``scalers`` (fold, column, center, scale; see ``robust_fit_folds``) scale a fold's windows by what its training rows say.
    With ``exclude_test_session`` the unlabelled windows of the left-out fold don't become pseudo-labels.
    """
    # a scaler per fold and signal: of the evaluation's size, whatever the rows
    known = {} if scalers is None else {(r[fold], r["column"]): (r["center"], r["scale"]) for r in scalers.where(F.col(fold).isin(list(folds))).collect()}

    def one(value):
        own = {column: v for (of, column), v in known.items() if of == value}
        vectors = [scaled_windows(w, own, features) if own else w for w in windows]
        train_all, test_all, unknown = (w.withColumn("_v", as_vector(features)).select(fold, "_v", label) for w in vectors)
        train, test = train_all.where(F.col(fold) != F.lit(value)), test_all.where(F.col(fold) == F.lit(value))
        unknown = unknown.where(F.col(fold) != F.lit(value)) if exclude_test_session else unknown
        first = estimator.fit(with_features(train, "_v", label))
        guess = first.transform(with_features(unknown.withColumn(label, F.lit(0)), "_v", label, weight=False))
        accepted = pseudo_label(guess.withColumn("_p", vector_to_array("probability")), "_p", threshold)
        both = cut_lineage(add_pseudo_labels(train, accepted.select(fold, "_v", label, "pseudo_label"), label))
        model = estimator.fit(with_features(both, "_v", label))
        scored = model.transform(with_features(test, "_v", label, weight=False))
        scored = scored.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
        counts = both.agg(F.count_if(~F.col("pseudo")).alias("n_train"), F.count_if("pseudo").alias("n_pseudo")).first()
        score = metrics(scored, "y", "p").select("f1_macro", "balanced_accuracy", F.col("n").alias("n_test")).where("n_test > 0")
        sizes = [F.lit(counts[c]).alias(c) for c in ("n_train", "n_pseudo")]
        return score.select(F.lit(value).alias(fold), *sizes, "n_test", "f1_macro", "balanced_accuracy")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
