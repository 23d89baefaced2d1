"""Linear read-outs on Gram sums, reservoir features, and grouped cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import metrics
from .linear import block_sums, collect_gram
from .ordered import scan
from .profile import with_class_weight


# ---------------------------------------------------------------- ridge read-out
def _solve(g: np.ndarray, width: int, alpha: float) -> np.ndarray:
    """(1 + d) x c weights from the Gram matrix of [1 X Y]; the intercept is not penalised."""
    a, b = g[: 1 + width, : 1 + width].copy(), g[: 1 + width, 1 + width :]
    a[1:, 1:] += alpha * np.eye(width)
    w = np.linalg.lstsq(a, b, rcond=None)[0] if np.linalg.matrix_rank(a) < len(a) else np.linalg.solve(a, b)
    if not np.all(np.isfinite(w)):
        raise FloatingPointError("read-out weights are not finite")
    return w


def _labelled(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Rows that carry one of the classes; -1 (unlabelled) and nulls never train."""
    return df.where(F.col(label).between(0, n_classes - 1))


def ridge_readout(df: DataFrame, vec: str, width: int, label: str, n_classes: int, alpha: float) -> np.ndarray:
    """Class-balanced multi-output ridge on one-hot targets; a row counts with its class weight."""
    weighted = with_class_weight(_labelled(df.select(vec, label), label, n_classes), label, "_cw")
    return _solve(collect_gram(block_sums(weighted, vec, width, label, n_classes, "_cw"), 1 + width + n_classes), width, alpha)


def forgetting_readout(
    df: DataFrame, vec: str, width: int, label: str, n_classes: int, alpha: float, forgetting: float, order: Sequence[str]
) -> np.ndarray:
    """Recursive-least-squares solution: the i-th of n rows counts with forgetting^(n - i)."""
    df = _labelled(df.select(vec, label, *order), label, n_classes)
    weighted = with_class_weight(df, label, "_cw").withColumn("_one", F.lit(1))
    r = scan(weighted, ["_one"], list(order), {"_i": ("rank",)})
    n = df.count()
    r = r.withColumn("_w", F.col("_cw") * F.pow(F.lit(forgetting), F.lit(n) - F.col("_i")))
    g = collect_gram(block_sums(r, vec, width, label, n_classes, "_w"), 1 + width + n_classes)
    return _solve(g, width, alpha * forgetting**n)


def predict_readout(df: DataFrame, vec: str, w: np.ndarray, out: str = "prediction") -> DataFrame:
    """Class of the largest linear score, JVM-side, first one on ties."""
    scores = []
    for c in range(w.shape[1]):
        lit = F.array(*[F.lit(float(x)) for x in w[1:, c]])
        scores.append(F.aggregate(F.zip_with(F.col(vec), lit, lambda a, b: a * b), F.lit(float(w[0, c])), lambda s, x: s + x))
    s = F.array(*scores)
    return df.withColumn(out, (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def loso_readout(df: DataFrame, fold: str, vec: str, width: int, label: str, n_classes: int, alpha: float) -> DataFrame:
    """Leave-one-fold-out predictions (df columns + prediction) of the ridge read-out, all folds from one pass.

    The Gram matrix of a training set is the total minus the fold's own, per class, so class weights
    also follow the training set.  Folds solve as small grouped tasks.
    """
    # per-class sums: class weights of a training set only rescale them
    sums = block_sums(_labelled(df, label, n_classes), vec, width, label, n_classes, None, [fold, label])
    m = 1 + width + n_classes
    total = sums.groupBy(label, "cell").agg(F.sum("s").alias("s")).collect()
    whole = np.zeros((n_classes, m * m))
    for r in total:
        whole[r[label], r["cell"]] += r["s"]
    shared = df.sparkSession.sparkContext.broadcast(whole)

    def fit(key, pdf):
        g = shared.value.copy()
        np.subtract.at(g, (pdf[label].to_numpy(), pdf["cell"].to_numpy()), pdf["s"].to_numpy())
        counts = g[:, 0]
        present = counts > 0.5
        weights = np.where(present, counts.sum() / (present.sum() * np.maximum(counts, 1.0)), 0.0)
        w = _solve(np.tensordot(weights, g, axes=1).reshape(m, m), width, alpha)
        return pd.DataFrame({fold: [key[0]], "_w": [w.T.ravel().tolist()]})

    ftype = df.schema[fold].dataType.simpleString()
    models = sums.groupBy(fold).applyInPandas(fit, f"{fold} {ftype}, _w array<double>")
    scored = df.join(models, fold)
    one = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda c: F.aggregate(
            F.zip_with(F.concat(F.array(F.lit(1.0)), F.col(vec)), F.slice("_w", c * (1 + width) + 1, F.lit(1 + width)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
        ),
    )
    out = scored.withColumn("_s", one)
    return out.withColumn("prediction", (F.array_position("_s", F.array_max("_s")) - 1).cast("int")).drop("_s", "_w")


# ---------------------------------------------------------------- reservoir features
def reservoir_weights(n_in: int, units: int, sparsity: float, radius: float, input_scaling: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded input weights and sparse recurrent weights with the given spectral radius."""
    rng = np.random.default_rng(seed)
    w_in = rng.choice([-1.0, 1.0], size=(units, n_in)) * input_scaling
    w = rng.uniform(-1, 1, size=(units, units)) * (rng.random((units, units)) >= sparsity)
    top = np.max(np.abs(np.linalg.eigvals(w)))
    return w_in, w * (radius / top) if top > 0 else w


def reservoir_features(
    df: DataFrame, seq: str, n_in: int, units: int = 50, leak: float = 0.3, sparsity: float = 0.9, radius: float = 0.9,
    input_scaling: float = 1.0, washout: int = 0, summary: str = "last_mean_std", seed: int = 42, out: str = "features",
) -> DataFrame:
    """Leaky tanh reservoir over each window's sequence of vectors and the summary of its states.

    Weights are broadcast; the recurrence runs for all windows of an Arrow batch at once.  For several
    sensors see ``sensor_reservoirs``.
    """
    shared = df.sparkSession.sparkContext.broadcast(reservoir_weights(n_in, units, sparsity, radius, input_scaling, seed))
    keep = [c for c in df.columns if c != seq]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", {out} array<double>"

    def run(batches):
        w_in, w = shared.value
        for pdf in batches:
            lengths = pdf[seq].map(len).to_numpy()
            result = np.empty(len(pdf), dtype=object)
            for t_len in np.unique(lengths):
                rows = np.flatnonzero(lengths == t_len)
                u = np.array([[list(v) for v in s] for s in pdf[seq].iloc[rows]], dtype=float).reshape(len(rows), t_len, n_in)
                x = np.zeros((len(rows), units))
                skip = washout if washout < t_len else t_len - 1
                total, square = np.zeros_like(x), np.zeros_like(x)
                for t in range(t_len):
                    x = (1 - leak) * x + leak * np.tanh(u[:, t] @ w_in.T + x @ w.T)
                    if t >= skip:
                        total, square = total + x, square + x * x
                n = t_len - skip
                mean = total / n
                parts = {"last": [x], "last_mean": [x, mean], "last_mean_std": [x, mean, np.sqrt(np.maximum(square / n - mean**2, 0.0))]}[summary]
                for i, line in zip(rows, np.hstack(parts)):
                    result[i] = line.tolist()
            yield pdf[keep].assign(**{out: list(result)})

    return df.select(*keep, seq).mapInPandas(run, schema)


def sensor_reservoirs(
    df: DataFrame, sensors: Mapping[str, int], units: int = 50, leak: float = 0.3, sparsity: float = 0.9, radius: float = 0.9, input_scaling: float = 1.0,
    washout: int = 0, summary: str = "last_mean_std", seed: int = 42, out: str = "features", cells: int = 1 << 21,
) -> DataFrame:
    """One reservoir a sensor, their summaries concatenated in the order of ``sensors`` (sequence column to number of inputs).

    Sensors run at their own rates, so their sequences differ in length; windows of like length share a padded batch of at most ``cells``
    values, in which a mask ends each window where its sequence ends. A sensor that a window lacks (null or empty) gives zeros and a 1
    in ``missing``. Sensor k has the weights of seed + k.
    """
    weights = [reservoir_weights(n, units, sparsity, radius, input_scaling, seed + k) for k, n in enumerate(sensors.values())]
    shared = df.sparkSession.sparkContext.broadcast(weights)
    keep = [c for c in df.columns if c not in sensors]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", {out} array<double>, missing array<int>"
    columns = list(sensors.items())

    def states(seqs: list, n_in: int, w_in: np.ndarray, w: np.ndarray) -> np.ndarray:
        lengths = np.array([len(s) for s in seqs])
        longest = int(lengths.max())
        u = np.zeros((len(seqs), longest, n_in))
        for k, s in enumerate(seqs):
            u[k, : len(s)] = np.array([list(v) for v in s], dtype=float)
        skip = np.where(washout < lengths, washout, lengths - 1)
        x = np.zeros((len(seqs), units))
        total, square = np.zeros_like(x), np.zeros_like(x)
        for t in range(longest):
            on = t < lengths
            x = np.where(on[:, None], (1 - leak) * x + leak * np.tanh(u[:, t] @ w_in.T + x @ w.T), x)
            counted = (on & (t >= skip))[:, None]
            total, square = total + counted * x, square + counted * x * x
        mean = total / (lengths - skip)[:, None]
        parts = {"last": [x], "last_mean": [x, mean], "last_mean_std": [x, mean, np.sqrt(np.maximum(square / (lengths - skip)[:, None] - mean**2, 0.0))]}[summary]
        return np.hstack(parts)

    def run(batches):
        width = units * {"last": 1, "last_mean": 2, "last_mean_std": 3}[summary]
        for pdf in batches:
            whole, missing = np.zeros((len(pdf), len(columns) * width)), np.ones((len(pdf), len(columns)), dtype=int)
            for k, (name, n_in) in enumerate(columns):
                seqs = pdf[name].tolist()
                there = sorted((i for i, s in enumerate(seqs) if s is not None and len(s)), key=lambda i: len(seqs[i]))
                missing[there, k] = 0
                at = 0
                while at < len(there):
                    to = at + 1
                    while to < len(there) and (to + 1 - at) * len(seqs[there[to]]) * (n_in + units) <= cells:
                        to += 1
                    some = there[at:to]
                    whole[some, k * width : (k + 1) * width] = states([seqs[i] for i in some], n_in, *shared.value[k])
                    at = to
            yield pdf[keep].assign(**{out: whole.tolist(), "missing": missing.tolist()})

    return df.select(*keep, *sensors).mapInPandas(run, schema)


# ---------------------------------------------------------------- tree models, cross-validation, tuning
class MacroF1(Evaluator):
    """Macro F1 over classes of truth or prediction (Spark's own f1 is weighted by support)."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        row = metrics(dataset.select(F.col(self.label).cast("int").alias("y"), F.col(self.prediction).cast("int").alias("p")), "y", "p").first()
        return float(row["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def with_features(df: DataFrame, vec: str, label: str, weight: bool = True) -> DataFrame:
    """Vector column ``features``, double ``label`` and balanced ``weight`` for pyspark.ml."""
    out = with_class_weight(df, label) if weight else df
    return out.withColumns({"features": array_to_vector(F.col(vec).cast("array<double>")), "label": F.col(label).cast("double")})


def boosted_trees(max_iter: int = 20, max_depth: int = 4, seed: int = 42) -> Estimator:
    """Multi-class boosted trees: one weighted binary model per class."""
    return OneVsRest(classifier=GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed), weightCol="weight", parallelism=4)


def random_forest(trees: int = 30, max_depth: int = 6, seed: int = 42) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed, weightCol="weight")


def loso_run(df: DataFrame, fold: str, folds: Sequence, fit: Callable[[DataFrame], object], parallelism: int = 4) -> DataFrame:
    """Fold scores of a model fitted without each fold; fits run as a bounded number of concurrent jobs.

    ``df`` holds window features prepared once for all folds; ``fit`` maps training rows to a
    fitted pyspark.ml model.
    """

    def one(value):
        model = fit(df.where(F.col(fold) != F.lit(value)))
        return model.transform(df.where(F.col(fold) == F.lit(value))).select(
            fold, F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")
        )

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return metrics(out, "y", "p", [fold])


def tune(df: DataFrame, estimator, grid: dict, fold: str, n_folds: int, parallelism: int = 4) -> tuple[object, list[float]]:
    """Grid search by mean macro F1 over left-out folds (``fold`` holds 0..n_folds-1)."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=MacroF1(), numFolds=n_folds, foldCol=fold, parallelism=parallelism)
    model = cv.fit(df)
    return model.bestModel, list(model.avgMetrics)


# ---------------------------------------------------------------- kernel tables
def kernel_vote(train_kernel: DataFrame, test_kernel: DataFrame, label: str, id_col: str) -> DataFrame:
    """Class of a test row: the class whose training rows have the most similar mean landmark kernel.

    Both tables come from ``joins.landmark_kernel`` with the same landmarks, so they are n x m.
    """
    means = train_kernel.select(label, F.posexplode("kernel").alias("i", "k")).groupBy(label, "i").agg(F.avg("k").alias("m"))
    t = test_kernel.select(id_col, F.posexplode("kernel").alias("i", "k")).join(F.broadcast(means), "i")
    d = t.groupBy(id_col, label).agg(F.sum((F.col("k") - F.col("m")) * (F.col("k") - F.col("m"))).alias("d"))
    return d.groupBy(id_col).agg(F.min_by(label, F.struct("d", label)).alias("prediction"))
