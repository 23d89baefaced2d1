"""Distributed Gram sums and the small linear algebra done on them.

Partitions add up X'WX, X'WY and counts block by block; only d x d matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "cell int, s double"


def block_sums(df: DataFrame, vec: str, width: int, target: str | None = None, n_out: int = 0, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Upper part of [1 X Y]' W [1 X Y] as (by..., cell, s), one partial per partition, then one hash aggregate."""
    by = list(by)
    m = 1 + width + n_out
    if n_out:  # rows without one of the classes have no target
        df = df.where(F.col(target).between(0, n_out - 1))
    cols = [*by, F.col(vec).alias("_x"), (F.col(target) if target else F.lit(0)).cast("int").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")]
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*by).schema)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, part in groups:
                x = np.asarray(part["_x"].tolist(), dtype=np.float64).reshape(len(part), width)
                a = np.hstack([np.ones((len(part), 1)), x])
                if n_out:
                    a = np.hstack([a, np.eye(n_out)[part["_y"].to_numpy()]])
                g = a.T @ (a * part["_w"].to_numpy()[:, None])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + g
        for key, g in sums.items():
            out = pd.DataFrame({"cell": np.arange(m * m, dtype=np.int32), "s": g.ravel()})
            for i, name in enumerate(by):
                out.insert(i, name, key[i])
            yield out

    return df.select(*cols).mapInPandas(partial, types + _SCHEMA).groupBy(*by, "cell").agg(F.sum("s").alias("s"))


def collect_gram(sums: DataFrame, m: int) -> np.ndarray:
    """The m x m matrix of one group (fitted parameter)."""
    g = np.zeros(m * m)
    for r in sums.collect():
        g[r["cell"]] = r["s"]
    return g.reshape(m, m)


def as_unit_signs(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest-magnitude entry made positive."""
    pick = np.argmax(np.abs(vectors), axis=1)
    signs = np.sign(vectors[np.arange(len(vectors)), pick])
    return vectors * np.where(signs == 0, 1.0, signs)[:, None]


@dataclass
class Components:
    """Fitted principal components: names, centre, loadings (k x d), variances and ratios."""

    names: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray

    def ratio_rows(self, spark) -> DataFrame:
        cum = np.cumsum(self.ratios)
        rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(self.variances, self.ratios, cum))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")

    def loading_rows(self, spark) -> DataFrame:
        rows = [(i + 1, n, float(x)) for i, line in enumerate(self.loadings) for n, x in zip(self.names, line)]
        return spark.createDataFrame(rows, "component int, variable string, loading double")

    def scores(self, df: DataFrame, vec: str, out: str = "scores") -> DataFrame:
        """Centred projection of an array column, JVM-side, with loadings as literals."""
        parts = []
        for line in self.loadings:
            lit = F.array(*[F.lit(float(x)) for x in line])
            dot = F.aggregate(F.zip_with(F.col(vec), lit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            parts.append(dot - F.lit(float(line @ self.mean)))
        return df.withColumn(out, F.array(*parts))

    def project(self, centers: np.ndarray) -> np.ndarray:
        """Points (centroids) in component space."""
        return (np.asarray(centers) - self.mean) @ self.loadings.T


def covariance(df: DataFrame, vec: str, width: int, ddof: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, n); rows are shifted by a first mean so that sums stay well conditioned."""
    first = df.select(*[F.avg(F.get(vec, F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    shift = np.array([x or 0.0 for x in first])
    lit = F.array(*[F.lit(float(x)) for x in shift])
    g = collect_gram(block_sums(df.select(F.zip_with(F.col(vec), lit, lambda a, b: a - b).alias("_z")), "_z", width), 1 + width)
    n = g[0, 0]
    mu = g[0, 1:] / n
    cov = (g[1:, 1:] - n * np.outer(mu, mu)) / (n - ddof)
    return shift + mu, cov, n


def pca(df: DataFrame, vec: str, names: Sequence[str], k: int | None = None) -> Components:
    """Principal components of an array column; signs normalised."""
    names = list(names)
    mean, cov, _ = covariance(df, vec, len(names))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: k or len(names)]
    variances = np.maximum(values[order], 0.0)
    return Components(names, mean, as_unit_signs(vectors[:, order].T), variances, variances / max(np.trace(cov), 1e-300))
