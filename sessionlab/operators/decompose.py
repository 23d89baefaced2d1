"""Component contributions, multiple factor analysis, profile clustering and isolation forest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import categories, one_hot
from ..session import broadcast_if_small
from .linear import Components, as_unit_signs, covariance, pca
from .neighbours import as_vector
from .profile import participant_profile
from .scale import zscore
from .sets import rank_by, top_k


# ---------------------------------------------------------------- components
def top_loadings(loadings: DataFrame, k: int = 5, first: int = 5) -> DataFrame:
    """k variables with the largest absolute loading for each of the first components."""
    return top_k(loadings.where(F.col("component") <= first), ["component"], F.abs("loading"), k, ["variable"])


def contributions(loadings: DataFrame, first: int = 4) -> DataFrame:
    """Sum of squared loadings per variable over the first components, ranked."""
    c = loadings.where(F.col("component") <= first).groupBy("variable").agg(F.sum(F.col("loading") * F.col("loading")).alias("contribution"))
    return rank_by(c, F.col("contribution").desc(), ["variable"])


def best_per_component(loadings: DataFrame, first: int = 4) -> DataFrame:
    """Strongest variable of each component, in component order, without repeats."""
    best = loadings.where(F.col("component") <= first).groupBy("component").agg(F.max_by("variable", F.abs("loading")).alias("variable"))
    return best.groupBy("variable").agg(F.min("component").alias("component"))


# ---------------------------------------------------------------- multiple factor analysis
def mfa(df: DataFrame, groups: Mapping[str, tuple[str, Sequence[str]]], k: int | None = None) -> tuple[Components, DataFrame, dict[str, float]]:
    """Multiple factor analysis: (global components over group dimensions, group contributions in %, group weights).

    ``groups`` maps a name to ("quantitative", columns) or ("categorical", [column]).  Each group
    is standardised (or centred one-hot), decomposed, weighted by 1 over its first variance;
    the global decomposition then runs on the weighted group scores.  Because scores are an
    orthogonal rotation of the inputs, everything follows from covariance matrices; no
    score table is built.
    """
    spark = df.sparkSession
    work, blocks = df, []
    for name, (kind, cols) in groups.items():
        if kind == "categorical":
            values = categories(work, cols[0])
            work = one_hot(work, cols[0], values)
            blocks.append((name, kind, [f"{cols[0]}_{v}" for v in values]))
        else:
            blocks.append((name, kind, list(cols)))
    names = [c for _, _, cs in blocks for c in cs]
    _, cov, n = covariance(work.select(as_vector(names).alias("_v")), "_v", len(names))
    scale = np.ones(len(names))
    at = 0
    spans, rotation, dims, weights = {}, [], [], {}
    for name, kind, cs in blocks:
        idx = slice(at, at + len(cs))
        if kind != "categorical":
            sd = np.sqrt(np.diag(cov)[idx] * (n - 1) / n)  # population scale
            scale[idx] = np.where(sd > 0, sd, 1.0)
        sub = cov[idx, idx] / np.outer(scale[idx], scale[idx])
        values, vectors = np.linalg.eigh(sub)
        order = np.argsort(values)[::-1]
        keep = max(1, len(cs) - 1) if kind == "categorical" else len(cs)  # one-hot columns sum to one
        order = order[:keep]
        weights[name] = 1.0 / values[order[0]] if values[order[0]] > 0 else 1.0
        block = np.zeros((len(names), keep))
        block[idx] = as_unit_signs(vectors[:, order].T).T * np.sqrt(weights[name]) / scale[idx][:, None]
        rotation.append(block)
        spans[name] = (len(dims), len(dims) + keep)
        dims += [f"{name}_{i + 1}" for i in range(keep)]
        at += len(cs)
    r = np.hstack(rotation)
    whole = r.T @ cov @ r
    values, vectors = np.linalg.eigh(whole)
    order = np.argsort(values)[::-1][: k or len(dims)]
    loadings = as_unit_signs(vectors[:, order].T)
    variances = np.maximum(values[order], 0.0)
    comp = Components(dims, np.zeros(len(dims)), loadings, variances, variances / np.trace(whole))
    rows = []
    for i, line in enumerate(loadings):
        share = {g: float(np.sum(line[a:b] ** 2)) for g, (a, b) in spans.items()}
        rows += [(i + 1, g, 100.0 * s / sum(share.values())) for g, s in share.items()]
    return comp, spark.createDataFrame(rows, "component int, group string, percent double"), weights


# ---------------------------------------------------------------- clustering
def kmeans_profiles(
    df: DataFrame, participant: str, cols: Sequence[str], k: int = 2, seed: int = 42, n_init: int = 20
) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Cluster standardised participant profiles: (assignments, z-score profile per group, centres).

    Best of ``n_init`` seeded starts by cost; groups are named by their smallest participant so
    that names do not depend on the start.
    """
    prof = participant_profile(df, participant, cols)
    feats = [c for c in prof.columns if c != participant]
    scaled = zscore(prof, feats).select(participant, array_to_vector(as_vector(feats)).alias("features"), *feats).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(scaled) for i in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    scaled.unpersist()
    pred = best.transform(scaled)
    names = pred.groupBy("prediction").agg(F.min(participant).alias("_p"))
    names = names.withColumn("group", F.row_number().over(Window.partitionBy().orderBy("_p")))  # k rows
    named = pred.join(broadcast_if_small(names), "prediction")
    members = named.select(participant, "group", *feats)
    profile = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in feats])
    return members, profile, np.array(best.clusterCenters())


# ---------------------------------------------------------------- isolation forest
def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> list:
    """Flat preorder list of nodes (feature, threshold, right offset) or (-1, size, depth)."""
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    open_features = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or len(open_features) == 0:
        return [(-1, float(len(x)), depth)]
    f = int(rng.choice(open_features))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = _grow(x[x[:, f] < cut], rng, depth + 1, limit)
    right = _grow(x[x[:, f] >= cut], rng, depth + 1, limit)
    return [(f, cut, 1 + len(left)), *left, *right]


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    big = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _depths(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        f, v, extra = tree[node]
        if f < 0:
            out[rows] = extra + _mean_path(v)
            continue
        low = x[rows, f] < v
        stack.append((node + 1, rows[low]))
        stack.append((node + extra, rows[~low]))
    return out


def draw_limit(n: int, psi: int) -> int:
    """Largest 64-bit hash that is drawn so that about 1.5 psi of n rows are."""
    return min(2**63 - 1, -(2**63) + (2**64 * 3 * psi) // (2 * max(n, 1)))


def isolation_forest(df: DataFrame, id_col: str, vec: str, trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """Anomaly score in (0, 1) per row (id, score); higher is more isolated.

    Every tree sees the ``psi`` rows with the smallest hashes among about 1.5 psi drawn by the full 64-bit hash, so tree
    building is bounded work at any row count; the trees (trees x 2 psi nodes at most) are broadcast and rows
    are scored in Arrow batches.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    n = rows.count()
    limit = draw_limit(n, psi)
    hit = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col("id"), t, F.lit(seed)) <= F.lit(limit))
    drawn = rows.withColumn("tree", F.explode(hit))
    pick = Window.partitionBy("tree").orderBy(F.xxhash64("id", "tree"), "id")
    drawn = drawn.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= psi)  # the subsample is the method

    def grow(key, pdf):
        x = np.asarray(pdf.sort_values("id")["vec"].tolist(), dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), 0, int(np.ceil(np.log2(max(len(x), 2)))))
        a = np.array(nodes, dtype=float)
        return pd.DataFrame({"tree": [int(key[0])], "size": [len(x)], "nodes": [a.ravel().tolist()]})

    fitted = drawn.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes array<double>").collect()
    if n and len(fitted) < trees:
        raise RuntimeError(f"only {len(fitted)} of {trees} trees drew rows")
    forest = [[(int(f), v, int(e)) for f, v, e in np.array(r["nodes"]).reshape(-1, 3)] for r in sorted(fitted, key=lambda r: r["tree"])]
    norm = float(_mean_path(np.array([np.mean([r["size"] for r in fitted])]))[0]) or 1.0
    shared = spark.sparkContext.broadcast(forest)

    def score(batches):
        for pdf in batches:
            x = np.asarray(pdf["vec"].tolist(), dtype=float).reshape(len(pdf), -1)
            depth = np.mean([_depths(t, x) for t in shared.value], axis=0)
            yield pd.DataFrame({"id": pdf["id"], "score": np.power(2.0, -depth / norm)})

    return rows.mapInPandas(score, "id long, score double")


def flag_share(scores: DataFrame, contamination: float = 0.4) -> DataFrame:
    """Mark the most isolated share of rows (strictly above the exact score quantile)."""
    from .quantile import quantiles

    cut = quantiles(scores, ["score"], [1.0 - contamination]).first()
    return scores.withColumn("atypical", F.col("score") > F.lit(cut["q0"]))


def mean_decision(scores: DataFrame, members: DataFrame, by: Sequence[str], threshold: float = -0.05) -> DataFrame:
    """Mean decision value 0.5 - score per group and whether it is below the threshold."""
    d = scores.join(members, "id").groupBy(*by).agg(F.avg(0.5 - F.col("score")).alias("decision"))
    return d.withColumn("atypical", F.col("decision") < threshold)


__all__ = ["best_per_component", "contributions", "flag_share", "isolation_forest", "kmeans_profiles", "mean_decision", "mfa", "pca", "top_loadings"]
