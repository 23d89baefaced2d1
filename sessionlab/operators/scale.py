"""Robust and standard scalers, also per sensor and per left-out session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .quantile import leave_one_out_quantiles, quantiles

QUARTILES = [0.25, 0.5, 0.75]


def _params(q: DataFrame, group: Sequence[str]) -> DataFrame:
    spread = F.col("q2") - F.col("q0")
    return q.select(*group, "column", F.col("q1").alias("center"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def robust_fit(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column (a zero range counts as 1); nulls are ignored."""
    rows = _params(quantiles(df, cols, QUARTILES, approximate=approximate), []).collect()
    return {r["column"]: (r["center"], r["scale"]) for r in rows}


def apply_scaler(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Fitted parameters become literals inside the projection."""
    return df.withColumns({c: (F.col(c) - center) / scale for c, (center, scale) in params.items()})


def robust_fit_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One scaler per group (sensor): (by..., column, center, scale)."""
    return _params(quantiles(df, cols, QUARTILES, by=by), by)


def robust_fit_folds(df: DataFrame, fold: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Scaler of the training rows of every left-out fold, all folds in one job."""
    return _params(leave_one_out_quantiles(df, fold, cols, QUARTILES), fold)


def apply_scaler_by(df: DataFrame, params: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Scale with parameters that differ per group."""
    wide = params.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, F.col(v))).alias(f"_{v}_{c}") for c in cols for v in ("center", "scale")]
    )
    out = df.join(broadcast_if_small(wide), list(by)).withColumns({c: (F.col(c) - F.col(f"_center_{c}")) / F.col(f"_scale_{c}") for c in cols})
    return out.drop(*[f"_{v}_{c}" for c in cols for v in ("center", "scale")])


def zscore_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation (0 counts as 1)."""
    r = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in cols if r[f"m_{c}"] is not None}


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scaler(df, zscore_fit(df, cols))


def leave_one_out_moments(df: DataFrame, fold: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and population std of the rows outside each fold by total minus fold (no fan-out)."""
    own = df.groupBy(*fold).agg(*[f.alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count(c)), ("m", F.avg(c)), ("v", F.var_pop(c)))])
    total = df.agg(*[f.alias(f"{n}_{c}_all") for c in cols for n, f in (("n", F.count(c)), ("m", F.avg(c)), ("v", F.var_pop(c)))])
    both = own.withColumn("_k", F.lit(1)).join(broadcast_if_small(total.withColumn("_k", F.lit(1))), "_k")
    out = list(fold)
    for c in cols:
        n, m, v = F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"v_{c}")
        big, mu, var = F.col(f"n_{c}_all"), F.col(f"m_{c}_all"), F.col(f"v_{c}_all")
        rest = big - n
        mean = (big * mu - n * m) / rest
        # second moments about the overall mean keep the subtraction well conditioned
        second = (big * var - n * (v + (m - mu) * (m - mu))) / rest
        out += [mean.alias(f"{c}_mean"), F.sqrt(F.greatest(F.lit(0.0), second - (mean - mu) * (mean - mu))).alias(f"{c}_std")]
    return both.select(*out)
