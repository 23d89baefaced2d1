"""Pulse and variability features of one window, as expressions over arrays of ordered values.

Every function takes and returns Columns; each guard value is part of its contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: guards and limits of the pulse features ---
EPS = 1e-6
RR_RANGE_MS = (300.0, 2000.0)
BPM_RANGE = (30.0, 220.0)
RATIO_RANGE = (0.1, 20.0)
SPO2_RANGE = (70.0, 100.0)
SKEW_LIMIT = 3.0


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``; a lambda would otherwise re-evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def var_pop(x: Column) -> Column:
    """Two-pass population variance of an array."""
    spread = let(mean(x), lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))))
    return F.when(F.size(x) > 0, spread / F.size(x))


def clip(x: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), x))


def diffs(x: Column) -> Column:
    """Differences of neighbours; empty for fewer than two values."""
    n = F.size(x)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(
        F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    )


def peak_candidates(x: Column, rise: float) -> Column:
    """0-based positions above both two-sided neighbours and above mean + rise (max - mean); none below 10 values."""

    def above(floor):
        def is_peak(i):
            v = F.get(x, i)
            return (
                (v >= floor) & (v > F.get(x, i - 1)) & (v > F.get(x, i + 1)) & (v > F.get(x, i - 2)) & (v > F.get(x, i + 2))
            )

        return F.filter(F.sequence(F.lit(2), F.greatest(F.size(x) - 3, F.lit(2))), is_peak)

    floor = let(mean(x), lambda m: m + rise * (F.array_max(x) - m))
    return F.when(F.size(x) >= 10, let(floor, above)).otherwise(F.array().cast("array<int>"))


def refractory(peaks: Column, min_gap: int) -> Column:
    """Keep a peak only if at least ``min_gap`` samples after the last kept one (one window, sequential)."""
    return F.aggregate(
        peaks,
        F.array().cast("array<int>"),
        lambda kept, i: F.when(
            (F.size(kept) == 0) | (i - F.element_at(kept, -1) >= min_gap), F.concat(kept, F.array(i))
        ).otherwise(kept),
    )


def rr_intervals(peaks: Column, hz: float) -> Column:
    """Peak distances in ms, only plausible ones."""
    lo, hi = RR_RANGE_MS
    return F.filter(F.transform(diffs(peaks), lambda d: d * F.lit(1000.0 / hz)), lambda d: (d >= lo) & (d <= hi))


def bpm(rr: Column) -> Column:
    return F.when(F.size(rr) < 2, F.lit(0.0)).otherwise(clip(60000.0 / mean(rr), BPM_RANGE))


def sdnn(rr: Column) -> Column:
    return F.when(F.size(rr) < 3, F.lit(0.0)).otherwise(F.sqrt(var_pop(rr)))


def rmssd(rr: Column) -> Column:
    return F.when(F.size(rr) < 2, F.lit(0.0)).otherwise(F.sqrt(total(F.transform(diffs(rr), lambda d: d * d)) / (F.size(rr) - 1)))


def pnn50(rr: Column) -> Column:
    big = F.size(F.filter(diffs(rr), lambda v: F.abs(v) > 50.0))
    return F.when(F.size(rr) < 2, F.lit(0.0)).otherwise(big / (F.size(rr) - 1) * 100.0)


def lf_hf(rr: Column, half: int = 3) -> Column:
    """Variance of the smoothed series over variance of the rest."""

    def around(v, i):
        start = F.greatest(i - half, F.lit(0))
        return let(F.slice(rr, start + 1, F.least(i + half + 1, F.size(rr)) - start), mean)

    def ratio(smooth):
        rest = let(F.zip_with(rr, smooth, lambda a, b: a - b), var_pop)
        return let(rest, lambda hf: F.when(hf < EPS, F.lit(2.0)).otherwise(clip(var_pop(smooth) / hf, RATIO_RANGE)))

    return F.when(F.size(rr) < 2 * half + 1, F.lit(1.0)).otherwise(let(F.transform(rr, around), ratio))


def amplitude(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.array_max(x) - F.array_min(x)).otherwise(F.lit(0.0))


def spo2(a: Column, b: Column) -> Column:
    """Oxygen saturation proxy 110 - 25 R from two light channels."""
    dc_a, dc_b, ac_a = mean(a), mean(b), amplitude(a)
    ratio = (amplitude(b) / F.nullif(dc_b, F.lit(0.0))) / F.nullif(ac_a / F.nullif(dc_a, F.lit(0.0)), F.lit(0.0))
    bad = (F.size(a) < 10) | (F.size(b) < 10) | (dc_a < EPS) | (dc_b < EPS) | (ac_a < EPS)
    return F.when(bad, F.lit(0.0)).otherwise(clip(110.0 - 25.0 * ratio, SPO2_RANGE))


def skewness(x: Column) -> Column:
    m3 = let(mean(x), lambda m: total(F.transform(x, lambda v: (v - m) * (v - m) * (v - m)))) / F.size(x)
    value = let(
        F.sqrt(var_pop(x)),
        lambda sd: F.when((F.size(x) < 3) | (sd < EPS), F.lit(0.0)).otherwise(clip(m3 / (sd * sd * sd), (-SKEW_LIMIT, SKEW_LIMIT))),
    )
    return value


def pulse_features(ir: Column, red: Column, hz: float, rise: float, min_gap: int) -> Column:
    """All pulse features of a window as one struct; the beat intervals are found once."""
    peaks = let(peak_candidates(ir, rise), lambda p: refractory(p, min_gap))

    def features(rr):
        return F.struct(
            bpm(rr).alias("bpm"), sdnn(rr).alias("sdnn"), rmssd(rr).alias("rmssd"), pnn50(rr).alias("pnn50"), lf_hf(rr).alias("lfhf"),
            spo2(ir, red).alias("spo2"), amplitude(ir).alias("amplitude"), skewness(ir).alias("skewness"),
        )

    return let(let(peaks, lambda p: rr_intervals(p, hz)), features)
