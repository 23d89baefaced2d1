"""Probability-vector and state-vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import let

EPS = 1e-7


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(scores: Column) -> Column:
    def normalised(e):
        return let(total(e), lambda t: F.transform(e, lambda v: v / t))

    return let(F.array_max(scores), lambda top: let(F.transform(scores, lambda s: F.exp(s - top)), normalised))


def argmax(p: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p: Column) -> Column:
    return F.array_max(p)


def soften(p: Column, temperature: float, eps: float = EPS) -> Column:
    """Temperature-softened distribution."""
    powered = F.transform(p, lambda v: F.pow(F.greatest(F.lit(eps), F.least(v, F.lit(1.0))), F.lit(1.0 / temperature)))
    return let(powered, lambda q: let(total(q), lambda t: F.transform(q, lambda v: v / t)))


def clip01(p: Column, eps: float = EPS) -> Column:
    return F.transform(p, lambda v: F.greatest(F.lit(eps), F.least(v, F.lit(1.0))))


def cross_entropy(truth: Column, p: Column) -> Column:
    """Cross entropy of a predicted distribution against a class index."""
    return -F.log(F.get(clip01(p), truth))


def kl_divergence(teacher: Column, student: Column) -> Column:
    t, s = clip01(teacher), clip01(student)
    return total(F.zip_with(t, s, lambda a, b: a * F.log(a / b)))


def distillation_loss(truth: Column, student: Column, teacher: Column, alpha: float, temperature: float) -> Column:
    """alpha CE + (1 - alpha) T^2 KL between softened distributions."""
    kl = kl_divergence(soften(teacher, temperature), soften(student, temperature))
    return alpha * cross_entropy(truth, student) + (1 - alpha) * temperature * temperature * kl


def focal_loss(truth: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    pt = F.get(clip01(p), truth)
    return -alpha * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)


def ensemble_mean(*ps: Column) -> Column:
    out = ps[0]
    for p in ps[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return F.transform(out, lambda v: v / float(len(ps)))


def state_summary(states: Column, how: str = "last_mean_std", washout: int = 0) -> Column:
    """Summary of a sequence of state vectors: last, last+mean or last+mean+std (population)."""
    if how not in ("last", "last_mean", "last_mean_std"):
        raise ValueError(f"unknown summary: {how}")
    n = F.size(states)
    kept = F.when(n > washout, F.slice(states, washout + 1, F.greatest(n - washout, F.lit(1)))).otherwise(F.slice(states, -1, 1))

    def folded(kept_states, item):
        """Element-wise mean of ``item(vector)`` over the kept states, one pass."""
        zero = F.transform(F.element_at(kept_states, -1), lambda v: F.lit(0.0))
        sums = F.aggregate(kept_states, zero, lambda acc, v: F.zip_with(acc, item(v), lambda a, b: a + b))
        return F.transform(sums, lambda v: v / F.size(kept_states))

    def summary(k):
        last = F.element_at(k, -1)
        if how == "last":
            return last

        def with_mean(mean):
            if how == "last_mean":
                return F.concat(last, mean)
            spread = folded(k, lambda v: F.zip_with(v, mean, lambda a, b: (a - b) * (a - b)))
            return F.concat(last, mean, F.transform(spread, F.sqrt))

        return let(folded(k, lambda v: v), with_mean)

    return let(kept, summary)
