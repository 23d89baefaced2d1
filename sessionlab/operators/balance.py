"""Minority oversampling by neighbour interpolation, and deterministic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .neighbours import as_vector, nearest
from .ordered import explode_range, scan
from .profile import median_step

MAX_K = 5


def hash_number(seed: int, *cols) -> Column:
    """Reproducible number in [0, 2^52) from a seed and keys; the same in every partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _unit(col: Column) -> Column:
    return col / F.lit(float(1 << 52))


def smote_plan(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by..., label, n, need, k): rows to add per class so that all reach the largest one.

    A session with one class, or a class of a single row, gets nothing.
    """
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("_max"), F.min("n").alias("_min"), F.count(F.lit(1)).alias("_classes"))
    plan = counts.join(top, list(by))
    usable = (F.col("_classes") >= 2) & (F.col("_min") >= 2)
    return plan.select(
        *by, label, "n", F.when(usable, F.col("_max") - F.col("n")).otherwise(F.lit(0)).alias("need"),
        F.least(F.lit(MAX_K), F.col("_min") - 1).alias("k"),
    )


def knn_within(df: DataFrame, by: Sequence[str], id_col: str, vec: str, k: int, **kw) -> DataFrame:
    """k nearest other rows inside each group: (by..., qid, nid, d2, rank)."""
    data = df.select(*by, F.col(id_col).alias("nid"), F.col(vec).alias("vec"))
    queries = df.select(*by, F.col(id_col).alias("qid"), F.col(vec).alias("vec"))
    return nearest(data, queries, by, k, skip_self=True, **kw)


def smote_vectors(df: DataFrame, by: Sequence[str], label: str, id_col: str, vec: str, seed: int = 42) -> DataFrame:
    """Synthetic rows (by..., label, i, vec, base id): base + u (neighbour - base), u in [0, 1).

    Base row, neighbour and u come from hashes of (seed, session, class, i).  Only base rows
    that were drawn look for neighbours.
    """
    by = list(by)
    cls = [*by, label]
    plan = smote_plan(df, by, label).where("need > 0")
    drawn = explode_range(plan, F.lit(0), F.col("need") - 1, "i")
    drawn = drawn.withColumns(
        {
            "_pos": F.pmod(hash_number(seed, *cls, "i", F.lit("base")), F.col("n")) + 1,
            "_pick": F.pmod(hash_number(seed, *cls, "i", F.lit("pick")), F.col("k")) + 1,
            "_u": _unit(hash_number(seed, *cls, "i", F.lit("u"))),
        }
    )
    ranked = scan(df.select(*cls, F.col(id_col).alias("_id"), F.col(vec).alias("_vec")), cls, ["_id"], {"_pos": ("rank",)})
    base = cut_lineage(drawn.join(ranked, [*cls, "_pos"]).select(*cls, "i", "_id", "_vec", "_pick", "_u"))  # asks for neighbours and meets them
    queries = base.select(*cls, F.col("_id").alias("qid"), F.col("_vec").alias("vec")).dropDuplicates([*cls, "qid"])
    data = df.select(*cls, F.col(id_col).alias("nid"), F.col(vec).alias("vec"))
    near = nearest(data, queries, cls, MAX_K, skip_self=True).select(*cls, F.col("qid").alias("_id"), "nid", F.col("rank").alias("_pick"))
    pairs = base.join(near, [*cls, "_id", "_pick"])
    other = data.select(*cls, "nid", F.col("vec").alias("_other"))
    out = pairs.join(other, [*cls, "nid"])
    u = F.col("_u")
    made = F.transform(F.arrays_zip(F.col("_vec").alias("a"), F.col("_other").alias("b")), lambda z: z["a"] + u * (z["b"] - z["a"]))
    return out.select(*cls, "i", made.alias(vec), F.col("_id").alias("base_id"), F.col("nid").alias("neighbour_id"))


def smote(
    df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, id_col: str, time: str, seed: int = 42
) -> DataFrame:
    """Balanced rows (by..., time, features, label): the originals plus synthetic minority rows.

    A synthetic row's stamp is that of the nearest real row of its session plus the session's
    median step.
    """
    by = list(by)
    v = df.withColumn("_fv", as_vector(features))
    made = cut_lineage(smote_vectors(v, by, label, id_col, "_fv", seed))
    sid = hash_number(seed, *by, label, "i").alias("qid")
    queries = made.select(*by, label, "i", sid, F.col("_fv").alias("vec"))
    data = v.select(*by, F.col(id_col).alias("nid"), F.col("_fv").alias("vec"))
    home = nearest(data, queries.select(*by, "qid", "vec"), by, 1).select(*by, "qid", "nid")
    stamps = v.select(*by, F.col(id_col).alias("nid"), F.col(time).alias("_t"))
    timed = queries.join(home, [*by, "qid"]).join(stamps, [*by, "nid"]).join(broadcast_if_small(median_step(df, by, time)), by)
    new = timed.select(
        *by, (F.col("_t") + F.col("median_step")).alias(time), *[F.col("vec")[i].alias(f) for i, f in enumerate(features)], label, F.lit(True).alias("synthetic")
    )
    return df.select(*by, time, *[F.col(f).cast("double").alias(f) for f in features], label, F.lit(False).alias("synthetic")).unionByName(new)


def nearest_row(synthetic: DataFrame, real: DataFrame, by: Sequence[str], id_col: str, vec: str) -> DataFrame:
    """Nearest real row of the same session for every synthetic row: (by..., qid, nid, d2)."""
    data = real.select(*by, F.col(id_col).alias("nid"), F.col(vec).alias("vec"))
    return nearest(data, synthetic.select(*by, F.col(id_col).alias("qid"), F.col(vec).alias("vec")), by, 1).drop("rank")


def cap_rows(df: DataFrame, by: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A sampling operator: at most ``n`` rows per class, chosen by hash; the rank limit applies before the shuffle."""
    w = Window.partitionBy(*by).orderBy(hash_number(seed, id_col), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def hash_rank(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int, name: str = "pos") -> DataFrame:
    """1-based place of every row in a seeded shuffle of its group."""
    keyed = df.withColumns({"_h": hash_number(seed, *ids), "_one": F.lit(1)})
    return scan(keyed, list(by) or ["_one"], ["_h", *ids], {name: ("rank",)}).drop("_h", "_one")


def split_sessions(df: DataFrame, keys: Sequence[str], frac: float, seed: int = 42) -> DataFrame:
    """Distinct sessions with ``part`` train/validation: the first int(frac n) of a seeded shuffle train."""
    s = hash_rank(df.select(*keys).distinct(), [], keys, seed)
    n = s.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    s = s.withColumn("_k", F.lit(1)).join(broadcast_if_small(n), "_k")
    return s.select(*keys, F.when(F.col("pos") <= F.floor(F.lit(frac) * F.col("_n")), "train").otherwise("validation").alias("part"))


def pick_validation(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` validation sessions per left-out session: its successors in a seeded cyclic order.

    Linear in the number of sessions; no fold looks at all others.
    """
    s = hash_rank(df.select(*keys).distinct(), [], keys, seed).withColumn("_k", F.lit(1))
    total = s.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    s = s.join(broadcast_if_small(total), "_k")
    folds = s.withColumn("slot", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("_n").cast("int") - 1)))).where("_n > 1")
    folds = folds.withColumn("_at", F.pmod(F.col("pos") - 1 + F.col("slot"), F.col("_n")) + 1)
    val = s.select(F.col("pos").alias("_at"), *[F.col(k).alias(f"val_{k}") for k in keys])
    return folds.join(val, "_at").select(*keys, "slot", *[f"val_{k}" for k in keys])


def stratified_split(df: DataFrame, by: Sequence[str], ids: Sequence[str], train: float = 0.7, valid: float = 0.2, seed: int = 42) -> DataFrame:
    """train/valid/test per class with truncated cut points."""
    s = hash_rank(df, by, ids, seed)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    s = s.join(broadcast_if_small(n), list(by))
    part = (
        F.when(F.col("pos") <= F.floor(F.col("_n") * F.lit(train)), "train")
        .when(F.col("pos") <= F.floor(F.col("_n") * F.lit(train + valid)), "valid")
        .otherwise("test")
    )
    return s.withColumn("part", part).drop("_n", "pos")
