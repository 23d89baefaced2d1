"""Multi-class boosted trees: softmax gradients, distributed histograms, trees grown level by level.

Rows are binned once and packed into blocks. A level of all trees of a round is one job: each task sums gradients and curvatures of its blocks by
class, node, feature and bin; sums of the tasks meet by class, node and group of features, so what reaches the driver is as large as the
trees, not as the data. Only the smaller child of a split is summed; its sibling is the parent less the child. Models that leave
out different folds grow side by side in the same jobs, and the rows they leave out measure when to stop.

Null and NaN features count as larger than every number. Rows without a label or with a weight of zero never train.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .evaluate import metrics

BLOCK_ROWS = 16_384
#: Rounds after which the scores that blocks carry are written anew.
REFRESH = 10
#: Features whose sums travel in one row.
TOGETHER = 16
_BLOCK = "block bigint, n int, bins binary, label binary, weight binary, fold binary, margin binary"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "label", "weight", "fold", "margin")]])
_SUMS = "model int, cls int, node int, part int, sums binary"
_SUMS_ARROW = pa.schema([("model", pa.int32()), ("cls", pa.int32()), ("node", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
_TREE = "array<struct<cls: int, feature: array<int>, threshold: array<double>, value: array<double>>>"


@dataclass(frozen=True)
class Params:
    rounds: int = 50
    depth: int = 4
    learning_rate: float = 0.1
    min_rows: int = 5
    l1: float = 0.0
    l2: float = 1.0
    #: Shares of rows and of features that a round sees, drawn by hash.
    rows: float = 1.0
    features: float = 1.0
    bins: int = 64
    #: Rounds without a lower loss on the left-out rows after which a model stops; 0 never stops.
    patience: int = 0
    seed: int = 42


@dataclass
class Tree:
    """A full binary tree as arrays: children of node i are 2i + 1 and 2i + 2; a feature of -1 ends the way there."""

    cls: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, k: int, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(k, np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class Model:
    """Trees of one left-out fold (None: trained on all rows), with the bin edges that turn cuts into thresholds."""

    prior: np.ndarray
    edges: list[np.ndarray]
    left_out: int | None = None
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    stopped: bool = False

    def margins(self, bins: np.ndarray, start: int = 0, base: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.prior, (len(bins), 1)) if base is None else base.copy()
        for trees in self.trees[start:]:
            for t in trees:
                out[:, t.cls] += t.value[t.nodes(bins)]
        return out

    def best_rounds(self) -> int:
        """Rounds up to the lowest loss on left-out rows; all rounds if none was measured."""
        return int(np.argmin(self.losses)) if self.losses else len(self.trees)

    def scores(self, vec: Column) -> Column:
        """Array of class scores as JVM-side array functions over the trees."""
        trees = [
            {"cls": t.cls, "feature": t.feature.tolist(), "value": t.value.tolist(), "threshold": [float(self.edges[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut, strict=True)]}
            for round_ in self.trees[: self.best_rounds()] for t in round_
        ]
        prior = F.array(*[F.lit(float(x)) for x in self.prior])
        if not trees:
            return prior
        depth = int(np.log2(len(trees[0]["feature"]) + 1)) - 1
        listed = F.from_json(F.lit(json.dumps(trees)), _TREE)

        def end(t):
            x = lambda node: F.coalesce(F.get(vec, F.get(t["feature"], node)), F.lit(float("nan")))
            step = lambda node, _: F.when(F.get(t["feature"], node) < 0, node).when(x(node) <= F.get(t["threshold"], node), 2 * node + 1).otherwise(2 * node + 2)
            return F.get(t["value"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))

        leaves = F.transform(listed, lambda t: F.struct(t["cls"].alias("cls"), end(t).alias("value")))
        return F.transform(prior, lambda p, k: p + F.aggregate(F.filter(leaves, lambda x: x["cls"] == k), F.lit(0.0), lambda s, x: s + x["value"]))

    def predict(self, df: DataFrame, vec: str, classes: Sequence) -> DataFrame:
        """Columns ``probability`` (array) and ``prediction`` (the class, first on ties)."""
        raw = df.withColumn("_scores", self.scores(F.col(vec).cast("array<double>")))
        power = raw.withColumn("_scores", F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores"))))
        named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_scores", F.array_max("_scores")).cast("int"))
        share = F.transform("_scores", lambda s: s / F.aggregate("_scores", F.lit(0.0), lambda a, b: a + b))
        return power.withColumn("prediction", named).withColumn("probability", share).drop("_scores")


def bin_edges(df: DataFrame, vec: str, dim: int, bins: int) -> list[np.ndarray]:
    """Upper bounds of all bins but the last of every feature, by approximate quantiles (one aggregate with mergeable sketches)."""
    probs = [k / bins for k in range(1, bins)]
    x = F.col(vec).cast("array<double>")
    known = lambda i: F.when(~F.isnan(F.get(x, F.lit(i))), F.get(x, F.lit(i)))
    got = df.select(*[known(i).alias(f"f{i}") for i in range(dim)]).agg(*[F.percentile_approx(f"f{i}", probs, 20 * bins).alias(f"f{i}") for i in range(dim)]).first()
    return [np.unique(np.array(got[i] or [], dtype=float)) for i in range(dim)]


def binned_blocks(df: DataFrame, vec: str, label: str, classes: Sequence, edges: list[np.ndarray], weight: str | None = None, fold: str | None = None) -> DataFrame:
    """Blocks of binned rows, written once. ``fold`` must be an integer column."""
    dim = len(edges)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("x"), number.alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("long") if fold else F.lit(-1).cast("long")).alias("fold"), F.monotonically_increasing_id().alias("row"),
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                x = np.array([[np.nan if v is None else v for v in r] for r in b.column(0).to_pylist()], dtype=float).reshape(b.num_rows, dim)
                bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(dim)], axis=1).astype(np.uint8)
                cols = [bins, b.column(1).to_numpy().astype(np.int32), b.column(2).to_numpy(), b.column(3).to_numpy()]
                yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, (b.column(4)[0].as_py(), b.num_rows, *[np.ascontiguousarray(c).tobytes() for c in cols], b""), strict=True))], schema=_BLOCK_ARROW)

    return cut_lineage(rows.where("y >= 0").mapInArrow(run, _BLOCK))


def _opened(batches, dim: int) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            yield {
                **r, "bins": np.frombuffer(r["bins"], np.uint8).reshape(r["n"], dim), "label": np.frombuffer(r["label"], np.int32),
                "weight": np.frombuffer(r["weight"], float), "fold": np.frombuffer(r["fold"], np.int64),
            }


def _drawn(block: int, n: int, share: float, seed: int) -> np.ndarray:
    """The rows of a block that a round sees; the same whenever a task runs again."""
    return np.ones(n, dtype=bool) if share >= 1 else np.random.default_rng([seed, block & (2**63 - 1)]).random(n) < share


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted softmax gradients and curvatures, and the class shares."""
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hot = np.zeros_like(p)
    hot[np.arange(len(p)), label] = 1.0
    return weight[:, None] * (p - hot), weight[:, None] * p * (1 - p), p


def histogram_sums(blocks: DataFrame, models: list[Model], grow: dict, params: Params, start: int, loss: bool) -> dict:
    """Arrays (features, [gradient, curvature, rows], bins) of sums for every wanted (model, class, node), and the left-out loss of each model under (m, -1, 0).

    ``grow[m]`` holds (trees of this round so far, nodes wanted by class, features of this round); blocks carry scores of the first ``start`` rounds.
    """
    dim, bins = len(models[0].edges), params.bins
    width = len(models[0].prior)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in _opened(batches, dim):
            held = np.frombuffer(b["margin"], float).reshape(b["n"], len(models), width) if b["margin"] else None
            for m, (trees, wanted, features) in grow.items():
                model = models[m]
                margin = model.margins(b["bins"], start, None if held is None else held[:, m])
                g, h, p = gradients(margin, b["label"], b["weight"])
                out = np.zeros(b["n"], dtype=bool) if model.left_out is None else b["fold"] == model.left_out
                if loss and out.any():
                    cost = -b["weight"][out] * np.log(np.maximum(p[out, b["label"][out]], 1e-300))
                    key = (m, -1, 0, 0)
                    total[key] = total.get(key, 0) + np.array([cost.sum(), b["weight"][out].sum(), 0.0])
                seen = ~out & (b["weight"] > 0) & _drawn(b["block"], b["n"], params.rows, params.seed + len(model.trees))
                some = np.array(features, dtype=np.int64)
                code = b["bins"][:, some] + np.arange(len(some)) * bins if wanted else None
                for k, nodes in wanted.items():
                    at = trees[k].nodes(b["bins"])
                    for node in nodes:
                        rows = np.flatnonzero(seen & (at == node))
                        if not len(rows):
                            continue
                        flat, size = code[rows].ravel(), len(some) * bins
                        one = np.stack([np.bincount(flat, np.repeat(x[rows, k], len(some)), size) for x in (g, h)] + [np.bincount(flat, minlength=size)]).reshape(3, len(some), bins)
                        for c in range(0, len(some), TOGETHER):
                            key = (m, k, node, c)
                            total[key] = total.get(key, 0) + one[:, c : c + TOGETHER]
        yield _summed(total)

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total[tuple(key)] = total.get(tuple(key), 0) + np.frombuffer(value, float)
        yield _summed(total)

    keys = _SUMS_ARROW.names[:4]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one key meet in one task, which adds them as they come
    got = blocks.mapInArrow(run, _SUMS).repartition(parts, *keys).mapInArrow(add, _SUMS).collect()
    out: dict[tuple, np.ndarray] = {}
    for r in got:
        values = np.frombuffer(r.sums, float)
        if r.cls < 0:
            out[r.model, r.cls, r.node] = values
            continue
        features = len(grow[r.model][2])
        whole = out.setdefault((r.model, r.cls, r.node), np.zeros((features, 3, bins)))
        whole[r.part : r.part + TOGETHER] = values.reshape(3, -1, bins).swapaxes(0, 1)
    return out


def _summed(total: dict) -> pa.RecordBatch:
    keys = list(zip(*total, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array([np.ascontiguousarray(v, dtype=float).tobytes() for v in total.values()], pa.binary())], schema=_SUMS_ARROW)


def _leaf(g: float, h: float, params: Params) -> float:
    return -np.sign(g) * max(abs(g) - params.l1, 0.0) / (h + params.l2)


def best_split(sums: np.ndarray, params: Params) -> tuple[int, int, int] | None:
    """(place of the feature, cut, rows on the left) of the highest gain above zero from sums (features, 3, bins); the first feature, then cut, on ties."""
    score = lambda g, h: np.maximum(np.abs(g) - params.l1, 0.0) ** 2 / (h + params.l2)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2, keepdims=True)
    right = whole - left
    gain = score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(whole[:, 0], whole[:, 1])
    gain = np.where((left[:, 2] >= params.min_rows) & (right[:, 2] >= params.min_rows), np.round(gain, 11), -np.inf)
    place, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(place), int(cut), int(left[place, 2, cut])) if gain[place, cut] > 1e-9 else None


def _round(blocks: DataFrame, models: list[Model], active: list[int], params: Params, start: int) -> None:
    """Grow one tree a class for every active model; first measure the losses of the rounds so far."""
    dim, width = len(models[0].edges), len(models[0].prior)
    grow, known = {}, {}
    for m in active:
        rng = np.random.default_rng([params.seed, len(models[m].trees)])
        some = sorted(rng.permutation(dim)[: max(1, round(dim * params.features))].tolist())
        grow[m] = ([Tree.empty(k, params.depth) for k in range(width)], {k: [0] for k in range(width)}, some)
    siblings: dict[tuple, int] = {}
    for level in range(params.depth + 1):
        splitting = {(m, k, n) for m in active for k, nodes in grow[m][1].items() for n in nodes} | set(siblings)
        if not splitting:
            break
        if level < params.depth:
            got = histogram_sums(blocks, models, grow, params, start, loss=level == 0)
            if level == 0:
                for m in active:
                    if (m, -1, 0) in got:
                        cost, weight = got[m, -1, 0][:2]
                        models[m].losses.append(cost / weight)
            for m in active:
                zero = np.zeros((len(grow[m][2]), 3, params.bins))
                for k, nodes in grow[m][1].items():
                    for n in nodes:
                        known[m, k, n] = got.get((m, k, n), zero)
            for (m, k, n), small in siblings.items():
                known[m, k, n] = known[m, k, (n - 1) // 2] - known[m, k, small]
        wanted: dict[int, dict[int, list[int]]] = {m: {} for m in active}
        siblings = {}
        for m, k, n in sorted(splitting):
            tree = grow[m][0][k]
            if level == params.depth:
                continue
            sums = known[m, k, n]
            g, h, rows = sums[0].sum(axis=1)
            tree.value[n] = params.learning_rate * _leaf(g, h, params)
            split = best_split(sums, params)
            if split is None:
                continue
            f, c, left = split
            tree.feature[n], tree.cut[n] = grow[m][2][f], c
            below = sums[f, :, : c + 1].sum(axis=1)
            for child, (cg, ch) in ((2 * n + 1, below[:2]), (2 * n + 2, sums[f].sum(axis=1)[:2] - below[:2])):
                tree.value[child] = params.learning_rate * _leaf(cg, ch, params)
            small, large = (2 * n + 1, 2 * n + 2) if 2 * left <= rows else (2 * n + 2, 2 * n + 1)
            wanted[m].setdefault(k, []).append(small)
            siblings[m, k, large] = small
        for m in active:
            grow[m] = (grow[m][0], wanted[m], grow[m][2])
    for m in active:
        models[m].trees.append(grow[m][0])


def _carry(blocks: DataFrame, models: list[Model], start: int) -> DataFrame:
    """Blocks with the scores of all rounds so far."""
    dim, width = len(models[0].edges), len(models[0].prior)

    def run(batches):
        for batch in batches:
            for b, raw in zip(_opened([batch], dim), batch.to_pylist(), strict=True):
                held = np.frombuffer(b["margin"], float).reshape(b["n"], len(models), width) if b["margin"] else None
                margin = np.stack([m.margins(b["bins"], start, None if held is None else held[:, i]) for i, m in enumerate(models)], axis=1)
                yield pa.RecordBatch.from_pylist([{**raw, "margin": np.ascontiguousarray(margin).tobytes()}], schema=_BLOCK_ARROW)

    return cut_lineage(blocks.mapInArrow(run, _BLOCK))


def fit(
    df: DataFrame, vec: str, dim: int, label: str, classes: Sequence, params: Params = Params(), weight: str | None = None, fold: str | None = None,
    left_out: Sequence[int | None] = (None,),
) -> list[Model]:
    """One model for every entry of ``left_out``; a fold that a model leaves out doesn't train it and, with ``patience``, tells when it stops."""
    if not 2 <= params.bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    edges = bin_edges(df, vec, dim, params.bins)
    blocks = binned_blocks(df, vec, label, classes, edges, weight, fold)
    counted = df.where(F.col(label).isin(list(classes))).groupBy(F.col(label).alias("c"), (F.col(fold) if fold else F.lit(-1)).alias("f")).agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).collect()
    models = []
    for out in left_out:
        share = np.array([sum(r.w for r in counted if r.c == c and (out is None or r.f != out)) for c in classes], dtype=float) + 1e-9
        models.append(Model(np.log(share / share.sum()), edges, out))
    start = 0
    for done in range(params.rounds):
        active = [m for m, x in enumerate(models) if not x.stopped]
        if not active:
            break
        if done and done % REFRESH == 0:
            older, blocks = blocks, _carry(blocks, models, start)
            release(older)
            start = done
        _round(blocks, models, active, params, start)
        for m in active:
            x = models[m]
            # losses[r] belongs to the model after r rounds
            x.stopped = bool(params.patience and len(x.losses) > params.patience and np.argmin(x.losses) < len(x.losses) - params.patience)
    for m, x in enumerate(models):
        if x.left_out is not None and not x.stopped and params.patience:
            got = histogram_sums(blocks, models, {m: ([], {}, [])}, params, start, loss=True)
            if (m, -1, 0) in got:
                x.losses.append(got[m, -1, 0][0] / got[m, -1, 0][1])
        if not params.patience:
            x.losses = []
    release(blocks)
    return models


def root_histograms(df: DataFrame, vec: str, label: str, classes: Sequence, edges: list[np.ndarray]) -> DataFrame:
    """(cls, feature, bin, gradient, curvature, rows) of the first round with equal class shares, one row for every bin that holds rows."""
    spark = df.sparkSession
    bins = max(len(e) for e in edges) + 1
    params = replace(Params(), bins=bins)
    model = Model(np.zeros(len(classes)), edges)
    blocks = binned_blocks(df, vec, label, classes, edges)
    trees = [Tree.empty(k, 0) for k in range(len(classes))]
    got = histogram_sums(blocks, [model], {0: (trees, {k: [0] for k in range(len(classes))}, list(range(len(edges))))}, params, 0, False)
    release(blocks)
    rows = [(k, f, b, *map(float, v[f, :2, b]), int(v[f, 2, b])) for (_, k, _), v in sorted(got.items()) for f in range(len(edges)) for b in range(bins) if v[f, 2, b]]
    return spark.createDataFrame(rows, "cls int, feature int, bin int, gradient double, curvature double, rows long")


def feature_gains(model: Model, dim: int) -> list[int]:
    """How often the trees split by each feature."""
    used = [f for round_ in model.trees[: model.best_rounds()] for t in round_ for f in t.feature.tolist() if f >= 0]
    return np.bincount(np.array(used, dtype=int), minlength=dim).tolist()


def left_out_scores(
    df: DataFrame, vec: str, dim: int, label: str, classes: Sequence, fold: str, folds: Sequence[int], params: Params, weight: str | None = None
) -> DataFrame:
    """Scores of every fold by the model that leaves it out; all folds' models grow in the same jobs."""
    parts = []
    for model in fit(df, vec, dim, label, classes, params, weight, fold, list(folds)):
        test = df.where((F.col(fold) == F.lit(model.left_out)) & F.col(label).isNotNull())
        parts.append(model.predict(test, vec, classes).select(F.col(fold).cast("int").alias(fold), F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return metrics(out, "y", "p", [fold])
