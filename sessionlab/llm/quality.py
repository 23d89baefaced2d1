"""Quality rules: fixed base rules, then boosted trees over document statistics.

The trees are grown in numpy on histograms, with monotonic constraints on chosen statistics, and flattened into node arrays: a batch of
documents walks all trees level by level as array lookups.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged alike; without usable labels (or
with one class only) the base rules decide alone; labels of one id that disagree count with the lower one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, arrow_batch, slices, smallest_hashes, texts_of, window_hashes

#: Statistics of a document with the sign of their effect on quality: -1 can only lower it, 0 is free.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": -1, "bar_share": -1, "distinct_share": 0, "words_per_line": 0, "stop_share": 0, "short_share": 0, "sentence_share": 0,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
DIGITS, UPPERS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Base counts and features of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, _count(text, SYMBOLS), 0, 0], [0.0] * len(FEATURES)
    chars = len(b"".join(words).decode())
    symbols = _count(text, SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    hashes = WORD_HASHES.of(words)
    repeated = 0
    if n >= 3:
        _, place, times = np.unique(window_hashes(hashes, 3), return_inverse=True, return_counts=True)
        again = times[place] > 1
        covered = np.zeros(n, dtype=bool)
        for j in range(3):
            covered[j : j + n - 2] |= again
        repeated = int(covered.sum())
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    features = [
        np.log1p(n), chars / n, symbols / n, dup_lines / len(lines), repeated / n, _count(text, UPPERS) / chars, _count(text, DIGITS) / chars,
        _count(text, b"!?") / n, text.count(b"|") / n, len(np.unique(hashes)) / n, n / len(lines), (sizes <= 3).sum() / n, (sizes <= 1).sum() / n, text.count(b".") / n,
    ]
    return [n, chars, symbols, dup_lines, repeated], [float(x) for x in features]


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


class Trees:
    """Boosted trees of one depth as node arrays: feature and border per inner node, value per leaf."""

    def __init__(self, feature: np.ndarray, border: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.border, self.leaf, self.start = feature, border, leaf, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        count, inner = self.feature.shape
        at = np.zeros((len(x), count), dtype=np.int64)
        tree = np.arange(count)
        row = np.arange(len(x))[:, None]
        while at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.border[tree, at])
        return self.start + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting. A split on a constrained feature must order its children's values, and the middle of both bounds all that grows below."""
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T, strict=True)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner = 2**depth - 1
    feature, border, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        value = lambda a, b: -a / (b + l2)
        node = np.zeros(len(y), dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = bounds[k]
            rows = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf, (low, high), (low, high))
            gs, hs = g[rows], h[rows]
            for f in range(x.shape[1]) if len(rows) else ():
                size = len(borders[f]) + 1
                gl, hl = (np.cumsum(np.bincount(binned[rows, f], w, size))[:-1] for w in (gs, hs))
                gr, hr = gs.sum() - gl, hs.sum() - hl
                vl, vr = np.clip(value(gl, hl), low, high), np.clip(value(gr, hr), low, high)
                gain = -(gl * vl + (hl + l2) * vl**2 / 2) - (gr * vr + (hr + l2) * vr**2 / 2)
                whole = np.clip(value(gs.sum(), hs.sum()), low, high)
                gain += gs.sum() * whole + (hs.sum() + l2) * whole**2 / 2
                gain[(hl < least) | (hr < least) | (signs[f] * (vr - vl) < 0)] = -1
                if len(gain) and gain[(j := int(gain.argmax()))] > best[0]:
                    mid = (vl[j] + vr[j]) / 2
                    sides = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[f])]
                    best = (gain[j], f, borders[f][j], *sides)
            _, feature[t, k], border[t, k], bounds[2 * k + 1], bounds[2 * k + 2] = best
            node[rows] = 2 * k + 1 + (x[rows, feature[t, k]] > border[t, k])
        for k in range(inner, 2 * inner + 1):
            rows = node == k
            leaf[t, k - inner] = rate * float(np.clip(value(g[rows].sum(), h[rows].sum()), *bounds[k]))
        margin += leaf[t, node - inner]
    return Trees(feature, border, leaf, start)


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in slices(batches):
            yield arrow_batch(schema, [b.column(0), [statistics(t)[1] for t in texts_of(b)]])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where=None, label_col: str = "quality") -> Trees | None:
    """Trees fitted on at most ``rows`` labelled documents, those whose ids have the smallest hashes; None without both classes."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(where) if where is not None else known
    known = smallest_hashes(known.groupBy("doc_id").agg(F.min("label").alias("label")), ["doc_id"], rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most ``rows`` ids are broadcast, so texts needn't travel
    found = features_of(texts.join(F.broadcast(known.select("doc_id")), "doc_id")).join(known, "doc_id").select("x", "label").orderBy(F.xxhash64("x"), "label").limit(rows).toArrow()
    y = found.column("label").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    x = np.array(found.column("x").to_pylist())
    return fit(x, y, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, model: Trees | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, score, kept) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in BASE], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
    ddl = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, score double, kept boolean"

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                failed, counts, score = _judged(texts_of(b), model)
                yield arrow_batch(schema, [b.column(0), *counts.T, failed, score, ~failed & (score >= threshold)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def _judged(texts: list[bytes], model: Trees | None):
    found = [statistics(t) for t in texts]
    counts, x = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    return base_failed(counts), counts, np.ones(len(x)) if model is None else model.score(x)


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: judged where they stand, without a join."""

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                failed, _, score = _judged(texts_of(b, text_col), model)
                yield b.filter(pa.array(~failed & (score >= threshold)))

    return docs.mapInArrow(run, docs.schema)
