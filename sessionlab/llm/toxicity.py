"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with borders) and itself, hashed to buckets; its vector is the mean of theirs, so unseen
misspellings share most of a known word's vectors. Word vectors are averaged over passages of PASSAGE words and a two-class softmax
scores the average, in which a repeated word counts once; a document scores as its worst passage, so that length doesn't dilute an insult. Embeddings and softmax are
learned together: first every passage carries its document's label, then only each document's worst passage does.

At scoring time the softmax is folded into the buckets, and a word costs one lookup of its remembered logit.

Defined results: null and empty texts score as an empty passage; repeated rows score alike; without labels of both classes all scores
are the share of toxic labels (0 without any).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_LENGTH, CACHE_WORDS, arrow_batch, crc32_mod, slices, smallest_hashes, texts_of, worker_cache

BUCKETS, DIM, PASSAGE, GRAMS = 1 << 16, 8, 8, (3, 4, 5)
#: Most labelled documents of each class that the model is fitted on.
TRAIN_PER_CLASS = 3_000


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the words, each gram's word number, and the number of grams of each word."""
    texts = [w.decode() for w in words]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    chars = np.frombuffer(("<" + "><".join(texts) + ">").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(texts)), sizes)
    room = ends[word] - np.arange(len(chars))  # characters from here to the word's end
    shift = np.uint64(48)
    ids, owners = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ chars[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        inside = room[: len(h)] >= n
        ids.append(((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64))
        owners.append(word[: len(h)][inside])
    # the whole word: a sum over its characters and places
    place = (np.arange(len(chars)) - (ends - sizes)[word]).astype(np.uint64) + np.uint64(1)
    mixed = (chars + np.uint64(7919)) * (place * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed, ends - sizes) * np.uint64(0x9E3779B97F4A7C15)
    ids.append((whole >> shift).astype(np.int64))
    owners.append(np.arange(len(texts)))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    return ids, owners, np.bincount(owners, minlength=len(texts))


class Model:
    """Logit of a passage: bias plus the passage's word logits over PASSAGE; a word's logit is the mean of its buckets' logits."""

    def __init__(self, bucket_logits: np.ndarray, bias: float):
        self.bucket_logits, self.bias = bucket_logits, bias

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        ids, owners, counts = gram_buckets(words)
        return np.bincount(owners, self.bucket_logits[ids], len(words)) / counts

    def score(self, texts: list[bytes], cache: dict) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        new = list({w for words in split for w in words if w not in cache})
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for words in split for w in words})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            cache.update(zip(some, self.word_logits(some).tolist(), strict=True))
        worst, logit = [0.0] * len(texts), cache.__getitem__
        for k, words in enumerate(split):
            if words:
                passages = (dict.fromkeys(words[at : at + PASSAGE]) for at in range(0, len(words), PASSAGE))
                worst[k] = max(sum(map(logit, p)) for p in passages) / PASSAGE
        for w in [w for w in new if len(w) > CACHE_LENGTH]:
            del cache[w]
        return 1 / (1 + np.exp(-np.clip(np.array(worst) + self.bias, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, steps: int = 340, rate: float = 0.5, batch: int = 128, seed: int = 5) -> Model:
    """Joint training with Adagrad in a fixed number of steps, a third of them on all passages; classes weigh the same."""
    if len(np.unique(y)) < 2:
        return Model(np.zeros(BUCKETS), float(np.clip(60 * (y.mean() if len(y) else 0) - 30, -30, 30)))
    rng = np.random.default_rng(seed)
    filled = np.array([i for i, t in enumerate(texts) if t.split()], dtype=np.int64)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full((BUCKETS, 1), 1e-12, dtype=np.float32), np.full((DIM, 2), 1e-12), np.full(2, 1e-12)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    while step < steps and len(filled):
        order = rng.permutation(filled)
        for at in range(0, len(order), batch)[: steps - step]:
            some, step = order[at : at + batch], step + 1
            split = [texts[i].lower().split() for i in some]
            number: dict[bytes, int] = {}
            tokens = np.array([number.setdefault(w, len(number)) for words in split for w in words])
            sizes = np.array([len(words) for words in split])
            ids, owners, counts = gram_buckets(list(number))
            vectors = np.stack([np.bincount(owners, table[ids, d], len(number)) for d in range(DIM)], axis=1) / counts[:, None]
            doc = np.repeat(np.arange(len(some)), sizes)
            inside = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = inside % PASSAGE == 0
            owner = doc[first]
            passage, tokens = np.divmod(np.unique((np.cumsum(first) - 1) * len(number) + tokens), len(number))  # a word counts once in a passage
            mean = np.add.reduceat(vectors[tokens], np.searchsorted(passage, np.arange(len(owner)))) / PASSAGE
            logits = mean @ soft + bias
            toxic = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -30, 30)))
            if step <= steps // 3:
                counted = 1 / np.bincount(owner)[owner]
            else:
                top = np.full(len(some), -1.0)
                np.maximum.at(top, owner, toxic)
                counted = (toxic == top[owner]).astype(float)
            slope = (toxic - y[some][owner]) * counted * weight[some][owner] / len(some)
            delta = np.stack([-slope, slope], axis=1)
            grad_soft, grad_bias = mean.T @ delta, delta.sum(axis=0)
            grad_mean = delta @ soft.T / PASSAGE
            grad_vector = np.stack([np.bincount(tokens, grad_mean[passage, d], len(number)) for d in range(DIM)], axis=1) / counts[:, None]
            grad_table = np.stack([np.bincount(ids, grad_vector[owners, d], BUCKETS) for d in range(DIM)], axis=1).astype(np.float32)
            seen_table += (grad_table**2).sum(axis=1, keepdims=True)
            seen_soft += grad_soft**2
            seen_bias += grad_bias**2
            table -= rate * grad_table / np.sqrt(seen_table)
            soft -= rate * grad_soft / np.sqrt(seen_soft)
            bias -= rate * grad_bias / np.sqrt(seen_bias)
    return Model(table.astype(float) @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, folds: int = 3, held_out: int = 1, label_col: str = "toxic") -> Model:
    """Model fitted on at most ``per_class`` documents of each label, those with the smallest id hashes outside the held-out fold.

    The sample is the only thing that reaches the driver; its bound is this parameter.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(crc32_mod(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [smallest_hashes(known.where(f"label = {k}"), ["doc_id"], per_class) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).select("text", "label").toArrow()
    return fit(texts_of(rows), np.array(rows.column("label").to_pylist(), dtype=float))


_WORKER: dict = {}


def score(docs: DataFrame, model: Model, threshold: float = 0.7, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    key = uuid.uuid4().hex
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                cache = worker_cache(_WORKER, key, dict)
                got = given.value.score(texts_of(b), cache)
                yield arrow_batch(schema, [b.column(0), b.column(1), got, (got >= threshold).astype(np.int32)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (crc32_mod(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
