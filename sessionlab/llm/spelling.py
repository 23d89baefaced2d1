"""Spelling variants: near words by blocked Gram matrices of letter counts, and the frequent form each word leads to.

Words are counted in tasks, then dealt into buckets by length and by how many letters they have from each of GROUPS groups of the alphabet.
One inserted, deleted or replaced letter moves a word's letter counts by a squared distance of at most two, so it lies in the word's own
bucket or in one of a few buckets beside it. Blocks of such buckets meet in NumPy: one matrix product gives all squared distances of two
blocks, pairs at most two apart are kept and their edits verified letter by letter. Blocks hold at most about BLOCK words and BLOCK_BYTES letters;
a bucket of any size is cut into blocks, and only pairs of blocks travel.

Defined results: null and empty texts have no words; a null id is hashed as the text 'null'; repeated rows count again; an empty table
gives an empty result; other columns are not read. Words of any length take part; a word without near words has no form and is its own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlab.session import broadcast_if_small, cut_lineage

from .common import arrow_batch, slices, texts_of

LEAST, TIMES, RATIO = 7, 2, 10
GROUPS, BLOCK, BLOCK_BYTES = 6, 2048, 1 << 20
#: A task hands on its counts when it holds so many words or letters.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
#: Candidate pairs verified at a time.
VERIFIED = 1 << 16
_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def varied(run: str, doc: str, modulus: int = 31) -> str:
    """The run without one letter where the hash of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``least`` letters or more that occur ``times`` times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # runs too short to give a word need no hash; a run is taken whole, since the repetition is greedy and scanning starts at its first letter
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches):
        held, size = Counter(), 0
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                # lower() of bytes changes A-Z alone
                for run, n in Counter(runs.findall(text.lower().decode())).items():
                    word = varied(run, doc)
                    if len(word) >= least:
                        if word not in held:
                            size += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield arrow_batch(schema, [list(held), list(held.values())])
                    held, size = Counter(), 0
        if held:
            yield arrow_batch(schema, [list(held), list(held.values())])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The alphabet (at most 90 letters) dealt into groups that hold about equally many letters of the vocabulary."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    dealt, load = [""] * groups, [0] * groups
    for letter, n in sorted(letters, key=lambda x: (-x[1], x[0])):
        k = min(range(groups), key=load.__getitem__)
        dealt[k] += letter
        load[k] += n
    return dealt


def bucket_blocks(words: DataFrame, groups: list[str], block: int = BLOCK) -> DataFrame:
    """(sums, split, words, ns): the words of a bucket, cut into blocks; ``sums`` holds the letters from each group and names the bucket."""
    count = lambda g: (F.length("word") - F.length(F.translate("word", g, ""))).cast("int") if g else F.lit(0)
    keyed = words.select("word", "n", F.array(*map(count, groups)).alias("sums"))
    sizes = keyed.groupBy("sums").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("word")) / BLOCK_BYTES)).cast("int").alias("splits"))
    dealt = keyed.join(broadcast_if_small(cut_lineage(sizes)), "sums").withColumn("split", F.pmod(F.xxhash64("word"), "splits").cast("int"))
    return cut_lineage(dealt.groupBy("sums", "split").agg(F.collect_list(F.struct("word", "n")).alias("all")).select("sums", "split", F.col("all.word").alias("words"), F.col("all.n").alias("ns")))


def _beside(sums: Column, groups: int) -> Column:
    """Buckets that hold near words of this one's: one letter more, or one letter of another group, each pair of buckets named once."""
    moved = lambda up, down: F.transform(sums, lambda x, i: x + F.when(i == up, 1).when(i == down, -1).otherwise(0))
    longer = [moved(i, -1) for i in range(groups)]
    return F.array(sums, *longer, *[moved(i, j) for i in range(groups) for j in range(i)])


def block_pairs(blocks: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Rows (a_words, a_ns, b_words, b_ns, same): all pairs of blocks that can hold near words; b is as long as a or one letter longer."""
    names = blocks.select("sums", "split")
    beside = names.select(F.col("sums").alias("a_sums"), F.col("split").alias("a_split"), F.explode(_beside(F.col("sums"), groups)).alias("b_sums"))
    met = beside.join(names.select(F.col("sums").alias("b_sums"), F.col("split").alias("b_split")), "b_sums").where((F.col("a_sums") != F.col("b_sums")) | (F.col("a_split") <= F.col("b_split")))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    full = cut_lineage(met).join(side("b"), ["b_sums", "b_split"]).join(side("a"), ["a_sums", "a_split"])
    same = (F.col("a_sums") == F.col("b_sums")) & (F.col("a_split") == F.col("b_split"))
    # rows of one block follow each other, so that its partners meet it in one product
    return full.sortWithinPartitions("a_sums", "a_split").select("a_words", "a_ns", "b_words", "b_ns", same.alias("same"))


def letters_of(words: list[str]) -> np.ndarray:
    """(words, length) letters of words of one length; the alphabet fits one byte."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    rows = np.arange(len(letters), dtype=np.int64)[:, None] * 256
    return np.bincount((rows + letters).ravel(), minlength=256 * len(letters)).reshape(-1, 256)


def near_in_blocks(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the near pairs of two blocks of letters; b's words are as long as a's or one letter longer."""
    x, y = letter_counts(a), letter_counts(b)
    used = np.flatnonzero(x.any(axis=0) | y.any(axis=0))
    kind = np.float32 if b.shape[1] < 2000 else np.float64  # squared distances stay whole numbers
    x, y = x[:, used].astype(kind), y[:, used].astype(kind)
    # |x|^2 + |y|^2 - 2xy as one product: the squares stand in two columns of their own
    left = np.hstack([-2 * x, (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), kind)])
    right = np.hstack([y, np.ones((len(y), 1), kind), (y * y).sum(axis=1, keepdims=True)])
    gram = left @ right.T
    i, j = np.divmod(np.flatnonzero(gram.ravel() <= 2), len(b))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, min(VERIFIED, (64 << 20) // b.shape[1]))
    kept = [_one_edit(a[i[at : at + step]], b[j[at : at + step]]) for at in range(0, len(i), step)]
    keep = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each word of b is that of a with one letter replaced (equal lengths) or inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    first, last = a == b[:, :n], (a == b[:, 1:])[:, ::-1]
    ahead = np.where(first.all(axis=1), n, first.argmin(axis=1))
    behind = np.where(last.all(axis=1), n, last.argmin(axis=1))
    return ahead + behind >= n


def _partners(rows):
    """(a_words, a_ns, b_words, b_ns, same) of rows in order: partners of one block and one length are joined up to about BLOCK words."""
    held: dict[tuple[int, bool], tuple[list, list]] = {}
    words, ns = None, None
    for a_words, a_ns, b_words, b_ns, same in rows:
        if a_words != words:
            for (_, kind), (bw, bn) in held.items():
                yield words, ns, bw, bn, kind
            held, words, ns = {}, a_words, a_ns
        key = len(b_words[0]), same
        bw, bn = held.get(key, ([], []))
        if bw and (len(bw) + len(b_words) > BLOCK or (len(bw) + len(b_words)) * key[0] > BLOCK_BYTES):
            yield words, ns, bw, bn, same
            bw, bn = [], []
        held[key] = bw + b_words, bn + b_ns
    for (_, kind), (bw, bn) in held.items():
        yield words, ns, bw, bn, kind


def near_pairs(pairs: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every near pair of the paired blocks."""

    def run(batches):
        rows = (r for batch in slices(batches, 64) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[list] = [[], [], []]
        for a_words, a_ns, b_words, b_ns, same in _partners(rows):
            for i, j in zip(*[k.tolist() for k in near_in_blocks(letters_of(a_words), letters_of(b_words), same)], strict=True):
                out[0] += a_words[i], b_words[j]
                out[1] += b_words[j], a_words[i]
                out[2] += b_ns[j], a_ns[i]
            if len(out[0]) > VERIFIED or len(out[0]) * len(a_words[0]) > BLOCK_BYTES:
                yield arrow_batch(_PAIRS, out)
                out = [[], [], []]
        yield arrow_batch(_PAIRS, out)

    return pairs.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that each word with a form leads to.

    Every form is RATIO times as frequent as its word, so chains have at most 18 links and are followed in five rounds, each of which
    doubles the links a word has passed.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(now.join(broadcast_if_small(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return now


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, ratio: int = RATIO, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = cut_lineage(word_counts(docs, least, times, id_col, text_col))
    groups = letter_groups(words)
    found = near_pairs(block_pairs(bucket_blocks(words, groups, block), len(groups)))
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = cut_lineage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))
    has = F.col("near_n") >= ratio * F.col("n")
    formed = judged.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    out = formed.join(broadcast_if_small(roots(formed.where("form IS NOT NULL"))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
