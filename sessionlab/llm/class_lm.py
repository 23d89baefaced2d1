"""Scoring texts with a class-based bigram model (exchange clustering of words into classes).

Texts become blocks: one row with the numbers of all its tokens in the block's own list of words. Only those lists, not the tokens, are
counted and joined with the corpus-wide counts, which come back to the block as arrays; so counts cover every word of every training
text and no table of words has to fit anywhere. Every text is split once.

The CLUSTERED most frequent words are spread over CLASSES classes by exchange: each pass counts, over all training tokens, the classes
left and right of each such word, and moves every word to the class that gains most mutual information (all words at once, against one
table that holds their own counts, so this is a batch form of the exchange). Meanwhile all other words have the class of their ending;
then each of them that occurs in training texts goes to its best class by the same gain, in Spark, from its counts summed over blocks.
Only unseen words keep the class of their ending; the end of a text has its own. A token's probability mixes class transition times emission with its
smoothed unigram; a class keeps one emission slot for unseen words, so probabilities over known words and the unseen one sum to one.

Defined results: null and empty texts are one end token; repeated rows are scored alike; without training texts every token has
probability one half over the unseen slot's share, as the base formula gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.session import cut_lineage, release

from .common import arrow_batch, crc32_mod, slices, texts_of

#: Tokens of a block (one long text may exceed it): larger blocks repeat fewer words in their lists; and tokens handled at a time.
BLOCK_TOKENS, STEP_TOKENS = 3_000_000, 250_000
#: Words that take part in the exchange, their classes, classes of endings, and passes over the corpus.
CLUSTERED, CLASSES, ENDINGS, PASSES = 16_384, 48, 48, 3
ALL_CLASSES, END_CLASS = CLASSES + ENDINGS + 1, CLASSES + ENDINGS
CHUNK = 512
#: Tasks whose matrices are added up first; so many rows of a chunk come together at a time.
NEIGHBOURS = 32
#: Weight of the class model against the unigram, and of a class's overall share against its transitions.
LAMBDA, BACKOFF = 0.8, 50.0


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed 32-bit, byte by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Numbers(dict):
    """Word to its number in a block, counted up as words appear."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of whole texts as rows: one with at = -1 holds doc_ids, held (by text), sizes and tokens; the others each hold one of its words.

    A word's row has its number in the block (at) and its count in the block's training texts (n). The end of a text is the empty word, number 0.
    """
    names = {"block": pa.int64(), "at": pa.int32(), "word": pa.string(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.binary(), "tokens": pa.binary()}
    schema = pa.schema(list(names.items()))

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        numbers, ids, held, tokens, total = Numbers({b"": 0}), [], [], [], 0

        def block():
            all_tokens, sizes, words = np.concatenate(tokens), np.array([len(t) for t in tokens]), list(numbers)
            counts = np.bincount(all_tokens[np.repeat(~np.array(held), sizes)], minlength=len(words))
            name = part << 32 | made
            yield arrow_batch(schema, [[name], [-1], [None], [None], [ids], [held], [packed(sizes)], [packed(all_tokens)]])
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                none = [None] * len(some)
                yield arrow_batch(schema, [np.full(len(some), name), np.arange(at, at + len(some)), [w.decode() for w in some], counts[at : at + len(some)], none, none, none, none])

        for b in slices(batches):
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True):
                words = text.lower().split()
                words.append(b"")
                tokens.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(doc_id)
                held.append(out)
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield from block()
                    made += 1
                    numbers, ids, held, tokens, total = Numbers({b"": 0}), [], [], [], 0
        if ids:
            yield from block()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (crc32_mod(F.col(id_col), folds) == held_out).alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "block bigint, at int, word string, n bigint, doc_ids array<bigint>, held array<boolean>, sizes binary, tokens binary")


class Corpus:
    """Coded blocks with each word's corpus count and class key (number among the clustered words, -1 - ending, or -1 - ENDINGS - class), and the totals."""

    def __init__(self, docs: DataFrame, folds: int = 5, held_out: int = 1, clustered: int = CLUSTERED, **columns):
        raw = cut_lineage(blocks(docs, folds, held_out, **columns), compression="zstd")  # held until the coded blocks are written
        entries = raw.where("at >= 0").select("block", "at", "word", "n")
        vocabulary = cut_lineage(entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("count")))
        totals = vocabulary.agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("count"))).alias("ends")).first()
        self.tokens, self.words = totals["n"] or 0, totals["v"]
        frequent = vocabulary.where("word <> ''").orderBy(F.col("count").desc(), "word").limit(clustered).collect()  # bounded by the model's size
        self.top_counts = np.array([r["count"] for r in frequent], dtype=np.int64)
        spark = docs.sparkSession
        top = spark.createDataFrame([(r["word"], k) for k, r in enumerate(frequent)], "word string, top int")
        ending = F.crc32(F.expr("right(word, 2)").cast("binary")) % ENDINGS
        known = vocabulary.join(F.broadcast(top), "word", "left")
        by_ending = known.where("top IS NULL AND word <> ''").groupBy(ending.cast("int").alias("e")).agg(F.count("*").alias("v"), F.sum("count").alias("n")).collect()
        self.class_words, self.class_tokens = np.zeros(ALL_CLASSES), np.zeros(ALL_CLASSES)  # of the fixed classes; exchange fills in the rest
        for r in by_ending:
            self.class_words[CLASSES + r["e"]], self.class_tokens[CLASSES + r["e"]] = r["v"], r["n"]
        self.class_words[END_CLASS], self.class_tokens[END_CLASS] = 1, totals["ends"] or 0
        key = F.coalesce("top", (-1 - ending).cast("int"))
        found = entries.select("block", "at", "word").join(known.select("word", "count", "top"), "word", "left")
        # count and key share a number, so that a word's row stays short on its way back to the block; its hash is made only here
        found = found.select("block", "at", F.xxhash64("word").alias("id"), (F.shiftleft(F.coalesce("count", F.lit(0)).cast("bigint"), 16) + key + ENDINGS).alias("value"))
        payload = raw.where("at < 0").select(F.col("block").alias("of"), "doc_ids", "held", "sizes", "tokens")
        ddl = "of bigint, doc_ids array<bigint>, held array<boolean>, sizes binary, tokens binary, counts binary, keys binary, ids binary"
        self.coded = cut_lineage(payload.groupBy("of").cogroup(found.groupBy("block")).applyInArrow(self._pack, ddl))
        release(raw, vocabulary)

    @staticmethod
    def _pack(payload: pa.Table, entries: pa.Table) -> pa.Table:
        """A block with the counts and keys of its words as arrays in the order of their numbers."""
        values = np.empty(entries.num_rows, dtype=np.int64)
        ids = np.empty(entries.num_rows, dtype=np.int64)
        at = entries.column("at").to_numpy()
        values[at], ids[at] = entries.column("value").to_numpy(), entries.column("id").to_numpy()
        counts, keys = values >> 16, (values & 0xFFFF) - ENDINGS
        out = payload.append_column("counts", pa.array([zstandard.compress(counts.tobytes(), 1)], pa.binary()))
        out = out.append_column("keys", pa.array([packed(keys)], pa.binary()))
        return out.append_column("ids", pa.array([zstandard.compress(ids.tobytes(), 1)], pa.binary()))

    def assign_rest(self, classes: np.ndarray, moves: np.ndarray) -> None:
        """Every training word that took no part in the exchange goes to its best class; keys and totals follow."""
        gain, width = gains(moves), 2 * ALL_CLASSES
        both = np.concatenate([gain[:, :CLASSES], gain[:CLASSES].T])
        schema = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("cells", pa.binary())])
        placed = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("class", pa.int32()), ("n", pa.int64())])

        def count(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    tokens, sizes, keys = (unpacked(batch.column(c)[k].as_py()) for c in (0, 1, 2))
                    counts, ids = (np.frombuffer(zstandard.decompress(batch.column(c)[k].as_py()), dtype=np.int64) for c in (4, 5))
                    train = np.repeat(~np.array(batch.column(3)[k].as_py(), dtype=bool), sizes)
                    rest = (keys < 0) & (counts > 0)
                    rest[0] = False
                    local = class_of(keys, classes).astype(np.int16)[tokens]
                    places = np.flatnonzero(train & rest[tokens])
                    left = np.where(places > 0, local[places - 1], END_CLASS)
                    right = local[places + 1] + ALL_CLASSES  # a text ends in its end, so a word has a neighbour there
                    own = tokens[places].astype(np.int64) * width
                    cells = np.sort(np.concatenate([own + left, own + right]))  # a byte for every neighbour, its class and side
                    words = np.flatnonzero(rest)
                    starts = np.searchsorted(cells, np.append(words, len(keys)).astype(np.int64) * width)
                    values = (cells % width).astype(np.uint8)
                    block = batch.column(6)[k].as_py()
                    for at in range(0, len(words), 20_000):
                        some = words[at : at + 20_000]
                        bounds = starts[at : at + len(some) + 1]
                        offsets = pa.py_buffer((bounds - bounds[0]).astype(np.int32))
                        lists = pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(values[bounds[0] : bounds[-1]])])
                        yield arrow_batch(schema, [ids[some], np.full(len(some), block), some, lists])

        def place(rows):
            ids = rows.column("id").to_numpy()
            lead = np.append(True, ids[1:] != ids[:-1])
            word = np.cumsum(lead) - 1
            cells = rows.column("cells").to_pylist()
            at = np.repeat(word, np.fromiter(map(len, cells), dtype=np.int64, count=len(cells))) * width + np.frombuffer(b"".join(cells), dtype=np.uint8)
            total = np.bincount(at, minlength=(word[-1] + 1) * width).reshape(-1, width)
            best = np.round(total @ both, 6).argmax(axis=1)
            n = np.where(lead, total[:, ALL_CLASSES:].sum(axis=1)[word], 0)  # every occurrence has one word on its right
            return arrow_batch(placed, [rows.column("block").to_numpy(), rows.column("at").to_numpy(), best[word], n])

        def choose(batches):
            waiting = None  # rows of the last word so far
            for batch in batches:
                for piece in slices([batch], 4096):
                    rows = pa.Table.from_batches([piece])
                    rows = rows if waiting is None else pa.concat_tables([waiting, rows])
                    cut = int(np.searchsorted(rows.column("id").to_numpy(), rows.column("id")[-1].as_py()))
                    if cut:
                        yield place(rows.slice(0, cut))
                    waiting = rows.slice(cut)
            if waiting is not None:
                yield place(waiting)

        def renew(payload: pa.Table, found: pa.Table) -> pa.Table:
            keys = unpacked(payload.column("keys")[0].as_py()).copy()
            keys[found.column("at").to_numpy()] = -1 - ENDINGS - found.column("class").to_numpy()
            return payload.set_column(payload.schema.get_field_index("keys"), "keys", pa.array([packed(keys)], pa.binary()))

        sent = self.coded.select("tokens", "sizes", "keys", "held", "counts", "ids", "of").mapInArrow(count, "id bigint, block bigint, at int, cells binary")
        found = sent.repartition("id").sortWithinPartitions("id").mapInArrow(choose, "block bigint, at int, class int, n bigint")
        found = cut_lineage(found)
        self.class_words[: CLASSES + ENDINGS] = self.class_tokens[: CLASSES + ENDINGS] = 0
        for r in found.where("n > 0").groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
            self.class_words[r["class"]], self.class_tokens[r["class"]] = r["v"], r["n"]
        older, self.coded = self.coded, cut_lineage(self.coded.groupBy("of").cogroup(found.select("block", "at", "class").groupBy("block")).applyInArrow(renew, self.coded.schema))
        release(older, found)


def class_of(keys: np.ndarray, classes: np.ndarray, end_at: int = 0) -> np.ndarray:
    """Classes of a block's words; its first word is the end."""
    out = np.where(keys >= 0, classes[np.maximum(keys, 0)] if len(classes) else 0, np.where(keys < -ENDINGS, -1 - ENDINGS - keys, CLASSES - 1 - keys))
    out[end_at] = END_CLASS
    return out


def context_counts(corpus: Corpus, classes: np.ndarray, by_word: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Over all training tokens: (clustered words, 2, classes) counts of the classes left and right (None unless by_word), and the class transitions.

    A task adds up its blocks in one matrix of the model's size and hands it on in chunks of words, which are summed in two steps: those of
    NEIGHBOURS tasks, then the sums.
    """
    count = len(corpus.top_counts) if by_word else 0
    chunks = -(-count // CHUNK)
    width = 2 * ALL_CLASSES

    def run(batches):
        cells, moves = np.zeros(max(count, 1) * width, dtype=np.int64), np.zeros(ALL_CLASSES**2, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, sizes, keys = (unpacked(batch.column(c)[k].as_py()) for c in (0, 1, 2))
                train = np.repeat(~np.array(batch.column(3)[k].as_py(), dtype=bool), sizes)
                local = class_of(keys, classes).astype(np.int16)[tokens]
                for at in range(0, len(tokens), STEP_TOKENS):
                    some = slice(at, at + STEP_TOKENS)
                    here, own, kept = local[some].astype(np.int64), keys[tokens[some]].astype(np.int64), train[some]
                    left = np.concatenate([[local[at - 1] if at else END_CLASS], here[:-1]])
                    right = np.concatenate([here[1:], local[at + STEP_TOKENS :][:1], [END_CLASS]])[: len(here)]
                    moves += np.bincount((left * ALL_CLASSES + here)[kept], minlength=len(moves))
                    if not count:
                        continue
                    word = kept & (own >= 0) & (tokens[some] > 0)
                    for side, classes_there in ((0, left), (ALL_CLASSES, right)):
                        cells += np.bincount(own[word] * width + side + classes_there[word], minlength=len(cells))
        if moves.any():
            task = TaskContext.get().partitionId() // NEIGHBOURS
            parts = [cells[c * CHUNK * width : (c + 1) * CHUNK * width] for c in range(chunks)]
            ids = list(range(chunks))
            yield pa.RecordBatch.from_arrays([pa.array([*ids, -1], pa.int32()), pa.array([task] * (chunks + 1), pa.int32()), pa.array([_cells(p) for p in [*parts, moves]], pa.binary())], names=["chunk", "salt", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_cells_back(x) for x in table.column("cells").to_pylist())
        return table.slice(0, 1).set_column(2, "cells", pa.array([_cells(total)], pa.binary()))

    ddl = "chunk int, salt int, cells binary"
    per_task = corpus.coded.select("tokens", "sizes", "keys", "held").mapInArrow(run, ddl)
    summed = per_task.groupBy("chunk", "salt").applyInArrow(add, ddl).groupBy("chunk").applyInArrow(add, ddl).toArrow()
    got = dict(zip(summed.column("chunk").to_pylist(), summed.column("cells").to_pylist(), strict=True))
    cells = np.concatenate([_cells_back(got[c]) if c in got else np.zeros(min(CHUNK, count - c * CHUNK) * width, dtype=np.int64) for c in range(chunks)]) if chunks else np.zeros(0)
    moves = _cells_back(got[-1]) if -1 in got else np.zeros(ALL_CLASSES**2, dtype=np.int64)
    return cells.reshape(count, 2, ALL_CLASSES) if by_word else None, moves.reshape(ALL_CLASSES, ALL_CLASSES)


def _cells(x: np.ndarray) -> bytes:
    """Numbers as compressed 64-bit, byte by byte plane: most planes of counts are empty."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _cells_back(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def gains(moves: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of each class before each class."""
    smooth = moves + 0.1
    left, right = smooth.sum(axis=1), smooth.sum(axis=0)
    return np.log(smooth * smooth.sum() / (left[:, None] * right[None, :]))


def exchange(corpus: Corpus, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the clustered words and the class transitions under them.

    The most frequent words begin in classes of their own, all others in the last; in each pass every word goes to the class with the
    largest gain in mutual information, given the classes around it.
    """
    classes = np.minimum(np.arange(len(corpus.top_counts)), CLASSES - 1)
    for _ in range(passes):
        cells, moves = context_counts(corpus, classes)
        gain = gains(moves)
        scores = cells[:, 0] @ gain[:, :CLASSES] + cells[:, 1] @ gain[:CLASSES].T
        classes = scores.argmax(axis=1) if len(scores) else classes
    return classes, context_counts(corpus, classes, by_word=False)[1]


class ClassModel:
    """Probabilities of the model: transitions between classes, and tokens and words of each class."""

    def __init__(self, corpus: Corpus, classes: np.ndarray, moves: np.ndarray):
        self.classes, self.tokens, self.words = classes, corpus.tokens, corpus.words
        class_tokens = corpus.class_tokens + np.bincount(classes, corpus.top_counts, ALL_CLASSES)
        class_words = corpus.class_words + np.bincount(classes, minlength=ALL_CLASSES)
        share = (class_tokens + 1) / (class_tokens.sum() + ALL_CLASSES)
        self.move = (moves + BACKOFF * share) / (moves.sum(axis=1, keepdims=True) + BACKOFF)
        self.emission_base = class_tokens + 0.5 * (class_words + 1)

    def block_scores(self, tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of every text of a block: unigram and model."""
        local = class_of(keys, self.classes).astype(np.int16)
        unigram = (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))
        emission = LAMBDA * (counts + 0.5) / self.emission_base[local]
        log_unigram, rest = np.log10(unigram), (1 - LAMBDA) * unigram
        base, own = np.zeros(len(sizes)), np.zeros(len(sizes))
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for at in range(0, len(tokens), STEP_TOKENS):
            some = slice(at, at + STEP_TOKENS)
            t, where = tokens[some], text[some]
            here = local[t]
            before = np.concatenate([[local[tokens[at - 1]] if at else END_CLASS], here[:-1]])
            mixed = np.log10(self.move[before, here] * emission[t] + rest[t])
            first = where[0]
            base[first : where[-1] + 1] += np.bincount(where - first, log_unigram[t])
            own[first : where[-1] + 1] += np.bincount(where - first, mixed)
        return base, own


def score(docs: DataFrame, folds: int = 5, held_out: int = 1, passes: int = PASSES, **columns) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    corpus = Corpus(docs, folds, held_out, **columns)
    classes, moves = exchange(corpus, passes)
    corpus.assign_rest(classes, moves)
    model = ClassModel(corpus, classes, context_counts(corpus, classes, by_word=False)[1])
    given = docs.sparkSession.sparkContext.broadcast(model)  # of the model's size, whatever the corpus
    names = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = pa.schema(list(names.items()))

    def run(batches):
        m = given.value
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, sizes, keys = (unpacked(batch.column(c)[k].as_py()) for c in (0, 1, 2))
                counts = np.frombuffer(zstandard.decompress(batch.column(5)[k].as_py()), dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                base, own = m.block_scores(tokens, sizes, counts, keys)
                known = np.add.reduceat((counts > 0)[tokens], starts, dtype=np.int64)
                columns = [batch.column(4)[k].as_py(), batch.column(3)[k].as_py(), sizes, known, np.full(len(sizes), m.tokens), base, own]
                yield arrow_batch(schema, columns)

    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return corpus.coded.select("tokens", "sizes", "keys", "held", "doc_ids", "counts").mapInArrow(run, ddl)
