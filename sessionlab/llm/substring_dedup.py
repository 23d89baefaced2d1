"""Repeated passages: MinHash banding of paragraphs, exact Jaccard verification, removals by components.

Passages are pasted into the middle of lines, so line breaks don't delimit what repeats. A paragraph here is a run of PARAGRAPH words
that begins at an anchor, the smallest shingle hash of some WINNOW shingles in a row. Whatever stands around it, a
run of WINNOW + PARAGRAPH - 1 words or more that two texts share holds a common anchor and its whole paragraph.

Each paragraph has BANDS keys, each of the smallest values of ROWS permutations over its shingles: two paragraphs of similarity s miss each
other with (1 - s ^ ROWS) ^ BANDS, 0.6 % at 0.8 and 0.03 % at 0.9; equal ones never miss. Three bands of one row miss 0.8 % at 0.8, and
pair every text with common lines of a dozen words. First keys are counted over documents; only documents with a key that another one
has are split again, and their colliding paragraphs are compared: equal contents are one class, classes are verified in full like documents.

Besides, each text has seeds, winnowed runs of SEED words, one in every run of PARAGRAPH words. Around a seed that two documents have, the
runs of PARAGRAPH words at every place are compared by content. So a verbatim repeat of PARAGRAPH words or more is always found, and
marked to its last word; so is an unchanged run of that length in an edited passage, which a passage of 50 words or more with a
5-word Jaccard of 0.8 always has. Changed words, and shorter unchanged runs beside them, are not marked.

Defined results: null texts and texts of fewer than PARAGRAPH words give nothing; rows equal in id and text are one document;
A-Z count as lower case; of equal passages the one in the smallest id (null last), then first in the text, stays.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.session import broadcast_if_small, cut_lineage, release

from .common import arrow_batch, mix64, slices, texts_of, window_hashes
from .near_dedup import bucket_members, link

WORDS, PARAGRAPH, WINNOW, BANDS, ROWS = 5, 25, 21, 5, 2
SHINGLES = PARAGRAPH - WORDS + 1
#: Words of a seed, and seeds in a row of which the smallest hash counts: a run of PARAGRAPH words holds them all.
SEED, SEED_WINNOW = 16, 10


#: Ranges of keys (by their first bits), of which a task takes one at a time, and rows that a task sorts at a time.
PARTS_BITS, PAIRS = 10, 1 << 18
REST = np.uint64(64 - PARTS_BITS)
RUNS = pa.schema([("part", pa.int32()), ("run", pa.binary())])


class Marks:
    """Shingle hashes, paragraphs and seeds of some texts, all worked out side by side; texts of fewer than PARAGRAPH words have none.

    Places count words from the first text on: ``text`` and ``start`` tell the text of a place and its first place, ``left`` the words from a place to its text's
    end. ``at``, ``keys`` are the paragraphs' places and keys by band, ``seed_at``, ``seed_keys`` those of the seeds.
    """

    def __init__(self, texts: pa.Array):
        words, counts = hashed_words(texts)
        long = counts >= PARAGRAPH
        words = words[np.repeat(long, counts)]
        counts = np.where(long, counts, 0)
        ends = np.cumsum(counts)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.start = ends - counts
        self.left = ends[self.text] - np.arange(len(words))
        if not len(words):
            self.h, self.at, self.seed_at = words, np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.keys, self.seed_keys = np.zeros((0, BANDS), np.uint64), words
            return
        self.h = window_hashes(words, WORDS)
        whole = self.left[: len(words) - PARAGRAPH + 1] >= PARAGRAPH  # runs of PARAGRAPH words that end inside their text
        at = places(lowest(self.h, WINNOW)[whole])
        at = at[self.left[at] >= PARAGRAPH]
        bare = (counts > 0) & (np.bincount(self.text[at], minlength=len(texts)) == 0)  # short texts whose anchors stand too near their ends
        self.at = np.sort(np.concatenate([at, self.start[bare]])) if bare.any() else at
        self.keys = np.empty((len(self.at), BANDS), dtype=np.uint64)
        value, spare = np.empty_like(self.h), np.empty_like(self.h)
        for band in range(BANDS):
            key = np.full(len(self.at), band, dtype=np.uint64)
            for row in range(ROWS):
                np.add(self.h, np.uint64(band * ROWS + row + 1), out=value)
                key = mix64(key + smallest(scramble(value, spare), spare, SHINGLES)[self.at])
            self.keys[:, band] = key
        n = len(words) - SEED + 1
        run = np.full(n, BANDS, dtype=np.uint64)
        for k in (*range(0, SEED - WORDS, WORDS), SEED - WORDS):
            run = mix64(run + self.h[k : k + n])
        self.seed_at = places(lowest(run, SEED_WINNOW)[whole])
        self.seed_keys = mix64(run[self.seed_at])

    def contents(self, at: np.ndarray) -> np.ndarray:
        """Hashes of all words of the paragraphs at these places."""
        weights = mix64(np.arange(1, SHINGLES + 1, dtype=np.uint64)) | np.uint64(1)
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(SHINGLES):
            total += self.h[at + k] * weights[k]
        return mix64(total).astype(np.int64)

    def around(self, seeds: np.ndarray) -> np.ndarray:
        """Places of the runs of PARAGRAPH words that hold a seed at one of these places."""
        first = self.start[self.text[seeds]]
        held = np.zeros(len(self.left), dtype=bool)
        for k in range(SEED_WINNOW):
            held[(seeds - k)[seeds - k >= first]] = True
        return np.flatnonzero(held & (self.left >= PARAGRAPH))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, A-Z in lower case, and how many words each has; only their distinct words become Python objects."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty words
    held = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, held.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(held.dictionary))
    return own[held.indices.to_numpy()][full], np.diff(np.concatenate([[0], np.cumsum(full)])[ends])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every run of ``width``."""
    at, low, held = np.arange(len(values)), values, 1
    while held < width:
        step = min(held, width - held)
        n = len(low) - step
        at = np.where(low[:n] <= low[step:], at[:n], at[step:])
        low = np.minimum(low[:n], low[step:])
        held += step
    return at


def smallest(values: np.ndarray, spare: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in every run of ``width``; both arrays are written over."""
    held = 1
    while held < width:
        step = min(held, width - held)
        n = len(values) - step
        np.minimum(values[:n], values[step:], out=spare[:n])
        values, spare, held = spare[:n], values[:n], held + step
    return values


def scramble(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``mix64`` in place."""
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint64(0x9E3779B97F4A7C15), out=x)
    np.right_shift(x, np.uint64(29), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def places(at: np.ndarray) -> np.ndarray:
    """Distinct values of an ascending array."""
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def paragraphs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of a text's paragraphs, their shingle hashes and their keys by band."""
    found = Marks(pa.array([text.decode()]))
    return found.at, found.h[found.at[:, None] + np.arange(SHINGLES)], found.keys


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, text): ``doc`` is a hash of id and text, the same wherever it is computed."""
    row = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return row.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")


def packed(keys: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(range, run): the distinct rows of a 64-bit key and other numbers, by range of keys.

    Keys are sorted; their steps go byte by byte, so that the high bytes, mostly zero, shrink in the shuffle.
    """
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in (keys, *columns)])])
    keys, columns = keys[new], [c[new] for c in columns]
    part = (keys >> REST).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[cuts] = keys[cuts] - (part[cuts].astype(np.uint64) << REST)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:7])
    ends = [*cuts[1:].tolist(), len(keys)]
    return part[cuts].tolist(), [b"".join([planes[:, a:b].tobytes(), *[c[a:b].tobytes() for c in columns]]) for a, b in zip(cuts.tolist(), ends)]


def unpacked(part: int, runs: list[bytes], *types: str) -> list[np.ndarray]:
    """Keys and other numbers of a range."""
    out = [[] for _ in range(1 + len(types))]
    sizes = [np.dtype(t).itemsize for t in types]
    for run in runs:
        n = len(run) // (7 + sum(sizes))
        steps = np.zeros((n, 8), dtype=np.uint8)
        steps[:, :7] = np.frombuffer(run, np.uint8, 7 * n).reshape(7, n).T
        out[0].append(np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + (np.uint64(part) << REST))
        at = 7 * n
        for column, t, size in zip(out[1:], types, sizes, strict=True):
            column.append(np.frombuffer(run, t, n, at))
            at += size * n
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, ("u8", *types), strict=True)]


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])) if len(columns[0]) else np.zeros(0, np.int64)


def in_parts(batches):
    """(range, its runs) of rows that come in order of ranges; where rows have a third column, that of a kind, its runs by kind."""
    now, held, kinds = None, {}, False
    for batch in batches:
        kinds = batch.num_columns > 2
        for part, run, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist() if kinds else repeat(0)):
            if part != now and held:
                yield now, held if kinds else held[0]
                held = {}
            now = part
            held.setdefault(kind, []).append(run)
    if held:
        yield now, held if kinds else held[0]


def by_part(runs: DataFrame) -> DataFrame:
    """Runs with all of a range in one task, range after range."""
    return runs.repartition("part").sortWithinPartitions("part")


def repeated_keys(docs: DataFrame) -> DataFrame:
    """(doc, keys): documents with the keys that some other document has, too, as bytes of 64-bit numbers.

    Keys travel as sorted runs of one range each, and a range is looked at as a whole, so there is no row a key.
    """
    wanted = pa.schema([("doc", pa.int64()), ("keys", pa.binary())])

    def split(batches):
        keys, whose, held = [], [], 0
        for b in slices(batches):
            found, own = Marks(b.column("text")), b.column(0).to_numpy()
            keys += [found.keys.ravel(), found.seed_keys]
            whose += [np.repeat(own[found.text[found.at]], BANDS), own[found.text[found.seed_at]]]
            held += len(keys[-1]) + len(keys[-2])
            if held >= PAIRS:
                yield arrow_batch(RUNS, list(packed(np.concatenate(keys), np.concatenate(whose))))
                keys, whose, held = [], [], 0
        if held:
            yield arrow_batch(RUNS, list(packed(np.concatenate(keys), np.concatenate(whose))))

    def shared(batches):
        keys, whose, held = [], [], 0
        for part, some in in_parts(batches):
            key, doc = unpacked(part, some, "i8")
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            starts = starts_of(key)
            hit = np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), np.diff(starts, append=len(key)))
            keys.append(key[hit])
            whose.append(doc[hit].view(np.uint64))
            held += len(keys[-1])
            if held >= 4 * PAIRS:
                yield arrow_batch(RUNS, list(packed(np.concatenate(whose), np.concatenate(keys))))
                keys, whose, held = [], [], 0
        if held:
            yield arrow_batch(RUNS, list(packed(np.concatenate(whose), np.concatenate(keys))))

    def by_doc(batches):
        for part, some in in_parts(batches):
            doc, key = unpacked(part, some, "u8")
            order = np.argsort(doc)
            doc, key = doc[order], key[order]
            cuts = starts_of(doc).tolist()
            yield arrow_batch(wanted, [doc[cuts].view(np.int64), [key[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(key)])]])

    split_keys = docs.select("doc", "text").mapInArrow(split, "part int, run binary")
    return by_part(by_part(split_keys).mapInArrow(shared, "part int, run binary")).mapInArrow(by_doc, "doc bigint, keys binary")


def colliding(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paragraphs with a wanted key, and the runs around wanted seeds, by ``content``, a hash of all their words.

    All of them are in runs (part, run) by ranges of contents, with document, place and id (PLACED). Those with a wanted key come as rows (content, doc, at, keys), too.
    Rows that are one document give their paragraphs as often as they come.
    """
    schema = pa.schema([*RUNS, ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def runs(held):
        part, run = packed(*map(np.concatenate, zip(*held)))
        none = [None] * len(part)
        return arrow_batch(schema, [part, run, none, none, none, none])

    def run(batches):
        held, n = [], 0
        for b in slices(batches):
            found, asked = Marks(b.column("text")), [np.frombuffer(some, np.uint64) for some in b.column("keys").to_pylist()]
            hit, seed = np.zeros(found.keys.shape, dtype=bool), np.zeros(len(found.seed_at), dtype=bool)
            own, seeds_own = (np.searchsorted(found.text[x], np.arange(len(asked) + 1)) for x in (found.at, found.seed_at))
            for k, some in enumerate(asked):
                hit[own[k] : own[k + 1]] = np.isin(found.keys[own[k] : own[k + 1]], some)
                seed[seeds_own[k] : seeds_own[k + 1]] = np.isin(found.seed_keys[seeds_own[k] : seeds_own[k + 1]], some)
            keyed = hit.any(axis=1)
            at = found.at[keyed]
            every = np.union1d(at, found.around(found.seed_at[seed]))
            text, contents = found.text[every], found.contents(every)
            place = every - found.start[text]
            doc, doc_id = b.column("doc").to_numpy()[text], b.column("doc_id")
            none = doc_id.is_null().to_numpy(zero_copy_only=False)[text]
            held.append((contents.view(np.uint64), doc, place.astype(np.int32), doc_id.fill_null(0).to_numpy()[text], none))
            n += len(every)
            if len(at):
                k = np.searchsorted(every, at)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *hit[keyed].sum(axis=1)]).astype(np.int32)), pa.array(found.keys[keyed][hit[keyed]].view(np.int64)))
                empty = [pa.nulls(len(at), t) for t in RUNS.types]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(contents[k]), pa.array(doc[k]), pa.array(place[k]), lists], schema=schema)
            if n >= PAIRS:
                yield runs(held)
                held, n = [], 0
        if n:
            yield runs(held)

    found = docs.join(broadcast_if_small(wanted), "doc").select("doc", "doc_id", "keys", "text")
    return found.mapInArrow(run, "part int, run binary, content bigint, doc bigint, at bigint, keys array<bigint>")


def paragraph_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of wanted paragraphs (node, doc, at)."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            words, counts = hashed_words(b.column("text"))
            some = b.column("some")
            first = np.repeat(np.cumsum(counts) - counts, pc.list_value_length(some).to_numpy())
            wanted = some.flatten()
            if not len(wanted):
                continue
            hashes = np.sort(window_hashes(words, WORDS)[(first + wanted.field("at").to_numpy())[:, None] + np.arange(SHINGLES)].view(np.int64), axis=1)
            new = np.ones(hashes.shape, dtype=bool)
            new[:, 1:] = hashes[:, 1:] != hashes[:, :-1]
            sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *new.sum(axis=1)]).astype(np.int32)), pa.array(hashes[new]))
            yield pa.RecordBatch.from_arrays([wanted.field("node"), sets], schema=schema)

    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("node", "at")).alias("some"))
    found = docs.join(broadcast_if_small(cut_lineage(per_doc)), "doc").select("doc", "some", "text").dropDuplicates(["doc"])  # here, since rows are dealt by document
    return found.select("some", "text").mapInArrow(run, "node bigint, hashes array<bigint>")


#: What runs hold beside their keys: a paragraph's document, place, id and whether that is null; by document, also the id of the kept one and whether the paragraph goes.
PLACED = ("i8", "i4", "i8", "?")
MARKED = ("i4", "i8", "?", "i8", "?", "?")


def repeats(placed: DataFrame) -> DataFrame:
    """Runs (part, run) by document, MARKED, of paragraphs whose content another document has, too, but not those with a label.

    ``placed`` are runs (part, run, kind) of contents, kind 0 PLACED, kind 1 the contents with a label and their components.
    """

    def run(batches):
        held, n = [], 0
        for content, doc, at, doc_id, none, labels, _ in by_content(batches):
            starts = starts_of(content)
            if not len(starts):
                continue
            first = np.repeat(starts, np.diff(starts, append=len(content)))
            low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            keep = np.repeat((low < high) & ~np.isin(content[starts], labels), np.diff(starts, append=len(content)))
            first = first[keep]
            removed = (doc[keep] != doc[first]) | (at[keep] != at[first])
            held.append((doc[keep].view(np.uint64), at[keep], doc_id[keep], none[keep], doc_id[first], none[first], removed))
            n += len(first)
            if n >= 4 * PAIRS:
                yield arrow_batch(RUNS, list(packed(*map(np.concatenate, zip(*held)))))
                held, n = [], 0
        if n:
            yield arrow_batch(RUNS, list(packed(*map(np.concatenate, zip(*held)))))

    return placed.mapInArrow(run, "part int, run binary")


def labelled(placed: DataFrame) -> DataFrame:
    """(component, doc, doc_id, at) of the paragraphs whose content has a label; ``placed`` as ``repeats`` takes it."""
    schema = pa.schema([("component", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for content, doc, at, doc_id, none, labels, components in by_content(batches):
            if len(labels) and len(content):
                k = np.minimum(np.searchsorted(labels, content), len(labels) - 1)
                hit = labels[k] == content
                yield arrow_batch(schema, [components[k][hit], doc[hit], pa.array(doc_id[hit], mask=none[hit]), at[hit]])

    return placed.mapInArrow(run, "component bigint, doc bigint, doc_id bigint, at bigint")


def by_content(batches):
    """Contents of a range with document, place and id, in their order, the contents with a label and their components."""
    for part, some in in_parts(batches):
        content, doc, at, doc_id, none = unpacked(part, some.get(0, []), *PLACED)
        order = np.lexsort((at, doc, doc_id, none, content))
        labels, components = unpacked(part, some.get(1, []), "i8")
        by_label = np.argsort(labels)
        yield *(c[order] for c in (content, doc, at, doc_id, none)), labels[by_label], components[by_label]


def in_runs(rows: DataFrame, names: list[str], key: str) -> DataFrame:
    """Runs (part, run) of rows by ``key``, with these columns of 64-bit numbers, places (``at``) or flags; where a number is null it is 0."""
    kinds = {c: "i4" if c == "at" else "?" if rows.schema[c].dataType.typeName() == "boolean" else "i8" for c in names}

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield arrow_batch(RUNS, list(packed(b.column(key).to_numpy().view(np.uint64), *[b.column(c).to_numpy(zero_copy_only=False).astype(kinds[c]) for c in names])))

    return rows.select(key, *names).fillna(0).mapInArrow(run, "part int, run binary")


def spans_of(marked: DataFrame) -> DataFrame:
    """(doc_id, doc, first_word, n_words, removed, kept_doc_id): maximal runs of repeated paragraphs, from runs by document, MARKED."""
    types = [("doc_id", pa.int64()), ("doc", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("removed", pa.bool_()), ("kept_doc_id", pa.int64())]
    schema = pa.schema(types)

    def run(batches):
        for part, some in in_parts(batches):
            doc, at, doc_id, none, kept, kept_none, removed = unpacked(part, some, *MARKED)
            order = np.lexsort((at, removed, doc))
            doc, at, doc_id, none, kept, kept_none, removed = (c[order] for c in (doc, at.astype(np.int64), doc_id, none, kept, kept_none, removed))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1]) | (at[1:] > at[:-1] + PARAGRAPH)])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(at)) - 1
            least = np.minimum.reduceat(np.where(kept_none, np.iinfo(np.int64).max, kept), starts)
            yield arrow_batch(schema, [
                pa.array(doc_id[starts], mask=none[starts]), doc[starts].view(np.int64), at[starts], at[ends] + PARAGRAPH - at[starts], removed[starts],
                pa.array(least, mask=np.logical_and.reduceat(kept_none, starts)),
            ])

    return by_part(marked).mapInArrow(run, "doc_id bigint, doc bigint, first_word bigint, n_words bigint, removed boolean, kept_doc_id bigint")


def repeated_passages(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, first_word, n_words, removed, kept_doc_id): maximal runs of repeated paragraphs of every document.

    Where a run's paragraphs all have an earlier occurrence it is removed; the earliest occurrences come out too, with removed = false.
    """
    given = identified(docs, id_col, text_col)
    wanted = cut_lineage(repeated_keys(given))
    found = cut_lineage(colliding(given, wanted))
    release(wanted)
    # a content's keys are the same wherever it stands
    contents = cut_lineage(found.where("keys IS NOT NULL").groupBy("content").agg(F.min(F.struct("doc", "at")).alias("first"), F.first("keys").alias("keys")))
    members = bucket_members(contents.select(F.col("content").alias("node"), F.explode("keys").alias("key"), F.lit(SHINGLES).alias("n")))
    wanted = members.select("node").distinct().join(contents, F.col("node") == F.col("content")).select("node", "first.doc", "first.at")
    sets = cut_lineage(paragraph_sets(given, wanted))
    bucketed = cut_lineage(members.drop("n").join(sets.select("node", F.size("hashes").alias("n")), "node"))
    release(contents, members)
    labels = link(bucketed, sets, percent)
    release(bucketed, sets)
    # contents with a label are few and joined by component; of all others, equal ones are a component of their own
    runs = found.where("run IS NOT NULL").select("part", "run", F.lit(0).alias("kind"))
    placed = by_part(runs.unionAll(cut_lineage(in_runs(labels, ["component"], "node")).withColumn("kind", F.lit(1))))
    some = labelled(placed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "at")
    per = some.groupBy("component").agg(F.min(order).alias("first"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    marked = some.join(per, "component").withColumn("removed", order != F.col("first")).withColumn("kept_doc_id", F.col("first.doc_id"))
    marked = marked.withColumn("none", F.col("doc_id").isNull()).withColumn("kept_none", F.col("kept_doc_id").isNull())
    return spans_of(repeats(placed).unionAll(in_runs(marked, ["at", "doc_id", "none", "kept_doc_id", "kept_none", "removed"], "doc")))


def without_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, text): the changed documents without their removed runs; words are joined by a space where a run went."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in slices(batches):
            texts = []
            for spans, text in zip(b.column(1).to_pylist(), texts_of(b), strict=True):
                words, kept, done = text.split(), [], 0
                for s in sorted(spans, key=lambda s: s["first_word"]):
                    kept += words[done : s["first_word"]]
                    done = max(done, s["first_word"] + s["n_words"])
                texts.append(b" ".join(kept + words[done:]).decode())
            yield arrow_batch(schema, [b.column(0), texts])

    cuts = repeated_passages(docs, percent).where("removed").groupBy("doc").agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    return identified(docs, "doc_id", "text").join(cuts, "doc").select("doc_id", "spans", "text").mapInArrow(run, "doc_id bigint, text string")
