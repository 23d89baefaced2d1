"""Near duplicates by circulant MinHash, banding, and exact Jaccard verification on full shingle sets.

One permutation places a shingle on a circle of 2^32 places; coordinate k of a signature is the smallest value of a second permutation
of the circle, shifted by k, over the document's shingles. So two permutations give all coordinates.

Documents with equal sets are one class, and only classes go on. Classes that agree on a band share a bucket. In a bucket of up to SMALL
classes every pair is verified. In a larger one, classes are verified against hubs, round after round with more hubs, until the bucket's
classes are all linked or all its pairs are settled; nothing is skipped. Before that, classes that share a rare shingle (held by at most
SMALL of them) are paired outright, and classes that could not reach the threshold with common shingles alone leave; that bound is exact.

Defined results: null texts and texts without words have empty sets, are linked with nothing and stay; fewer than five words are one
shingle; repeated rows are copies; of null ids the component is that of the ids around them, null if there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.session import broadcast_if_small, cut_lineage

from .common import WORD_HASHES, arrow_batch, components, mix64, numbered, slices, texts_of, window_hashes

WORDS, BANDS, ROWS, SMALL, HUBS = 5, 25, 5, 8, 4


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, A-Z in lower case."""
    return np.unique(window_hashes(WORD_HASHES.of(text.lower().split()), words))


def circulant_signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) keys of all bands; sets must not be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    place = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    value, part = np.empty_like(place), np.empty_like(place)
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for row in range(rows):
            np.add(place, np.uint32(band * rows + row + 1), out=value)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # odd factors and shifted xors permute the 2^32 places
                np.right_shift(value, np.uint32(shift), out=part)
                np.bitwise_xor(value, part, out=value)
                np.multiply(value, np.uint32(factor), out=value)
            np.right_shift(value, np.uint32(16), out=part)
            np.bitwise_xor(value, part, out=value)
            key = mix64(key + np.minimum.reduceat(value, starts))
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, bands) of every document; set_key and bands are null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(t) for t in texts_of(b)]
            full = [s for s in sets if len(s)]
            found = iter(circulant_signatures(full).astype(np.int64)) if full else iter(())
            yield arrow_batch(schema, [
                b.column(0), b.column(1), b.column(2), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [next(found) if len(s) else None for s in sets],
            ])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), row.alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, row bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the threshold, compared in full; only sets of these pairs travel."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            keep = []
            for k in range(batch.num_rows):
                x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut_lineage(pairs)
    side = lambda c, name: broadcast_if_small(pairs).join(sets.select(F.col("node").alias(c), F.col("hashes").alias(name)), c).select("a", "b", name)
    both = side("a", "left_set").join(side("b", "right_set"), ["a", "b"])
    return both.select("a", "b", "left_set", "right_set").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, hashes) of the wanted classes (node, doc_id, text_key), computed again from one text of each."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            yield arrow_batch(schema, [b.column(0), [np.sort(shingle_set(t).astype(np.int64)) for t in texts_of(b)]])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    wanted = broadcast_if_small(wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    found = texts.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def _may_link(percent: int):
    """Upper bound of the overlap against the threshold, from sizes n and numbers s of common shingles."""
    most = F.least("s", "hub_s")
    return 100 * most >= percent * (F.col("n") + F.col("hub_n") - most)


def link_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all classes that are linked with another one."""
    keyed = classes.where("bands IS NOT NULL").select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    members = bucket_members(keyed)
    wanted = members.select("node").distinct().join(classes.select("node", "doc_id", "text_key"), "node")
    return link(members, cut_lineage(shingle_sets(docs, cut_lineage(wanted))), percent)


def bucket_members(keyed: DataFrame) -> DataFrame:
    """Rows (key, node, n) of buckets with two members or more, with the bucket's size."""
    return cut_lineage(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))


def link(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) from bucket members (key, node, n, size) and the sets (node, hashes) of all of them."""
    # small buckets: all pairs, at most SMALL - 1 a class
    small = members.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("all"))
    pairs = small.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    pairs = pairs.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # large buckets: classes that share a rare shingle are paired; others can only have their common shingles in common, and classes
    # with too few of those leave; then hubs, the most ordinary classes first
    large = members.where(F.col("size") > SMALL)
    tokens = sets.join(large.select("node").distinct(), "node", "left_semi").select("node", F.explode("hashes").alias("h"))
    rare = cut_lineage(tokens.join(tokens.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") <= SMALL), "h"))
    sharing = rare.where("c > 1").groupBy("h").agg(F.sort_array(F.collect_list("node")).alias("all"))
    sharing = sharing.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    pairs = pairs.unionByName(sharing)
    large = large.join(rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left").withColumn("s", F.col("n") - F.coalesce("rare", F.lit(0))).select("key", "node", "n", "s")
    least = large.groupBy("key").agg(F.min("n").alias("least"))
    reach = F.col("s") * 100 >= percent * (F.col("n") + F.greatest("least", "s") - F.col("s"))
    rest = cut_lineage(large.join(least, "key").where(reach).drop("least").withColumn("label", F.col("node")))
    labels, hubs = None, HUBS
    while True:
        # the hubs of a bucket come from an aggregate that keeps that many, not from a window over the bucket
        order = F.struct((-F.col("s") / F.col("n")).alias("rank"), "node", "n", "s", "label")
        picked = rest.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("share")).agg(F.min(order).alias("hub"))
        picked = cut_lineage(picked.select("key", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "s", "label")]))
        found = rest.join(picked, "key").where((F.col("label") != F.col("hub_label")) & _may_link(percent))
        found = found.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"))
        new = cut_lineage(verified((pairs.unionAll(found) if labels is None else found).distinct(), sets, percent))
        if labels is None:
            labels = cut_lineage(components(new))
        else:
            # only the labels of both ends are joined up: a graph of components, not of classes
            name = lambda c: F.coalesce(f"{c}_label", c).alias(c)
            lifted = new
            for c in "ab":
                lifted = lifted.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label")), c, "left")
            moved = components(lifted.select(name("a"), name("b"))).select(F.col("node").alias("label"), F.col("component").alias("to"))
            fresh = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("component"))
            labels = labels.withColumnRenamed("component", "label").join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("component"))
            labels = cut_lineage(labels.unionByName(fresh))
        # hubs have met all of their bucket and leave it; a bucket of one label is settled
        rest = rest.join(picked.select("key", F.col("hub_node").alias("node")), ["key", "node"], "left_anti").drop("label")
        rest = rest.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        rest = cut_lineage(rest.join(mixed, "key"))
        if rest.isEmpty():
            return labels
        hubs *= HUBS


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept, component) of every document; ``component`` is null for empty sets."""
    given = cut_lineage(signatures(docs, id_col, text_col, row_col))
    least = F.min_by(F.struct("doc_id", "text_key"), "row")
    classes = given.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), least.alias("at")
    )
    classes = cut_lineage(classes.select("set_key", "node", "least_id", "n_shingles", "bands", "at.doc_id", "at.text_key"))
    labels = link_classes(docs.select(id_col, text_col), classes, percent)
    known = classes.select("set_key", "node", "least_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = cut_lineage(known)
    roots = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = known.join(roots, "component").select("set_key", "component", "component_id")
    out = given.drop("bands").join(placed, "set_key", "left")
    own = F.col("set_key").isNull()
    out = out.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("row", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id (then number) stays."""
    rows, number = numbered(docs)
    found = cut_lineage(near_duplicates(rows, percent, row_col=number))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    one = found.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.row").alias(number))
    stay = one.unionAll(found.where("component IS NULL").select(F.col("row").alias(number)))
    return rows.join(broadcast_if_small(cut_lineage(stay)), number, "left_semi").drop(number)
