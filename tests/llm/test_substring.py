"""Marks of many texts at a time are those of each text, and keys and contents travel in runs."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionlab.llm import substring_dedup as sd
from sessionlab.llm.common import WORD_HASHES, mix64, window_hashes
from sessionlab.session import cut_lineage


def texts():
    rng = random.Random(5)
    lengths = [0, 3, 24, 25, 26, 27, 60, 300, 25, 40, 80]
    made = [" ".join(rng.choice("abcdefgh" if n % 2 else ["Xa", "b", "cc", "é"]) for _ in range(n)) for n in lengths]
    return [None, *made, "a " * 70, " \t\n", " b\x0b\x0cc\x1dd " * 30, None]


def plain(text):
    """Places, keys, seeds and their keys of one text, by their definitions."""
    words = WORD_HASHES.of((text or "").encode().lower().split())
    if len(words) < sd.PARAGRAPH:
        return [], [], [], []
    h = window_hashes(words, sd.WORDS)
    at = sorted({k + int(np.argmin(h[k : k + sd.WINNOW])) for k in range(len(h) - sd.WINNOW + 1)})
    at = [k for k in at if k + sd.PARAGRAPH <= len(words)] or [0]
    keys = []
    for k in at:
        for band in range(sd.BANDS):
            key = np.full(1, band, np.uint64)
            for row in range(sd.ROWS):
                key = mix64(key + mix64(h[k : k + sd.SHINGLES] + np.uint64(band * sd.ROWS + row + 1)).min())
            keys.append(int(key[0]))
    run = np.full(len(words) - sd.SEED + 1, sd.BANDS, np.uint64)
    for k in (0, 5, 10, 11):
        run = mix64(run + h[k : k + len(run)])
    seeds = sorted({k + int(np.argmin(run[k : k + sd.SEED_WINNOW])) for k in range(len(run) - sd.SEED_WINNOW + 1)})
    return at, keys, seeds, mix64(run[seeds]).tolist()


def test_marks_of_many_texts_are_those_of_each():
    given = texts()
    found = sd.Marks(pa.array(given))
    for k, text in enumerate(given):
        own, seeds = found.text[found.at] == k, found.text[found.seed_at] == k
        got = [found.at[own] - found.start[k], found.keys[own].ravel(), found.seed_at[seeds] - found.start[k], found.seed_keys[seeds]]
        assert [x.tolist() for x in got] == list(map(list, plain(text)))


def test_shared_keys_travel_in_runs_and_equal_plain_ones(spark):
    given = [*enumerate(texts()), (50, texts()[8]), (51, texts()[8]), (8, texts()[8])]
    docs = sd.identified(spark.createDataFrame(given, "doc_id long, text string"), "doc_id", "text")
    wanted = sd.repeated_keys(docs)
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect" not in plan  # no row a key
    got = {r.doc: sorted(set(np.frombuffer(r["keys"], np.uint64).tolist())) for r in wanted.collect()}
    own = {r.doc: {*plain(r.text)[1], *plain(r.text)[3]} for r in docs.collect()}
    assert len(own) < len(given)  # equal in id and text: one document
    want = {d: sorted(k for k in keys if any(k in o for e, o in own.items() if e != d)) for d, keys in own.items()}
    assert got == {d: keys for d, keys in want.items() if keys} and len(got) > 2


def test_runs_give_back_their_rows():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    keys[:20], keys[20:24] = keys[0], (0, 1, 2**64 - 1, 2**54)
    more = np.arange(5000, dtype=np.int64) - 2500, rng.random(5000) < 0.5
    rows = [row for part, run in zip(*sd.packed(keys, *more), strict=True) for row in zip(*(c.tolist() for c in sd.unpacked(part, [run], "i8", "?")), strict=True)]
    assert sorted(rows) == sorted(zip(keys.tolist(), *(c.tolist() for c in more)))


def test_passages_with_null_ids_and_equal_rows(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part, other = words(40), words(30)
    rows = [(None, " ".join([*words(5), *part])), (4, " ".join([*part, *words(9)])), (4, " ".join([*other, *words(3)])), (2, " ".join([*words(2), *other])), (2, "x")]
    rows += rows[1:3]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).drop("doc").collect()
    planted = {(4, 0, 40, False, 4), (None, 5, 40, True, 4), (2, 2, 30, False, 2), (4, 0, 30, True, 2)}
    for doc_id, first, n, removed, kept in planted:  # at an edge a paragraph may stand for one a word further on
        assert any((r.doc_id, r.removed, r.kept_doc_id) == (doc_id, removed, kept) and 0 <= first - r.first_word <= 2 and 0 <= r.n_words - n <= 4 for r in got)


def test_shuffle_files_go_with_the_query_that_made_a_table(spark):
    jvm = spark.sparkContext._jvm
    disk = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    table = cut_lineage(spark.range(20_000).select("id", F.xxhash64("id").alias("h")).repartition("h"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 20_000
