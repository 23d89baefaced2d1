"""The pipeline against a plain version of its stages, and the queries with SQL against that SQL."""

import collections
import glob
import os

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sessionlab.llm import mixing, near_dedup, pii, quality, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    failed, _, score = quality._judged([(r["text"] or "").encode() for r in rows], model)
    rows = [r for r, f, s in zip(rows, failed, score, strict=True) if not f and s >= 0.5]
    sets = [set(near_dedup.shingle_set(r["text"].encode()).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(r["doc_id"], least.get(find(k), r["doc_id"]))
    rows = [r for k, r in enumerate(rows) if r["doc_id"] == least[find(k)]]
    kept = spark.createDataFrame(rows, docs.schema)
    tagger = pii.train(kept)
    for r, (_, spans) in zip(rows, pii.all_spans([r["text"] for r in rows], tagger), strict=True):
        r["text"] = pii.masked(r["text"], spans)
    copies = {r.doc_id: r.copies for r in mixing.mixture_plan(spark.createDataFrame(rows, docs.schema)).collect()}
    library = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for r in rows:
        want[r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)] += copies[r["doc_id"]]
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +want


def test_near_duplicates_go_from_eighty_percent_on(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = [f"w{k}" for k in range(100)]  # 96 shingles; two changed inner words leave 86 of 106, three leave 81 of 111
    two, three = [*base[:30], "x", *base[31:60], "y", *base[61:]], [*base[:20], "p", *base[21:45], "q", *base[46:70], "r", *base[71:]]
    docs = docs.unionByName(spark.createDataFrame([(10**9 + k, " ".join(t), "en", "s", 1) for k, t in enumerate((base, two, three))], docs.schema))
    rows = [(r.doc_id, set(near_dedup.shingle_set((r.text or "").encode()).tolist())) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows[:a]):
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert got == sorted(i for k, (i, x) in enumerate(rows) if not x or i == least[find(k)])
    assert 10**9 + 1 not in got and 10**9 + 2 in got


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    none = stage(spark, docs.limit(0), DATA)
    assert none.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a\nb", None, "s", 3)], docs.schema)
    got = stage(spark, docs.limit(20).unionAll(odd), DATA)
    assert got.count() >= 0 and (name == "encoding" or got.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
