"""Deduplication, mixing, encoding, search and scoring against plain versions, with odd rows; the pipeline stage by stage."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from sessionlab.llm import bpe, class_lm, common, mixing, near_dedup, substring_dedup, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "doc_id bigint, text string, source string, row int, size string, component string, key int, n int, copies string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "s", "c", 2, 3, "x", "n") for i, t, s in rows], EXTRA)


def words(rnd, n, size=4000):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def edited(rnd, text, share):
    return [w if rnd.random() > share else f"e{rnd.randrange(10**9)}" for w in text]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(7)
    rows = []
    for _ in range(40):
        rows.append(" ".join(words(rnd, rnd.randint(20, 120))))
    base = words(rnd, 120)
    rows += [" ".join(edited(rnd, base, rnd.random() * 0.04)) for _ in range(60)]  # one group far above SMALL, some linked by others only
    rows += [" ".join(base)] * 5
    chain = words(rnd, 100)
    for k in range(8):
        chain = chain[: 3 * k] + words(rnd, 3) + chain[3 * k + 3 :]
        rows.append(" ".join(chain))
    rows += ["", None, " \n\t", "a", "A", "a b c d", "A B c d", "a b c d e", "x " * 5000, "x " * 4000, "é É ü", "É É ü"]
    out = [(1000 - k, t) for k, t in enumerate(rows)]
    return out + [(None, rows[0]), (None, "alone here with nobody"), out[5], out[5]]


def test_near_duplicates_match_brute_force(spark, near_rows):
    df = frame(spark, [(i, t, "s") for i, t in near_rows])
    got = near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    key = lambda r: repr(tuple(r))
    want = [(i, n, c, k if i is not None else c is None) for i, n, c, k in plain_components(near_rows)]
    assert sorted(map(key, got)) == sorted(map(key, want))
    stay = near_dedup.keep_one(df)
    assert stay.columns == df.columns
    groups = len({c for i, n, c, _ in want if n and c is not None}) + sum(1 for i, n, c, _ in want if n and c is None)
    assert stay.count() == groups + sum(1 for _, n, _, _ in want if not n)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_signatures_come_from_one_circle():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)]))
    keys = near_dedup.circulant_signatures([a, b], bands=400, rows=1)
    same = (keys[0] == keys[1]).mean()
    assert abs(same - 360 / len(np.union1d(a, b))) < 0.08


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900 + k) for k in range(50)] + [(3, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_repeated_passages_are_found_wherever_they_stand(spark):
    rnd = random.Random(4)
    rows = [(k, words(rnd, rnd.randint(0, 300), 10**6)) for k in range(60)]
    passage, short = words(rnd, 51, 10**6), words(rnd, 15, 10**6)
    for k in range(0, 30, 3):
        at = rnd.randint(0, len(rows[k][1]))
        rows[k] = (k, rows[k][1][:at] + passage + rows[k][1][at:])
    for k in range(30, 60, 2):
        rows[k] = (k, rows[k][1] + short)
    long = words(rnd, 120_000, 10**6)
    texts = [(k, " ".join(w)) for k, w in rows] + [(100, None), (101, ""), (102, " ".join(long)), (103, "start " + " ".join(long[500:580])), (None, " ".join(long[-60:])), (0, " ".join(rows[0][1]))]
    texts += [(104, "same word " * 500), (105, "same word " * 400)]
    df = frame(spark, [(i, t, "s") for i, t in texts])
    got = substring_dedup.repeated_passages(df).collect()
    flagged = {r.doc_id for r in got}
    assert flagged == {*range(0, 30, 3), 102, 103, None, 104, 105}
    assert {r.kept_doc_id for r in got if r.doc_id in range(0, 30, 3)} == {0}
    assert not any(r.removed for r in got if r.doc_id == 0) and all(r.removed for r in got if r.doc_id in range(3, 30, 3))
    by_id = dict(texts[:60])
    for r in got:
        if r.doc_id in range(0, 30, 3):
            beside = set(by_id[r.doc_id].split()[r.first_word : r.first_word + r.n_words]) - set(passage)
            assert len(beside) <= 4  # two words beside either end leave a paragraph's similarity at 0.8
    cleaned = dict(map(tuple, substring_dedup.without_repeats(df).collect()))
    assert len(cleaned[3].split()) < len(by_id[3].split()) and 0 not in cleaned
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_bands_miss_few_paragraphs_at_the_threshold():
    rnd, alike, missed = random.Random(12), 0, 0
    while alike < 3000:
        a = words(rnd, substring_dedup.PARAGRAPH, 10**6)
        b = [*a[:-2], "other", a[-1]]
        x, y = ({tuple(t[k : k + 5]) for k in range(21)} for t in (a, b))
        if 100 * len(x & y) >= 80 * len(x | y):  # brute force: 19 of 23 shingles
            alike += 1
            ka, kb = (substring_dedup.paragraphs(" ".join(t).encode())[2] for t in (a, b))
            missed += not (ka == kb).any()
    assert missed <= 0.008 * alike
    miss = (1 - 0.8**substring_dedup.ROWS) ** substring_dedup.BANDS
    assert miss <= (1 - 0.8) ** 3  # what three bands of one row miss


def test_repeats_are_marked_to_their_edges_and_edited_ones_found(spark):
    rnd = random.Random(21)
    fresh = lambda n: words(rnd, n, 10**9)
    rows, lengths, changes = [], {}, {}
    for k in range(40):  # verbatim, from 25 words on
        passage = fresh(25 + k)
        lengths[2 * k + 1] = len(passage)
        rows += [(2 * k, fresh(60) + passage + fresh(60)), (2 * k + 1, fresh(31) + passage + fresh(47))]
    for k in range(200, 320):  # edited, 50 words with one to three of them changed; the first forty in the middle
        passage, other = fresh(50), None
        places = [25] if k < 240 else rnd.sample(range(50), 1 + k % 3)
        other = [f"c{k}" if j in places else w for j, w in enumerate(passage)]
        edges = [-1, *sorted(places), 50]
        changes[2 * k + 1] = (len(places), max(b - a - 1 for a, b in zip(edges, edges[1:], strict=False)))
        rows += [(2 * k, fresh(60) + passage + fresh(60)), (2 * k + 1, fresh(31) + other + fresh(47))]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, [(i, " ".join(t), "s") for i, t in rows])).where("removed").collect()}
    for i, n in lengths.items():
        assert (got[i].first_word, n) == (31, got[i].n_words) or (31 - 2 <= got[i].first_word <= 31 and n <= got[i].n_words <= n + 4)
    assert all(i in got and got[i].kept_doc_id == i - 1 for i, (_, run) in changes.items() if run >= 25)
    for n in (1, 2, 3):
        found = [i in got for i, (c, _) in changes.items() if c == n]
        print(f"{n} of 50 words changed: {sum(found)} of {len(found)} passages found")


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > cap * sizes[s] * (1 + 1e-12)}
        if not above:
            return {**{s: cap * sizes[s] for s in full}, **share}
        full |= above


def test_mixing_hits_targets_and_reruns_agree(spark):
    rnd = random.Random(8)
    sources = ["b", "a", "Z", "é", "\U0001f600", None, "\uffff", ""]
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 900])), "a" if rnd.random() < 0.4 else rnd.choice(sources)) for k in range(1500)]
    rows += [(9000, None, "b"), (None, "x y", "b"), (9001, "q " * 60_000, "big"), (5, rows[5][1], rows[5][2]), (9002, "", "empty source")]
    df = frame(spark, rows)
    plans = [mixing.mixture_plan(df).collect() for _ in range(2)]
    assert sorted(repr(r[1:]) for r in plans[0]) == sorted(repr(r[1:]) for r in plans[1])
    assert len(plans[0]) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    largest = collections.Counter()
    taken = collections.Counter()
    for r in plans[0]:
        s = None if r.source_key == "1" else r.source_key[1:]
        assert abs(r.target - want[s]) <= 1e-6 * max(1, want[s]) and r.source_size == sizes[s] and 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6 * want[s]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in plans[0])
    assert mixing.mixture_plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_running_sums_over_many_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), k, rnd.randrange(9), rnd.choice([None, k])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint, w int")
    got = {(r.g, r.o): (r.before_v, r.last_w) for r in common.running_sums(df, ["o"], ["v"], by=["g"], parts=17, last=["w"]).collect()}
    for g in "ab":
        total, last = 0, None
        for _, o, v, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            last = w if w is not None else last
            assert got[g, o] == (total, last)
            total += v


def odd_texts():
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzéñßäøąłжшдתم中日  '!.,-0123456789<>|"
    noise = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    plain = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    return ["", "  ", "<|endoftext|>a<|startoftext|><|endoftext|> B", "ΑΣ ΟΔΥΣΣΕΥΣ", "İ ǅ ﬁ ß ẞ e\u0301", "it's we'll 'S", "a\x1cb\x85c\xa0d", "a" * 3000, "</w> a</w>", "x " * 30_000, "½ ² 4５", *noise, *plain]


def test_encoding_equals_the_library_and_round_trips(spark):
    library, own = Tokenizer.from_file(TOKENIZER), bpe.WordBpe(open(TOKENIZER, "rb").read())
    texts = odd_texts()
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text[:60]
        assert own.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids, skip_special_tokens=False)
    rows = [(k, t, "s") for k, t in enumerate(texts[:40])] + [(None, "no id", "s"), (50, None, "s"), (0, "", "s")]
    df = frame(spark, rows)
    encoded = bpe.encode_documents(df, TOKENIZER)
    decoded = bpe.decode_documents(encoded, TOKENIZER)
    ids = collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert ids == collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    back = collections.Counter((r.doc_id, r.text) for r in decoded.collect())
    assert back == collections.Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, _ in rows)
    assert bpe.round_trip_digests(df.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("spread", ["random", "copies", "lengths", "large"])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 37)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (600, 6))
    if spread == "copies":
        v[:300] = v[0]
    if spread == "lengths":
        v *= np.exp(rng.normal(0, 3, (600, 1)))
        v[:20] = v[20] * np.linspace(0.99, 1.01, 20)[:, None]
    if spread == "large":
        v[100:110, 2] = 2.0**21
        v[200:210, 1] = -(2.0**40)
        v[300, 0], v[400, 0], v[401, 3] = 2.0**50, 2.0**100, -(2.0**60)
    rows = [(k, [float(np.float32(c)) for c in x], 1) for k, x in enumerate(v)]
    rows += [(700, None, 1), (750, [1.0, None] * 3, 1), (800, [float("nan")] * 6, 1), (850, [float("inf")] * 6, 1), (900, [0.0] * 6, 1), (950, [1.0, 2.0], 1), (951, [1.5, -2.0], 1), (None, [9.0] * 6, 1), (50, rows[50][1], 1), (1000, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    fine = [(k, [min(max(math.floor(256 * c), -(2**62)), 2**62) for c in x]) for k, x, _ in rows if k is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for at, (q, x) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(x, y, strict=True)), 1 - 2**63), 2**63 - 1), k) for other, (k, y) in enumerate(fine) if other != at and len(y) == len(x))[:5]
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_memory_held_by_workers_is_bounded_in_bytes():
    hashes = common.WordHashes()
    words = [b"w%d" % k + b"x" * 5000 for k in range(200)]
    assert hashes.of(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and not hashes
    texts = ["a" * 10, None, "b" * 6_000_000, "", "c" * 3_000_000, "d" * 3_000_000, *["e"] * 600]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(common.slices([batch.slice(1)]))
    assert pa.Table.from_batches(parts).column("doc_id").to_pylist() == list(range(1, len(texts)))
    assert [p.num_rows for p in parts[:2]] == [1, 1] and max(p.num_rows for p in parts) <= 256
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= common.SLICE_BYTES for p in parts)


def test_scores_match_counts_and_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(class_lm, "STEP_TOKENS", 150)
    monkeypatch.setattr(class_lm, "CLUSTERED", 60)
    rnd = random.Random(6)
    rows = [(k, " ".join(words(rnd, rnd.randint(0, 60), 150)).upper() + " é.", "s") for k in range(120)] + [(None, "w1 w2", "s"), (500, None, "s"), (501, "", "s"), (3, "w3 w4", "s"), (502, "zz " * 3000, "s")]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in rows]
    count = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), h, len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _, _), ws, h in zip(rows, tokens, held, strict=True))
    df = frame(spark, rows)
    got = class_lm.score(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    corpus = class_lm.Corpus(df, clustered=60)
    assert (corpus.tokens, corpus.words) == (n, v)
    classes, moves = class_lm.exchange(corpus)
    assert moves.sum() == n
    model = class_lm.ClassModel(corpus, classes, moves)
    ending = lambda w: zlib.crc32(w.decode()[-2:].encode()) % class_lm.ENDINGS
    top = [w for w, _ in sorted(((w, c) for w, c in count.items() if w), key=lambda x: (-x[1], x[0]))[:60]]
    class_of = {w: class_lm.END_CLASS if w is None else classes[top.index(w)] if w in top else class_lm.CLASSES + ending(w) for w in count}
    for before in (0, 5, class_lm.END_CLASS):
        seen = sum(model.move[before, c] * (count[w] + 0.5) / model.emission_base[c] for w, c in class_of.items())
        unseen = sum(model.move[before, c] * 0.5 / model.emission_base[c] for c in range(class_lm.ALL_CLASSES))
        assert abs(seen + unseen - 1) < 1e-9
    assert class_lm.score(df.limit(0)).count() == 0


def test_rare_words_have_the_class_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 500)
    rnd = random.Random(3)
    names, deeds = [f"n{k}" for k in range(60)], [f"d{k}" for k in range(60)]  # all endings in both, each word seen a few times
    pick = lambda some: rnd.choice(some[:5] if rnd.random() < 0.5 else some)
    rows = [(k, " ".join(w for _ in range(8) for w in ("the", pick(names), "will", pick(deeds), "so")), "s") for k in range(150)]
    corpus = class_lm.Corpus(frame(spark, rows), clustered=13)  # the three common words and five of each kind
    classes, moves = class_lm.exchange(corpus)
    corpus.assign_rest(classes, moves)
    by_word = collections.defaultdict(set)
    number = {r.h: r.w for r in spark.createDataFrame([(w,) for w in names + deeds], "w string").selectExpr("xxhash64(w) AS h", "w").collect()}
    for r in corpus.coded.collect():
        keys, ids = class_lm.unpacked(r["keys"]), np.frombuffer(class_lm.zstandard.decompress(r["ids"]), dtype=np.int64)
        counts = np.frombuffer(class_lm.zstandard.decompress(r["counts"]), dtype=np.int64)
        for i, c, n in zip(ids.tolist(), class_lm.class_of(keys, classes).tolist(), counts.tolist(), strict=True):
            if i in number and n:
                by_word[number[i]].add(c)
    assert len(by_word) > 100 and all(len(c) == 1 and max(c) < class_lm.CLASSES for c in by_word.values())
    first, second = ({c for w in some for c in by_word[w]} for some in (names, deeds))
    assert not first & second
    model = class_lm.ClassModel(corpus, classes, class_lm.context_counts(corpus, classes)[1])
    assert model.emission_base.sum() == pytest.approx(corpus.tokens + 0.5 * (corpus.words + class_lm.ALL_CLASSES))


def test_class_counts_are_added_up_in_few_small_rows(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 300)
    rnd = random.Random(8)
    corpus = class_lm.Corpus(frame(spark, [(k, " ".join(words(rnd, 40, 90)), "s") for k in range(100)]).repartition(5), clustered=30)
    classes = np.arange(30) % class_lm.CLASSES
    cells, moves = class_lm.context_counts(corpus, classes)
    assert cells.shape == (30, 2, class_lm.ALL_CLASSES) and (cells.sum(axis=2) == corpus.top_counts[:, None]).all()
    alone, again = class_lm.context_counts(corpus, classes, by_word=False)  # transitions alone do not send the words' counts
    assert alone is None and (again == moves).all() and moves.sum() == corpus.tokens
    monkeypatch.setattr(class_lm, "NEIGHBOURS", 2)
    assert (class_lm.context_counts(corpus, classes)[0] == cells).all()
    counts = np.random.default_rng(1).poisson(3, 50_000)
    counts[7] = 2**40
    assert (class_lm._cells_back(class_lm._cells(counts)) == counts).all()
    assert len(class_lm._cells(counts)) < 0.8 * len(class_lm.zstandard.compress(counts.tobytes(), 1))
