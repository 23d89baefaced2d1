"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sessionlab.llm import periodic


def plain_runs(words):
    ids = periodic.numbers_of(words)
    n, found = len(ids), {}
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], (ids[: n - q] == ids[q:]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + q >= max(24, 3 * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("null" if doc is None else doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    top = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    head = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def texts():
    rng = random.Random(3)
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 600:
        fib.append(fib[-1] + " " + fib[-2])
    out = [None, "", " \n\t ", "x", "x " * 23, "x " * 24, "x\n" * 5000, "x y " * 12, "x y " * 11 + "x", fib[-1], " ".join(c * 3 for c in fib[-1].split())]
    for k in range(60):
        words = [rng.choice("abcdefghijklmnop"[: rng.choice([1, 2, 3, 16])]) for _ in range(rng.randrange(10, 300))]
        for _ in range(rng.randrange(4)):
            at, size = rng.randrange(len(words)), rng.randrange(1, 40)
            piece = words[at : at + size]
            words[at:at] = (piece * 30)[: rng.randrange(1, 6 * size + 30)]
        out.append(" ".join(words))
    nested = ("r " * 30 + "s " * 27 + "t") * 1
    return [*out, " ".join([nested] * 7), " é \x1c " * 40, ("z" * 5000 + " q ") * 30]


def test_digests_equal_a_plain_search(spark):
    rows = [*enumerate(texts(), start=-5), (7, texts()[9]), (7, texts()[9]), (None, texts()[6])]
    docs = spark.createDataFrame([(d, t, 5, "n", "p") for d, t in rows], "doc_id bigint, text string, start int, n_runs string, period string")
    got = sorted((tuple(r) for r in periodic.digests(docs, periodic.repeated_tail).collect()), key=repr)
    want = sorted((plain_row(d, t) for d, t in rows), key=repr)
    assert got == want
    assert sum(r[1] > 1 for r in got) > 10, "too few documents with several runs"
    assert periodic.digests(docs.limit(0)).count() == 0


def test_collapse_gives_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "a b " * 20 + "c"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in periodic.collapse(docs).collect()}
    assert got == {1: ([(0, 40, 2)], "a b c"), 2: ([], "")}


@pytest.mark.parametrize("kept,grid", [(1 << 15, 1 << 20), (64, 500)])
def test_long_documents_get_their_grid_in_portions(monkeypatch, kept, grid):
    monkeypatch.setattr(periodic, "KEPT_WORDS", kept)
    monkeypatch.setattr(periodic, "GRID", grid)
    monkeypatch.setattr(periodic, "_GRID", {})
    rng = random.Random(8)
    words = [str(rng.randrange(50)).encode() for _ in range(4000)]
    words[300:700] = words[300:400] * 4
    words[1000:3700] = words[1000:1900] * 3
    words[3800:3830] = [b"z"] * 30
    got = periodic.runs_of([periodic.numbers_of(w) for w in (words, words[:2000], [b"a"] * 900)])
    assert got == [plain_runs(words), plain_runs(words[:2000]), plain_runs([b"a"] * 900)]
    assert len(got[0]) >= 3


def test_a_document_longer_than_the_kept_grid():
    rng = random.Random(9)
    words = [str(rng.randrange(5000)).encode() for _ in range(40_000)]
    words[20_000:35_000] = words[20_000:24_000] * 3 + words[20_000:23_000]
    assert periodic.runs_of([periodic.numbers_of(words)]) == [[(20_000, 15_000, 4_000)]]


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 3, 30):
        body = rng.integers(0, kinds, 700)
        body[350:] = np.tile(body[350:367], 21)[:350]
        symbols = np.concatenate([[90], body, [91]])
        grammar = periodic.Grammar(symbols, 4)
        assert grammar.top > (3 if kinds > 1 else 0)
        i, j = rng.integers(1, 701, 500), rng.integers(1, 701, 500)
        i, j = i[i != j], j[i != j]
        for back in (False, True):
            want = []
            for x, y in zip(i, j, strict=True):
                k = 0
                while symbols[x - k - 1 if back else x + k] == symbols[y - k - 1 if back else y + k]:
                    k += 1
                want.append(k)
            assert grammar.extension(i, j, back).tolist() == want
