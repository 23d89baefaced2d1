"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlab.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = [form[w], None, n[w], len(found), n[best] if form[w] else None]
    for w in n:
        last = w
        while form[last]:
            last = form[last]
        out[w][1] = last
    return sorted((w, *v) for w, v in out.items())


def edited(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abcéÉz")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    base += ["É" * 7, "éÉ×÷ÿÀz", "abcdefg", "gfedcba", "x" * 3000, "x" * 3001, "x" * 2999 + "y"]
    pool = base * 30 + [edited(rng, w) for w in base * 4] + [edited(rng, edited(rng, w)) for w in base * 2]
    for c in "pqrst":
        pool += [c * 8] * 280 + [c * 8 + "m"] * 25 + [c * 8 + "mn"] * 2
    rng.shuffle(pool)
    out = [(k, " ".join(pool[k::40]).title() if k % 3 else "-".join(pool[k::40])) for k in range(40)]
    return [*out, out[3], out[3], (None, out[5][1]), (7, None), (8, ""), (9, "ab1cdefgh_ijklmnopĀqrstuvwxµabcdefg"), (-4, "ŸABCDEFG")]


@pytest.mark.parametrize("block", [2048, 3])
def test_variants_equal_a_comparison_of_all_words(spark, rows, block):
    docs = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id bigint, text string, word string, n int, form string")
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, block=block).collect())
    assert got == plain(rows)
    assert any(g[1] and g[2] != g[1] for g in got), "no chain of forms was tested"


def test_empty_tables_and_no_near_words(spark):
    docs = spark.createDataFrame([(1, "singleton singleton alonesome"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.variants(docs).collect()] == plain([(1, "singleton singleton alonesome")])
    assert spelling.variants(docs.limit(0)).count() == 0


def test_products_find_exactly_the_near_pairs_of_blocks():
    rng = np.random.default_rng(2)
    for longer in (0, 1):
        a = rng.integers(97, 100, (80, 7), dtype=np.uint8)
        b = a if not longer else rng.integers(97, 100, (90, 8), dtype=np.uint8)
        i, j = spelling.near_in_blocks(a, b, not longer)
        cut = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
        x, y = [bytes(w) for w in a], [bytes(w) for w in b]
        want = {(p, q) for p in range(len(x)) for q in range(len(y)) if (p < q and sum(s != t for s, t in zip(x[p], y[q], strict=True)) == 1 if not longer else x[p] in cut(y[q]))}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
