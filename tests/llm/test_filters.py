"""Quality, toxicity, personal data and URL rules against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from sessionlab.llm import pii, quality, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [
    (1, "one two three\none two three\n\nfour #* five"), (2, None), (3, ""), (None, "no id here"), (5, " \t\n\x0b\x0c\r "), (6, LONG), (7, "a b c a b c a"),
    (7, "a b c a b c a"), (8, "x\x1cy\u00a0z \u2003w \U0001f600 é"), (9, "line\nline\n \nline"),
]
EXTRA = "doc_id bigint, text string, row int, size string, score double, kept string, held_out int, key binary, label int, x int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "s", 0.5, "k", 3, b"b", 9, 4) for i, t in TEXTS], EXTRA)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spots = {}
    for k in range(len(words) - 2):
        spots.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for at in spots.values() if len(at) > 1 for k in at for j in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts_match_the_plain_version(odd):
    got = sorted(repr(tuple(r)) for r in quality.judge(odd, None).select("doc_id", *quality.BASE, "base_failed", "kept").collect())
    want = []
    for i, t in TEXTS:
        c = plain_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append(repr((i, *c, failed, not failed)))
    assert got == sorted(want)
    assert quality.judge(odd.limit(0), None).count() == 0
    assert quality.keep_good(odd, None).columns == odd.columns


def test_trees_obey_constraints_and_node_arrays_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.4) & (x[:, 1] > 0.3) | (rng.random(2000) < 0.1)).astype(float)
    model = quality.fit(x, y, np.array([-1, 0, 0]), trees=20)
    for row in x[:50]:
        line = np.repeat(row[None, :], 101, axis=0)
        line[:, 0] = np.linspace(0, 1, 101)
        assert (np.diff(model.margin(line)) <= 1e-12).all()
        walked = model.start
        for t in range(20):
            at = 0
            while at < 7:
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.border[t, at])
            walked += model.leaf[t, at - 7]
        assert abs(walked - model.margin(row[None, :])[0]) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_quality_training_handles_poor_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.train(odd, none) is None
    one = spark.createDataFrame([(1, 1), (7, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    assert quality.train(odd, one) is None
    both = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (99, 0)], "doc_id bigint, quality int")
    assert quality.judge(odd, quality.train(odd, both)).count() == len(TEXTS)


def made_texts(n, seed):
    rnd = random.Random(seed)
    bad = ["grumblox", "snarvik", "plodder"]
    make = lambda: "".join(rnd.choice(["ta", "re", "mi", "no", "lu", "ke"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for k in range(n):
        words = [make() for _ in range(rnd.randint(30, 120))]
        if k % 3 == 0:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", "s", "ing", "y"])
        out.append((" ".join(words).encode(), float(k % 3 == 0)))
    return out


def test_toxicity_finds_held_out_and_misspelt_words():
    train, test = made_texts(600, 1), made_texts(300, 2)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    got = model.score([t for t, _ in test], {})
    y = np.array([y for _, y in test])
    assert (got[y == 1] >= 0.7).mean() > 0.95 and (got[y == 0] >= 0.7).mean() < 0.02
    harmless, misspelt = model.score([b"ta re mi no lu ke tare mino", b"ta re grumbloxx no lu ke tare mino"], {})
    assert misspelt > harmless + 0.2
    assert model.score([b"ta " * 100_000], {})[0] < 0.7


def test_toxicity_of_odd_rows(spark, odd):
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(TEXTS) and {r.predicted for r in rows} == {0} and max(r.score for r in rows) < 1e-9
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (8, 1), (8, 0)], "doc_id bigint, toxic int")
    again = [sorted(repr(r) for r in toxicity.score(odd, toxicity.train(odd, labels)).collect()) for _ in range(2)]
    assert again[0] == again[1] and all(0 <= r.score <= 1 for r in rows)


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def pii_texts(n, seed):
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    kinds = [lambda: f"ab.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rnd.randint(0, 300)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: digits(16), lambda: f"v{digits(3)}"]
    word = lambda: "".join(rnd.choice("aeiorstlné") for _ in range(rnd.randint(1, 8)))
    return [" ".join(rnd.choice(kinds)() if rnd.random() < 0.05 else word() for _ in range(rnd.randint(0, 150))) for _ in range(n)]


ODD_PII = ["", "@", "a@b", "a@b.c@d.e", "..@-.-", "1.2.3.4.5.6.7.8", "1.2.3.256", "000000255.1.1.01", "+1" * 50, "1 " * 40, "+1 ( ) 234-567-890.", "é1@x.yü", "9" * 5000, "a" * 5000 + "@b.c"]


def test_pattern_spans_match_plain_regular_expressions():
    rnd = random.Random(5)
    noise = ["".join(rnd.choice("01259.@+- ()ab") for _ in range(rnd.randint(0, 60))) for _ in range(20_000)]
    for text in [*ODD_PII, *noise, *pii_texts(100, 1)]:
        assert pii.pattern_spans(text) == plain_spans(text), text[:80]


def test_tagger_learns_spans_and_skipping_windows_changes_nothing(spark):
    model = pii.fit(pii_texts(400, 2), most=1500)
    texts = [*pii_texts(80, 3), *ODD_PII, ("wort " * 30_000) + "mail to xy.12@mail3.example.com now"]
    found = pii.tagged_spans(texts, model)
    everywhere = pii.tagged_spans(texts, model, all_windows=True)
    assert [f for f, t in zip(found, texts, strict=True) if "aaa" not in t] == [f for f, t in zip(everywhere, texts, strict=True) if "aaa" not in t]
    base = [set(pii.pattern_spans(t)) for t in texts[:80]]
    hits = sum(len(b & set(f)) for b, f in zip(base, found, strict=False))
    assert hits > 0.9 * sum(map(len, base))
    for text, (own, both) in zip(texts, pii.all_spans(texts, model), strict=True):
        assert set(own) <= set(both) and own == pii.pattern_spans(text)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (-1, None)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, spans string, n_chars int")
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    for i, t in rows:
        own = plain_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in own) for n in range(4)]
    masked = {r.doc_id: r for r in pii.mask(df, model).collect()}
    assert masked[-1].text is None and "@mail3" not in masked[len(texts) - 1].text and "<EMAIL>" in masked[len(texts) - 1].text
    assert pii.train(df.limit(0)) is None and pii.find(df, None).count() == len(rows)


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    model = pii.Tagger(hidden=3, embed=2)
    x, y = rng.integers(0, pii.SYMBOLS, (6, 4)), np.array([[0, 1, 2, 2, 0, 3], [5, 6, 6, 0, 0, 0], [0] * 6, [2, 2, 0, 1, 0, 7]]).T
    _, grad = model.loss_and_grad(x, y)
    for name, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name != "emb" else (x[0, 0], 1)
        w[at] += 1e-2
        up, _ = model.loss_and_grad(x, y)
        w[at] -= 2e-2
        down, _ = model.loss_and_grad(x, y)
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3 + 0.02 * abs(grad[name][at]), name


def plain_judge(url, rules):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit and host else None
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rnd = random.Random(3)
    labels, paths = ["a", "b", "cc", "d"], ["", "/", "/x", "/x/", "/x/y", "/z\x7f", "/é/"]
    host = lambda n: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, n)))
    rules = [(rnd.choice(["allow", "block"]), host(3), rnd.choice(paths)) for _ in range(60)]
    rules = list({(h, p): (v, h, p) for v, h, p in sorted(rules)}.values())
    urls = [f"http://{host(4).upper() if rnd.random() < 0.2 else host(4)}{rnd.choice(paths)}{rnd.choice(['', 'q', '?a=/x', '#/x'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "http://", "://a", "http:///x", "x://a.b?c", "http://a\n/x", urls[0], urls[0], "http://a/" + "x" * 20_000]
    pages = spark.createDataFrame([(k, u, "allow", "r") for k, u in enumerate(urls)] + [(None, urls[0], "", "")], "page_id bigint, url string, verdict string, host string")
    for given in (rules, rules + [(v, h, p) for v, h, p in rules[:5]], []):
        got = url_filter.judge(pages, spark.createDataFrame(given, url_filter.RULE_SCHEMA)).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            want = plain_judge(urls[r.page_id if r.page_id is not None else 0], given)
            assert (r.host, r.path, r.rule, r.verdict) == want
    both = spark.createDataFrame([("allow", "a", "/"), ("block", "a", "/")], url_filter.RULE_SCHEMA)
    assert {r.verdict for r in url_filter.judge(pages, both).where("host = 'a' and path like '/%'").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), both).count() == 0
