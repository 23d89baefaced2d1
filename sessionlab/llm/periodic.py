"""Periodic runs of words by recompression, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q, at least LEAST words and POWER periods long, that no neighbouring word extends. Words q
apart are equal along all of it, so a grid whose step grows with q (as in a harmonic sum, n log n places for all periods) meets every run
in PROBES places in a row; places where PROBES words agree are candidates. Their exact extensions to both sides come from a run-length grammar:
block compression (equal neighbours become one symbol) and pair compression (neighbours from two halves of the alphabet become one
symbol) alternate until a document is a few symbols. Equal names stand for equal stretches, so the common extension of two places
climbs while their symbols start (or end) together and agree, and descends where they differ: steps grow with the logarithm of the extension. All
queries of a batch of documents go through the levels together.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; a null id counts as the text 'null'; repeated
rows are judged alike; an empty table gives an empty one; texts of any length are read whole, the grid of long ones in portions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, mix64, slices, texts_of

LEAST, POWER, PROBES = 24, 3, 4
#: Words of documents whose grid is kept; longer ones get theirs in portions of at most GRID places.
KEPT_WORDS, GRID = 1 << 15, 1 << 20
#: Words that share one grammar.
TOGETHER = 1 << 19
_GRID: dict[int, tuple] = {}


def repeated_tail(words: list[bytes], doc: str) -> list[bytes]:
    """The words with a repeated stretch as their tail, for the tenth of the documents that the hash of their id names."""
    h, n = zlib.crc32(doc.encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _step(q: np.ndarray) -> np.ndarray:
    """Grid step: a run of period q has at least max(LEAST - q, (POWER - 1) q) places whose word equals the one q further."""
    return np.maximum(1, np.maximum(LEAST - q, (POWER - 1) * q) // PROBES)


def _places(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places x and periods q in [low, high) whose probes lie in n words."""
    q = np.arange(low, high)
    h = _step(q)
    count = np.maximum(0, (n - 1 - q - (PROBES - 1) * h) // h + 1)
    x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return x * np.repeat(h, count), np.repeat(q, count)


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Portions (x, q, step) of the grid of n words."""
    if n <= KEPT_WORDS:
        if not _GRID:
            x, q = _places(KEPT_WORDS, 1, KEPT_WORDS // POWER + 1)
            h = _step(q)
            end = x + (PROBES - 1) * h + q + 1
            order = np.argsort(end, kind="stable")  # the grid of a shorter document is a prefix
            _GRID[0] = tuple(c[order].astype(np.int32) for c in (end, x, q, h))
        end, x, q, h = _GRID[0]
        m = int(np.searchsorted(end, n, side="right"))
        yield x[:m], q[:m], h[:m]
        return
    low = 1
    while low <= n // POWER:
        high = min(n // POWER + 1, low + max(1, GRID * int(_step(np.array(low))) // n))
        x, q = _places(n, low, high)
        yield x, q, _step(q)
        low = high


def candidates(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places x and periods q where all probes agree; every run holds one of its period at least."""
    found = []
    for x, q, h in _grid(len(ids)):
        for probe in range(PROBES):
            at = x + probe * h
            keep = np.flatnonzero(ids[at] == ids[at + q])
            x, q, h = x[keep], q[keep], h[keep]
        found.append((x.astype(np.int64), q.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Grammar:
    """Levels of a run-length grammar over symbols that start and end with one of a kind.

    ``symbol``, ``first`` (first child, one level down) and ``parent`` (one level up) of all levels stand one after another, level t from
    ``offset[t]`` on, each with one closing entry; ``blocks[t]`` says that the level above t comes from block compression.
    """

    def __init__(self, symbols: np.ndarray, enough: int):
        level, fresh = symbols.astype(np.int64), int(symbols.max(initial=0)) + 1
        self.blocks: list[bool] = []
        all_symbols, firsts, parents = [level], [np.arange(len(level) + 1)], []
        pair_turn, idle, seed = False, 0, 0
        while len(level) > enough and idle < 16:
            if pair_turn:
                seed += 1
                half = (mix64(level.astype(np.uint64) * np.uint64(2) + np.uint64(seed << 40)) >> np.uint64(17)).astype(np.int64) & 1
                step = np.diff(half)
                joins = step == 1 if (step == 1).sum() >= (step == -1).sum() else step == -1
                starts = np.flatnonzero(np.concatenate([[True], ~joins]))
                left = np.flatnonzero(joins)
                names = level[left] * fresh + level[left + 1]
                made = level[starts]
                target = np.searchsorted(starts, left)
            else:
                starts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
                power = np.diff(np.append(starts, len(level)))
                made = level[starts]
                target = np.flatnonzero(power > 1)
                names = made[target] * (len(level) + 1) + power[target]
            if len(target):
                unique, place = np.unique(names, return_inverse=True)
                made[target] = fresh + place
                fresh += len(unique)
                self.blocks.append(not pair_turn)
                firsts.append(np.append(starts, len(level)))
                up = np.zeros(len(level) + 1, dtype=np.int64)
                up[starts] = 1
                up[-1] = 1
                parents.append(np.cumsum(up) - 1)
                level = made
                all_symbols.append(level)
                idle = 0
            else:
                idle += 1
            pair_turn = not pair_turn
        parents.append(np.zeros(len(level) + 1, dtype=np.int64))
        self.blocks.append(False)
        self.top = len(all_symbols) - 1
        self.offset = np.cumsum([0, *(len(s) + 1 for s in all_symbols)])
        self.symbol = np.concatenate([np.append(s, -1) for s in all_symbols])
        self.first, self.parent = np.concatenate(firsts), np.concatenate(parents)
        self.is_block = np.array(self.blocks)

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from i and j on, or (``back``) before i and j; i and j must differ."""
        a, b = (i - 1, j - 1) if back else (i.copy(), j.copy())
        origin, out = a.copy(), np.zeros(len(i), dtype=np.int64)
        level, falling, live = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=bool), np.arange(len(i))
        way = -1 if back else 1
        while len(live):
            off = self.offset[level]
            equal = self.symbol[off + a] == self.symbol[off + b]
            pa_, pb = self.parent[off + a], self.parent[off + b]
            above = self.offset[np.minimum(level + 1, self.top)]
            has_above = level < self.top
            # children of the parent that are left on the way, this one included
            if back:
                left_a, left_b = a - self.first[above + pa_] + 1, b - self.first[above + pb] + 1
                edge = (self.first[above + pa_ + 1] - 1 == a) & (self.first[above + pb + 1] - 1 == b)
            else:
                left_a, left_b = self.first[above + pa_ + 1] - a, self.first[above + pb + 1] - b
                edge = (self.first[above + pa_] == a) & (self.first[above + pb] == b)
            climb = equal & ~falling & has_above & edge & (self.symbol[above + pa_] == self.symbol[above + pb])
            go = equal & ~climb
            skip = np.where(has_above & self.is_block[level], np.minimum(left_a, left_b), 1)
            fall = ~equal & (level > 0)
            below_a, below_b = (self.first[off + a + 1] - 1, self.first[off + b + 1] - 1) if back else (self.first[off + a], self.first[off + b])
            ended = ~equal & (level == 0)
            out[live[ended]] = (way * (a - origin))[ended]
            a = np.where(climb, pa_, np.where(go, a + way * skip, np.where(fall, below_a, a)))
            b = np.where(climb, pb, np.where(go, b + way * skip, np.where(fall, below_b, b)))
            level = level + climb - fall
            falling = falling | ~equal
            stay = ~ended
            live, a, b, level, falling, origin = live[stay], a[stay], b[stay], level[stay], falling[stay], origin[stay]
        return out


def runs_of(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start, then period, of each document's word numbers; documents with candidates share a grammar."""
    out: list[list] = [[] for _ in documents]
    held, words = [], 0
    for d, ids in enumerate(documents):
        if len(ids) < LEAST:
            continue
        x, q = candidates(ids)
        if len(x):
            held.append((d, ids, x, q))
            words += len(ids)
        if words >= TOGETHER:
            _extend(held, out)
            held, words = [], 0
    _extend(held, out)
    return out


def _extend(held: list, out: list) -> None:
    if not held:
        return
    # single symbols stand before, between and after the documents, so no extension leaves its document
    single = max(int(ids.max()) for _, ids, _, _ in held) + 1
    parts, starts, at = [np.array([single])], [], 1
    for k, (_, ids, _, _) in enumerate(held):
        parts += [ids, np.array([single + 1 + k])]
        starts.append(at)
        at += len(ids) + 1
    grammar = Grammar(np.concatenate(parts), 4 * len(held))
    for low, high in _portions([len(x) for _, _, x, _ in held]):
        some = held[low:high]
        x, q = (np.concatenate([h[c] for h in some]) for c in (2, 3))
        base = np.repeat(starts[low:high], [len(h[2]) for h in some])
        doc = np.repeat([h[0] for h in some], [len(h[2]) for h in some])
        behind = grammar.extension(base + x, base + x + q, back=True)
        length = grammar.extension(base + x, base + x + q) + behind + q
        full = length >= np.maximum(LEAST, POWER * q)
        rows = np.stack([doc, x - behind, length, q], axis=1)[full]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        # a stretch found with multiples of its smallest period counts once
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        for d, start, size, period in rows[new].tolist():
            out[d].append((start, size, period))
    for h in held:
        out[h[0]].sort(key=lambda r: (r[0], r[2]))


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most about GRID candidates together."""
    low, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > GRID:
            yield low, k
            low, total = k, 0
        total += n
    yield low, len(sizes)


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces; of each run only the first period stays."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def _judged(docs: DataFrame, spec: list[tuple[str, str, pa.DataType]], row: Callable, altered: Callable | None, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *[(n, t) for n, _, t in spec]])

    def run(batches):
        for b in slices(batches):
            texts = [t.split() for t in texts_of(b)]
            if altered:
                texts = [altered(w, "null" if d is None else str(d)) for w, d in zip(texts, b.column(0).to_pylist(), strict=True)]
            found = runs_of([numbers_of(w) for w in texts])
            yield arrow_batch(schema, [b.column(0), *zip(*[row(w, r) for w, r in zip(texts, found, strict=True)], strict=True)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", *[f"{n} {t}" for n, t, _ in spec]]))


def collapse(docs: DataFrame, altered: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, text): the runs of every text, and the text of which each keeps its first period."""
    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    spec = [("runs", "array<struct<start: bigint, length: bigint, period: bigint>>", item), ("text", "string", pa.string())]
    row = lambda w, r: ([dict(zip(("start", "length", "period"), x, strict=True)) for x in r], collapsed(w, r).decode())
    return _judged(docs, spec, row, altered, id_col, text_col)


def digest_row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()


def digests(docs: DataFrame, altered: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); the run described is the one of most periods."""
    spec = [(c, "bigint", pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    spec += [(c, "string", pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
    return _judged(docs, spec, digest_row, altered, id_col, text_col)
