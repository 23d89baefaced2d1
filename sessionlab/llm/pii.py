"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

The patterns label a bounded sample of documents; the network learns to tag characters (outside, or beginning / inside of a kind) from
windows of those. Texts are tagged in overlapping windows at fixed places; each window is decoded by itself and the tags of its middle
are kept, so all windows together give one sequence of tags for the whole text, from which spans are read. Spans of the network are
added where they pass the kind's check and touch no pattern span.

Every span holds a digit or an @. A window without either, its context included, counts as outside and isn't tagged: it could only hold
the far end of an address whose name runs on for more than the context without a digit, and such an address the pattern finds whole.

Defined results: null and empty texts have no spans; offsets count code points, the end is exclusive; repeated rows give equal rows; a
corpus without any pattern match gives no model, and then the pattern spans alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices, smallest_hashes, texts_of

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_OR_AT = re.compile(r"[0-9@]")
#: Window, step between windows and the context kept on either side.
STEP, CONTEXT = 64, 24
WIDTH = STEP + 2 * CONTEXT
#: Most documents, and most windows of them, that the network is fitted on.
TRAIN_DOCS, TRAIN_WINDOWS = 2_000, 3_000
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k is inside it
SYMBOLS = 130  # code points below 128, a letter beyond, anything past the text's ends


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """The check that a span of a kind must pass, whoever found it."""
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    if kind == "card":
        return 12 <= len(d := digits_of(text)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(text)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Left to right from each @: the run of local characters before it, then a domain with a dot."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            spans.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return spans


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches that pass their check, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m[0])]
    return sorted(found)


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(codes < 128, codes, 128).astype(np.int32)


def windows_of(text: str, all_windows: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows of a text that hold a digit or @ (or all), and their symbols."""
    symbols = symbols_of(text)
    padded = np.full(-(-len(symbols) // STEP) * STEP + 2 * CONTEXT, SYMBOLS - 1, dtype=np.int32)
    padded[CONTEXT : CONTEXT + len(symbols)] = symbols
    view = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP] if len(symbols) else np.zeros((0, WIDTH), np.int32)
    marked = ((view >= 48) & (view <= 57) | (view == 64)).any(axis=1)
    numbers = np.arange(len(view)) if all_windows else np.flatnonzero(marked)
    return numbers, view[numbers]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Two LSTMs (left to right and back), a linear layer to tag scores, and CRF transitions."""

    def __init__(self, hidden: int = 20, embed: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {"emb": rng.normal(0, 0.3, (SYMBOLS, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for side in "fb":
            self.w[f"in_{side}"] = rng.normal(0, 0.3, (embed, 4 * hidden))
            self.w[f"rec_{side}"] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            self.w[f"off_{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # forget gates start open
        inside = np.arange(2, TAGS, 2)
        self.barred = np.zeros((TAGS, TAGS))
        self.barred[:, inside] = -1e4
        self.barred[inside - 1, inside] = 0
        self.barred[inside, inside] = 0
        self.barred_first = np.zeros(TAGS)  # a window may begin inside a span

    def _lstm(self, x: np.ndarray, side: str, keep: bool = False):
        """x: (time, batch) symbols in reading order. Hidden states, and what the backward pass needs."""
        h = self.hidden
        table = (self.w["emb"] @ self.w[f"in_{side}"] + self.w[f"off_{side}"]).astype(np.float32)
        rec = self.w[f"rec_{side}"].astype(np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        cell = np.zeros_like(state)
        states, kept = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)):
            z = table[x[t]]
            z += state @ rec
            z[:, : 3 * h] *= 0.5  # sigmoid(z) = (tanh(z / 2) + 1) / 2: one tanh for all gates
            np.tanh(z, out=z)
            gates = z[:, : 3 * h] * 0.5 + 0.5
            before, old = state, cell
            cell = gates[:, h : 2 * h] * old + gates[:, :h] * z[:, 3 * h :]
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            states[t] = state
            if keep:
                kept.append((gates, z[:, 3 * h :], before, old, squashed))
        return states, kept

    def _lstm_back(self, x, side, kept, slope, grad):
        h = self.hidden
        rec = self.w[f"rec_{side}"].astype(np.float32)
        d_state, d_cell = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        d_table = np.zeros((SYMBOLS, 4 * h))
        d_rec = np.zeros_like(rec)
        for t in reversed(range(len(x))):
            gates, new, before, old, squashed = kept[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            d_h = slope[t] + d_state
            d_c = d_cell + d_h * o * (1 - squashed**2)
            dz = np.concatenate([d_c * new * i * (1 - i), d_c * old * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - new**2)], axis=1)
            d_cell = d_c * f
            d_state = dz @ rec.T
            d_rec += before.T @ dz
            np.add.at(d_table, x[t], dz)
        grad[f"rec_{side}"] += d_rec
        grad[f"in_{side}"] += self.w["emb"].T @ d_table
        grad[f"off_{side}"] += d_table.sum(axis=0)
        grad["emb"] += d_table @ self.w[f"in_{side}"].T

    def _scores(self, x: np.ndarray, keep: bool = False):
        left, kept_f = self._lstm(x, "f", keep)
        right, kept_b = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([left, right[::-1]], axis=2)
        return both @ self.w["out"].astype(np.float32) + self.w["bias"].astype(np.float32), both, kept_f, kept_b

    def loss_and_grad(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y (time, batch) and the gradient of every weight."""
        scores, both, kept_f, kept_b = self._scores(x, keep=True)
        scores = scores.astype(np.float64)
        time, batch, _ = scores.shape
        move, first = self.w["move"] + self.barred, self.w["first"]
        power = np.exp(move)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = first + scores[0]
        lift = lambda a, m: (top := a.max(axis=1, keepdims=True)) + np.log(np.exp(a - top) @ m + 1e-300)
        for t in range(1, time):
            alpha[t] = lift(alpha[t - 1], power) + scores[t]
        for t in reversed(range(time - 1)):
            beta[t] = lift(beta[t + 1] + scores[t + 1], power.T)
        whole = np.logaddexp.reduce(alpha[-1], axis=1)
        rows = np.arange(batch)
        gold = first[y[0]] + scores[0][rows, y[0]]
        d_move = np.zeros_like(move)
        for t in range(1, time):
            gold += move[y[t - 1], y[t]] + scores[t][rows, y[t]]
            pair = np.exp(np.minimum(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - whole[:, None, None], 0))
            d_move += pair.sum(axis=0)
            np.add.at(d_move, (y[t - 1], y[t]), -1)
        d_scores = np.exp(np.minimum(alpha + beta - whole[:, None], 0))
        d_first = d_scores[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
        np.add.at(d_scores, (np.arange(time)[:, None], rows[None, :], y), -1)
        d_scores /= batch
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["move"], grad["first"] = d_move / batch, d_first / batch
        flat = d_scores.reshape(-1, TAGS)
        grad["out"], grad["bias"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
        slope = (d_scores @ self.w["out"].T).astype(np.float32)
        self._lstm_back(x, "f", kept_f, slope[:, :, : self.hidden], grad)
        self._lstm_back(x[::-1], "b", kept_b, slope[::-1, :, self.hidden :], grad)
        return float((whole - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 4) -> Tagger:
        """Adam on windows x and tags y, both (windows, width)."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                _, grad = self.loss_and_grad(x[some].T, y[some].T)
                step += 1
                size = np.sqrt(sum((g**2).sum() for g in grad.values()))
                for k, g in grad.items():
                    g *= min(1, 5 / (size + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g**2 - v[k])
                    self.w[k] -= rate * (0.5 if epoch >= epochs // 2 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Best tags (windows, width) of windows."""
        out = np.zeros(x.shape, dtype=np.int8)
        for at in range(0, len(x), 2048):
            some = np.ascontiguousarray(x[at : at + 2048].T)
            scores = self._scores(some)[0]
            move = (self.w["move"] + self.barred).astype(np.float32)
            best = self.w["first"].astype(np.float32) + scores[0]
            back = np.empty(scores.shape, dtype=np.int8)
            for t in range(1, len(scores)):
                ways = best[:, :, None] + move
                back[t] = ways.argmax(axis=1)
                best = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[t]
            last = best.argmax(axis=1)
            rows = np.arange(some.shape[1])
            for t in reversed(range(len(scores))):
                out[at : at + len(rows), t] = last
                last = back[t][rows, last]
        return out


def tags_of(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), dtype=np.int64)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start], tags[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
    return tags


def fit(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 6) -> Tagger | None:
    """A tagger from texts whose pattern spans are the labels; windows with a span and windows with other digits, half each at most."""
    rng = np.random.default_rng(seed)
    held, rest = [], []
    for text in texts:
        numbers, view = windows_of(text)
        tags = np.zeros(-(-len(text) // STEP) * STEP + 2 * CONTEXT, dtype=np.int64)
        tags[CONTEXT : CONTEXT + len(text)] = tags_of(text, pattern_spans(text))
        for n, x in zip(numbers, view, strict=True):
            y = tags[n * STEP : n * STEP + WIDTH]
            (held if y.any() else rest).append((x, y))
    if not held:
        return None
    chosen = [part[i] for part in (held, rest) for i in rng.permutation(len(part))[: most // 2]]
    return Tagger().fit(np.stack([c[0] for c in chosen]), np.stack([c[1] for c in chosen]))


def train(docs: DataFrame, most: int = TRAIN_DOCS, text_col: str = "text") -> Tagger | None:
    """A tagger fitted on at most ``most`` documents with a digit or @, those whose texts have the smallest hashes; only they reach the driver."""
    short = docs.select(F.col(text_col).alias("text")).where("text RLIKE '[0-9@]' AND length(text) <= 20000")
    rows = smallest_hashes(short, ["text"], most).toArrow()
    return fit(rows.column("text").to_pylist())


def tagged_spans(texts: list[str], model: Tagger | None, all_windows: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) spans of the network in every text, read from the tags of the windows' middles put together."""
    if model is None:
        return [[] for _ in texts]
    parts = [windows_of(t, all_windows) for t in texts]
    tags = model.tags(np.concatenate([p[1] for p in parts])) if sum(len(p[0]) for p in parts) else None
    out, at = [], 0
    for text, (numbers, _) in zip(texts, parts, strict=True):
        spans = []
        if len(numbers):
            middle = tags[at : at + len(numbers), CONTEXT : CONTEXT + STEP]
            at += len(numbers)
            row, column = np.nonzero(middle)
            place, tag = numbers[row] * STEP + column, middle[row, column].astype(np.int64)
            start = None
            for p, t in zip(place.tolist(), tag.tolist(), strict=True):
                kind = (t - 1) // 2
                if start is not None and t % 2 == 0 and p == end and kind == spans[-1][1]:
                    end = p + 1
                    spans[-1] = (start, kind, end)
                else:
                    start, end = p, p + 1
                    spans.append((start, kind, end))
            spans = [(a, k, min(b, len(text))) for a, k, b in spans if a < len(text)]
        out.append([s for s in spans if DIGIT_OR_AT.search(text, s[0], s[2])])
    return out


def plausible(kind: int, text: str) -> bool:
    """What a span of the network must look like to be added: the kind's check, and an address around the @ or a long enough number."""
    if kind == 0:
        name, at, domain = text.partition("@")
        return bool(at and len(name) >= 2 and len(domain) >= 3 and "." in domain.strip(".") and not re.search(r"\s", text))
    return valid(KINDS[kind], text)


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """Pattern spans, and those with the network's additions, of every text."""
    out = []
    for text, found in zip(texts, tagged_spans(texts, model), strict=True):
        base = pattern_spans(text)
        added = [s for s in found if plausible(s[1], text[s[0] : s[2]]) and not any(s[0] < b and a < s[2] for a, _, b in base)]
        out.append((base, sorted(base + added)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for b in slices(batches):
            found = all_spans([t.decode() for t in texts_of(b)], model)
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            yield arrow_batch(schema, [b.column(0), *counts, [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], [joined(s) for _, s in found]])

    ddl = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first decides and covers all."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """The rows of ``docs`` with masked texts; n_chars, if there, follows the new text."""
    names = docs.columns

    def run(batches):
        for b in slices(batches):
            texts = [t.decode() for t in texts_of(b)]
            new = [masked(t, s) for t, (_, s) in zip(texts, all_spans(texts, model), strict=True)]
            was_null = b.column("text").is_null().to_pylist()
            columns = list(b.columns)
            columns[names.index("text")] = pa.array([None if z else n for n, z in zip(new, was_null, strict=True)], b.schema.field("text").type)
            if "n_chars" in names:
                old = b.column("n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([o if n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
