"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's encoding is the one sequence of tokens in which every neighbouring pair is compatible: no merge across the border would
have come before the merges that made either side. The encoder takes the longest token that an Aho-Corasick automaton
found at a position, checks it against its left neighbour, and falls back to shorter ones; positions that led nowhere are never
tried again, so the work is linear in the word. Results equal those of the merge-by-merge definition.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_LENGTH, CACHE_WORDS, arrow_batch, slices, texts_of, worker_cache

END = "\n"  # stands for the end-of-word suffix inside automaton keys; the byte alphabet has no newline
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: itself where it is a visible Latin-1 character, else the next code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Tokenizer of a ``tokenizers`` JSON file of this kind: NFC, lower case, word pattern, byte alphabet, BPE with an end-of-word suffix."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("this tokenizer file is of another kind")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = {b: c for b, c in enumerate(byte_alphabet())}
        self.table = str.maketrans({chr(b): c for b, c in self.bytes.items()})
        key = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        # parts and rank of each token; tokens without a merge are the base
        self.rank, self.left, self.right, self.merge = {}, {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            if made not in self.rank:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
            self.merge[a, b] = self.rank[made]
        self.pairs: dict[int, bool] = {}
        self.length = {}
        auto = ahocorasick.Automaton()
        for text, token in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            if token not in self.rank or self._stable(self.left[token], self.right[token], self.rank[token]):
                self.length[token] = len(key(text))
                auto.add_word(key(text), token)
        auto.make_automaton()
        self.auto = auto
        texts = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        pieces = [texts.get(i, "").encode() + b" " for i in range(max(texts) + 1)]
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.cache: dict[str, bytes] = {}

    def _stable(self, a: int, b: int, until: int = NEVER) -> bool:
        """True if the border between tokens a and b survives all merges that come before ``until``.

        Left of the border stands, as merging goes on, each part of a's right edge in turn; right of it each part of b's left edge.
        A merge across the border wins if both its sides exist and neither has been taken up by its own parent; on equal rank the leftmost goes first.
        """
        edge_a, edge_b = [(a, until)], [(b, until)]
        while a in self.rank:
            edge_a.append((self.right[a], self.rank[a]))
            a = self.right[a]
        while b in self.rank:
            edge_b.append((self.left[b], self.rank[b]))
            b = self.left[b]
        for x, taken_x in edge_a:
            for y, taken_y in edge_b:
                m = self.merge.get((x, y))
                if m is not None and m < taken_x and (m <= taken_y if taken_y < until else m < taken_y):
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        k = a << 17 | b
        got = self.pairs.get(k)
        if got is None:
            if len(self.pairs) >= 2 * CACHE_WORDS:
                self.pairs.clear()
            got = self.pairs[k] = self._stable(a, b)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word that the word pattern found."""
        s = word.translate(self.table) if word.isascii() else "".join(self.bytes[b] for b in word.encode())
        s += END
        n, length, compatible = len(s), self.length, self.compatible
        found: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.auto.iter(s):
            found[end - length[token] + 1].append(token)  # per start from short to long
        out: list[int] = []
        left = [len(f) for f in found]
        dead = bytearray(n + 1)
        at = 0
        while at < n:
            while left[at]:
                left[at] -= 1
                token = found[at][left[at]]
                to = at + length[token]
                if not dead[to] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = to
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead[at] = 1
                at -= length[out.pop()]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it are matched before anything else."""
        pieces = []
        cache = self.cache
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                pieces.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            part = part if part.isascii() or unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
            # lower case letter by letter: a final sigma gets no form of its own
            for word in self.words.findall(part.replace("Σ", "σ").lower()):
                ids = cache.get(word)
                if ids is None:
                    ids = np.array(self.encode_word(word), dtype="<u4").tobytes()
                    if len(word) <= CACHE_LENGTH:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[word] = ids
                pieces.append(ids)
        return np.frombuffer(b"".join(pieces), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between (the file names no decoder), gathered from one buffer through the offset table."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.buffer[at[:-1]].tobytes()


_WORKER: dict = {}


def _encoder(spec) -> WordBpe:
    return worker_cache(_WORKER, hashlib.sha256(spec).digest(), lambda: WordBpe(spec))


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): ids of every whole text. Null and empty texts give an empty array; repeated rows stay repeated."""
    spec = _read(docs, tokenizer_file)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = _encoder(spec.value)
        for b in slices(batches):
            ids = [encoder.encode(t.decode()).astype(np.int32) for t in texts_of(b)]
            yield arrow_batch(schema, [b.column(0), ids])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded text of every list of ids; null counts as no ids and gives an empty text."""
    spec = _read(encoded, tokenizer_file)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        encoder = _encoder(spec.value)
        for b in slices(batches):
            yield arrow_batch(schema, [b.column(0), [encoder.decode(np.array(x or [], dtype=np.int64)).decode() for x in b.column(1).to_pylist()]])

    return encoded.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass, so that ids needn't travel."""
    spec = _read(docs, tokenizer_file)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder = _encoder(spec.value)
        for b in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for text in texts_of(b):
                ids = encoder.encode(text.decode())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield arrow_batch(schema, [b.column(0), counts, ids_sha, text_sha])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _read(df: DataFrame, tokenizer_file: str):
    """The vocabulary file (a few MB, whatever the corpus) for the tasks."""
    with open(tokenizer_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
