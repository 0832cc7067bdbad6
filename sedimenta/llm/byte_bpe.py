"""Byte-level BPE with a public vocabulary, encoded with a segment tree over the ranks of adjacent pairs.

Every distinct pre-token of a batch is a row. Its bytes are the leaves of a segment tree: leaf i holds the merge
rank of the pair that begins at byte i, and every node the least (rank, position) below it. So the root names the
leftmost pair of the lowest rank; merging it changes three leaves, which are repaired along their paths to the
root, until no root names a pair. All rows of about equal length advance together, one merge a step, in numpy.

Defined results: null and empty texts have no tokens; the names of special tokens in a text are ordinary text;
unpaired surrogates are replaced by U+FFFD; pre-tokens seen before are remembered within a bound, which changes
nothing but speed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED = 150_000  # pre-tokens
TEXTS = 512  # texts split at a time
LONG = 1 << 20  # longer texts are split where a space follows a non-space, which is always a token's end
TREE_CELLS = 1 << 22
NONE = np.int64(1) << np.int64(62)
_LOW = np.int64((1 << 32) - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class PairRanks:
    """(left id, right id) -> rank of their merge, looked up for whole arrays in an open-addressed table."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.BITS, -1, dtype=np.int64)
        key, rank = left.astype(np.int64) << 32 | right, np.arange(len(left), dtype=np.int64)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]
            placed = free & (self.keys[at] == key)
            self.ranks[at[placed]] = rank[placed]
            key, rank, at = key[~placed], rank[~placed], (at[~placed] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the pair doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.keys[at]
        rank = np.where(found == key, self.ranks[at], -1)
        ask = np.flatnonzero((found != key) & (found != -1))
        while len(ask):
            at[ask] = (at[ask] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[ask]]
            hit = found == key[ask]
            rank[ask[hit]] = self.ranks[at[ask[hit]]]
            ask = ask[~hit & (found != -1)]
        return rank


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank = PairRanks(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.pattern = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        rank = self.rank(left, right)
        return np.where(rank < 0, NONE, rank << 32 | position)

    def merge_rows(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids, padded to a power of two; returns the tokens of all rows in a row, and each row's number."""
        rows, width = tokens.shape
        depth = width.bit_length() - 1
        tok = np.ascontiguousarray(tokens).ravel()
        column = np.arange(width, dtype=np.int64)
        after = np.broadcast_to(column + 1, (rows, width)).ravel().copy()
        before = np.broadcast_to(column - 1, (rows, width)).ravel().copy()
        alive = (column[None, :] < sizes[:, None]).ravel()
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        pairs = column[None, :-1] + 1 < sizes[:, None]
        r, c = np.nonzero(pairs)
        tree[r, width + c] = self._leaf(tok[r * width + c], tok[r * width + c + 1], c)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        active = np.arange(rows, dtype=np.int64)
        while len(active):
            root = tree[active * (2 * width) + 1]
            going = root < NONE
            active, root = active[going], root[going]
            if not len(active):
                break
            base, knot, size = active * width, active * (2 * width) + width, sizes[active]
            at = root & _LOW
            gone = after[base + at]
            end = after[base + gone]
            left = before[base + at]
            token = self.merged[root >> 32]
            tok[base + at] = token
            alive[base + gone] = False
            after[base + at] = end
            inner = end < size
            before[base[inner] + end[inner]] = at[inner]
            tree[knot + gone] = NONE
            value = np.full(len(active), NONE, dtype=np.int64)
            value[inner] = self._leaf(token[inner], tok[base[inner] + end[inner]], at[inner])
            tree[knot + at] = value
            led = left >= 0
            tree[knot[led] + left[led]] = self._leaf(tok[base[led] + left[led]], token[led], left[led])
            trunk = knot - width
            for leaf, on in ((at, trunk), (gone, trunk), (left[led], trunk[led])):
                node = (leaf + width) >> 1
                for _ in range(depth):
                    tree[on + node] = np.minimum(tree[on + 2 * node], tree[on + 2 * node + 1])
                    node = node >> 1
        counts = np.add.reduceat(alive, np.arange(0, rows * width, width)) if rows else np.empty(0, dtype=np.int64)
        return tok[alive].astype(np.int32), counts.astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new pre-tokens and remember them under their codes."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        starts = np.cumsum(sizes) - sizes
        widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        pieces, places, counts = [], [], []
        for width in np.unique(widths):
            members = np.flatnonzero(widths == width)
            step = max(1, TREE_CELLS // int(2 * width))
            for k in range(0, len(members), step):
                own = members[k : k + step]
                column = np.arange(width)
                index = np.minimum(starts[own][:, None] + column[None, :], len(flat) - 1)
                tokens, n = self.merge_rows(flat[index], sizes[own])
                pieces.append(tokens)
                places.append(own)
                counts.append(n)
        place, count = np.concatenate(places), np.concatenate(counts)
        first = len(self.flat) + np.cumsum(count) - count
        begin, size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        begin[place], size[place] = first, count
        self.flat = np.concatenate([self.flat, *pieces])
        self.starts, self.sizes = np.concatenate([self.starts, begin]), np.concatenate([self.sizes, size])

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG:
            cut = regex.compile(r"\S(?=\s)").search(text, at + LONG)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self._forget()
        words: list[str] = []
        per_text = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = self.pattern.findall(text)
            per_text[i] = len(found)
            words += found
        codes, new = self.codes, []
        out = np.empty(len(words), dtype=np.int64)
        for w in set(words):
            if w not in codes:
                codes[w] = len(codes)
                new.append(w)
        if new:
            self._learn(new)
        out = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
        size = self.sizes[out]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[out] - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        ids, sizes = [np.empty(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        small: list[int] = []

        def flush() -> None:
            if small:
                found, n = self._group([texts[i] or "" for i in small])
                ids.append(found)
                sizes[small] = n
                small.clear()

        held = 0
        for i, text in enumerate(texts):
            if text and len(text) > LONG:
                flush()
                held = 0
                for part in self._parts(text):
                    found, n = self._group([part])
                    ids.append(found)
                    sizes[i] += n[0]
                continue
            small.append(i)
            held += len(text or "")
            if len(small) >= TEXTS or held > LONG:
                flush()
                held = 0
        flush()
        return np.concatenate(ids), sizes


_loaded: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The Python worker's encoder of a vocabulary file."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Encoder(vocabulary)
    return _loaded[vocabulary]


def _encode(vocabulary: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 2048):
                part = texts[at : at + 2048]
                ids, sizes = own.encode(part)
                key = batch.column("key").slice(at, len(part))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([key, pa.array(sizes)], ["key", "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["key", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; rows with null keys and repeated keys stay as they are."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(vocabulary, False), f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(vocabulary)
        for batch in batches:
            texts = [b"".join([pieces[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return run


def token_bytes(vocabulary: str = VOCABULARY) -> dict[int, bytes]:
    """The bytes of each token id."""
    alphabet = byte_alphabet()
    tokens = json.loads(open(vocabulary, encoding="utf-8").read())["model"]["vocab"]
    return {i: bytes(alphabet[c] for c in t) for t, i in tokens.items() if all(c in alphabet for c in t)}


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row of token ids; null and empty lists give an empty text."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(vocabulary, True), f"key {df.schema[key].dataType.simpleString()}, n_tokens long").withColumnRenamed("key", key)
