"""Encoding of texts with a public byte-level BPE vocabulary.

Method: the pair ranks of a word are the leaves of a segment tree of minima; its
root is the leftmost merge of lowest rank, and a merge changes three leaves and
their paths. All new words of a batch are merged in lockstep: one numpy tree per
word length class, a row per word, one merge of every unfinished word per step; a few
long words are merged one by one.
Words already seen by the Python worker come from a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: The vocabulary's published pre-tokenization pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker's cache of encoded words is emptied at this many words.
CACHE_WORDS = 300_000
#: Words of a length class that are merged one by one instead of in lockstep.
FEW = 24
_NONE = np.int64(2**62)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class SegmentTreeBpe:
    """Merges words by a segment tree over the ranks of adjacent pairs."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY):
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([ids[x] for x in _byte_letters()], np.int64)
        self.rank = {int(k): r for r, k in enumerate(key)}
        self.words = regex.compile(PATTERN).findall
        self.letters = {x: b for b, x in enumerate(_byte_letters())}
        self.names = ids
        self.cache: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.cache.clear()
        self.flat, self.starts, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (non-empty bytes)."""
        sizes = np.array([len(w) for w in words])
        classes = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        found: list = [None] * len(words)
        for c in map(int, np.unique(classes)):
            rows = np.flatnonzero(classes == c)
            if len(rows) < FEW and c > 5:  # numpy gains nothing on a few long words
                for i in rows:
                    found[i] = self._alone(words[i])
                continue
            step = max(1, 4_000_000 >> (c + 1))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._lockstep([words[i] for i in part], 1 << c)):
                    found[i] = ids
        return found

    def _alone(self, word: bytes) -> np.ndarray:
        """One word by its own tree: a leaf's key is its pair's rank, then its place."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        symbol = [int(self.of_byte[b]) for b in word]
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        none, rank, merged = 1 << 62, self.rank.get, self.merged
        shift = width.bit_length()
        mask = (1 << shift) - 1

        def leaf(at: int) -> int:
            after = following[at]
            if after >= n:
                return none
            r = rank(symbol[at] << 32 | symbol[after])
            return none if r is None else r << shift | at

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, key: int) -> None:
            k = at + width
            tree[k] = key
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] < none:
            at = tree[1] & mask
            symbol[at] = int(merged[tree[1] >> shift])
            gone = following[at]
            following[at] = after = following[gone]
            if after < n:
                previous[after] = at
            put(gone, none)
            put(at, leaf(at))
            if previous[at] >= 0:
                put(previous[at], leaf(previous[at]))
        out, at = [], 0
        while at < n:
            out.append(symbol[at])
            at = following[at]
        return np.array(out, np.int32)

    def _lockstep(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n, size = len(words), np.array([len(w) for w in words])
        filled = np.arange(width)[None, :] < size[:, None]
        symbol = np.zeros((n, width + 1), np.int64)
        symbol[:, :width][filled] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        following = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        previous = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        shift = np.int64(width.bit_length() + 1)

        def leaf(r: np.ndarray, at: np.ndarray) -> np.ndarray:
            after = following[r, at]
            ok = after < size[r]
            rank = self._ranks(symbol[r, at], symbol[r, np.where(ok, after, 0)])
            return np.where(ok & (rank >= 0), rank << shift | at, _NONE)

        r, at = np.nonzero(filled)
        tree[r, width + at] = leaf(r, at)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        active = np.arange(n)
        while True:
            root = tree[active, 1]
            active, root = active[root < _NONE], root[root < _NONE]
            if not len(active):
                break
            at = root & ((np.int64(1) << shift) - 1)
            gone = following[active, at]
            symbol[active, at] = self.merged[root >> shift]
            after = following[active, gone]
            following[active, at] = after
            previous[active, np.minimum(after, width)] = at
            tree[active, width + gone] = _NONE
            tree[active, width + at] = leaf(active, at)
            before = previous[active, at]
            has = before >= 0
            tree[active[has], width + before[has]] = leaf(active[has], before[has])
            for r, p in ((active, gone), (active, at), (active[has], before[has])):
                node = (p + width) >> 1
                while node.size and node[0] >= 1:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
        out = []
        alive = np.zeros((n, width + 1), bool)
        at = np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            alive[rows, at] = True
            at = following[rows, at]
            rows, at = rows[at < size[rows]], at[at < size[rows]]
        for i in range(n):
            out.append(symbol[i, np.flatnonzero(alive[i])].astype(np.int32))
        return out

    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id (special tokens, which are never given, left out)."""
        return {i: bytes(map(self.letters.__getitem__, x)) for x, i in self.names.items() if all(c in self.letters for c in x)}

    def codes(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table of encoded words."""
        new = list(set(words).difference(self.cache))
        if new:
            if len(self.cache) + len(new) > CACHE_WORDS:
                self._clear()
                new = list(set(words))
            ids = self.merge_words([w.encode("utf-8", "surrogatepass") for w in new])
            ends = len(self.flat) + np.cumsum([len(x) for x in ids])
            first = len(self.ends)
            self.starts = np.concatenate([self.starts, ends - [len(x) for x in ids]])
            self.ends = np.concatenate([self.ends, ends])
            self.flat = np.concatenate([self.flat, *ids])
            self.cache.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        cut = [self.words(t) for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        code = self.codes([w for c in cut for w in c])
        lengths = (self.ends - self.starts)[code]
        total = int(lengths.sum())
        base = np.repeat(self.starts[code] - (np.cumsum(lengths) - lengths), lengths)
        flat = self.flat[base + np.arange(total)] if total else np.zeros(0, np.int32)
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, np.repeat(np.arange(len(texts)), counts), lengths)
        return np.split(flat, np.cumsum(per_text)[:-1]) if len(texts) else []

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        cut = [self.words(t) for t in texts]
        code = self.codes([w for c in cut for w in c])
        sums = np.zeros(len(texts), np.int64)
        np.add.at(sums, np.repeat(np.arange(len(texts)), np.array([len(c) for c in cut], np.int64)), (self.ends - self.starts)[code])
        return sums


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> SegmentTreeBpe:
    """One encoder for each Python worker."""
    return SegmentTreeBpe(folder, name)


def _chunks(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, to bound the memory of one step."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_ids(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """``array<int>`` of the text's ids without special tokens; strings that look
    like special tokens are ordinary text. Empty text: empty array; null: null."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(folder, name)
        for part in parts:
            known = part[part.notna()]
            found = [x for run in _chunks(known.tolist()) for x in bpe.encode(run)]
            yield pd.Series(found, index=known.index, dtype=object).reindex(part.index).where(part.notna(), None)

    return ids(text)


def token_count(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """Number of the text's ids; 0 for empty text, null for null."""

    @F.pandas_udf("bigint")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(folder, name)
        for part in parts:
            known = part[part.notna()]
            found = [int(x) for run in _chunks(known.tolist()) for x in bpe.count(run)]
            yield pd.Series(found, index=known.index, dtype="Int64").reindex(part.index)

    return counts(text)


def decoded(ids: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """The text that ids stand for; null for null."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = encoder(folder, name).pieces()
        for part in parts:
            yield pd.Series([None if x is None else b"".join([pieces[i] for i in x]).decode("utf-8", "surrogatepass") for x in part], index=part.index, dtype=object)

    return text(ids)


def encode_documents(df: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids``: one row for each row of ``df``. A map without shuffle;
    repeated rows are encoded each, extra columns are pruned."""
    return df.select("doc_id", token_ids(F.col("text"), folder, name).alias("ids"))
