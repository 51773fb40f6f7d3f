"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken's bytes are the leaves' symbols.  Leaf i holds the rank of the pair
that starts at symbol i, with i as the lower digits, so a node's minimum is its
leftmost lowest-rank pair.  The root gives the next merge; a merge changes
three leaves, each in logarithmic time; when the root is empty no mergeable
pair is left.  A pretoken of n bytes takes O(n log n), however long it is.

The distinct words of a batch are looked up once each; the new ones go through
their trees together.  Known words are kept in two halves: when the newer half
is full the older one goes, so words that come again stay.

Edge cases: null and empty texts have no ids and decode to the empty text;
rows with equal ids or texts are encoded each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import portions, small_batches

#: Unicode White_Space, spelt out: libraries differ on U+001C to U+001F.
_WS = r"\x09-\x0D\x20\x85\xA0  -     　"
#: The byte-level pretoken pattern that the vocabulary was made with.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Where a text can be cut before a space: between two characters that are not white space.
_CUT = regex.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
_SPACES = frozenset(chr(c) for c in range(0x3001) if regex.match(rf"[{_WS}]", chr(c)))
_NONE = 1 << 62
#: In trees of many pretokens: no pair, the symbol past the end, and the largest tree (as a power of two).
_NO_PAIR, _END, _TOGETHER = 1 << 40, (1 << 20) - 1, 5


class _Both:
    """Ids of words, known ones first."""

    def __init__(self, known: dict[str, bytes], own: dict[str, bytes]):
        self.known, self.own = known, own

    def __getitem__(self, word: str) -> bytes:
        got = self.known.get(word)
        return self.own[word] if got is None else got


class _PairTable:
    """Ranks of pairs of symbols by open addressing, for arrays of pairs."""

    def __init__(self, ranks: dict[int, int]):
        self.shift = 64 - max(4, (8 * len(ranks)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.ranks = np.full(len(self.keys), -1, np.int64)
        self.probes = 1
        for key, rank in ranks.items():
            slot, n = (key * _MULTIPLIER & (1 << 64) - 1) >> self.shift, 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) % len(self.keys), n + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' ranks; -1 where symbols do not merge."""
        key = (a << 20 | b).ravel()
        slot = (key.view(np.uint64) * np.uint64(_MULTIPLIER) >> np.uint64(self.shift)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], -1)
        todo = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out.reshape(a.shape)


_MULTIPLIER = 0x9E3779B97F4A7C15


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        as_byte = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self._pairs = _PairTable(self.pair_rank)
        self._byte_ids, self._merged = np.array(self.byte_id, np.int64), np.array(self.merged, np.int64)
        # Words between spaces and their ids: the ones met since the last turn-over, and those of the turn before.
        self._half = max(1, cache_words // 2)
        self._words: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.pair_rank.get, self.merged
        bits = (n - 2).bit_length()
        size = 1 << bits
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank << bits | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) != _NONE:
            i = top & (size - 1)
            j = after[i]
            k = after[j] if j < n else n
            ids[i] = merged[top >> bits]
            ids[j] = -1
            after[i] = k
            changed = [(i, _NONE)]
            if j < n - 1:
                changed.append((j, _NONE))
            if k < n:
                before[k] = i
                rank = rank_of(ids[i] << 20 | ids[k])
                if rank is not None:
                    changed[0] = (i, rank << bits | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 20 | ids[i])
                changed.append((h, _NONE if rank is None else rank << bits | h))
            for leaf, value in changed:
                node = size + leaf
                if tree[node] == value:
                    continue
                tree[node] = value
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a < b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
                    node >>= 1
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pretokens, as little-endian unsigned 32-bit integers.

        Short ones go through the same tree together, those of one tree size at
        a time: a step takes the root of every tree that is not empty.
        """
        out: list[bytes] = [b""] * len(words)
        by_bits: dict[int, list[int]] = {}
        for k, data in enumerate(words):
            by_bits.setdefault(max(len(data) - 2, 0).bit_length(), []).append(k)
        for bits, rows in by_bits.items():
            if bits > _TOGETHER or len(rows) < 8:
                for k in rows:
                    out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
            else:
                for start in range(0, len(rows), 1 << 14):
                    some = rows[start : start + (1 << 14)]
                    for k, ids in zip(some, self._merge_trees([words[k] for k in some], bits)):
                        out[k] = ids
        return out

    def _merge_trees(self, words: list[bytes], bits: int) -> list[bytes]:
        """Pretokens of at most 2**bits + 1 bytes, each in a tree of 2**bits leaves."""
        size, count = 1 << bits, len(words)
        wide = size + 2  # symbols, and one place past the end
        length = np.fromiter(map(len, words), np.int64, count)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(count), length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        ids = np.full((count, wide), _END, np.int64)
        ids[row, place] = self._byte_ids[flat]
        after = np.tile(np.minimum(np.arange(1, wide + 1), wide - 1), (count, 1))
        after[np.arange(count), length - 1] = wide - 1
        before = np.tile(np.arange(-1, wide - 1), (count, 1))
        # A node past the leaves takes what has no leaf.
        tree = np.full((count, 2 * size + 1), _NO_PAIR, np.int64)
        rank = self._pairs.find(ids[:, :size], ids[:, 1 : size + 1])
        tree[:, size : 2 * size] = np.where(rank < 0, _NO_PAIR, rank << bits | np.arange(size))
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(count)
        while True:
            top = tree[live * (2 * size + 1) + 1]
            some = np.flatnonzero(top != _NO_PAIR)
            if not len(some):
                break
            live, top = live[some], top[some]
            at, root = live * wide, live * (2 * size + 1)
            i = top & (size - 1)
            new = self._merged[top >> bits]
            j = after[at + i]
            k = after[at + j]
            h = before[at + i]
            ids[at + i], ids[at + j] = new, -1
            after[at + i], before[at + k] = k, i
            right = self._pairs.find(new, ids[at + k])
            left = np.where(h < 0, -1, self._pairs.find(ids[at + np.maximum(h, 0)], new))
            changed = (i, np.where(right < 0, _NO_PAIR, right << bits | i)), (j, np.full(len(j), _NO_PAIR)), (h, np.where(left < 0, _NO_PAIR, left << bits | h))
            for leaf, value in changed:
                node = np.where((leaf < 0) | (leaf >= size), 2 * size, size + leaf)
                tree[root + node] = value
            for leaf, _ in changed:
                node = (size + np.clip(leaf, 0, size - 1)) >> 1
                for _ in range(bits):
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                    node >>= 1
        left = ids.reshape(count, wide)
        left = np.where((np.arange(wide) < length[:, None]) & (left >= 0), left, -1)
        kept = left[left >= 0].astype("<u4").tobytes()
        ends = np.cumsum((left >= 0).sum(axis=1) * 4).tolist()
        return [kept[a:b] for a, b in zip([0, *ends], ends)]

    def _spelt(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts, cut where no pretoken is."""
        pretokens = list(map(PRETOKEN.findall, parts))
        ids = {p: self._words.get(p[1:]) if p[0] == " " else None for p in {p for some in pretokens for p in some}}
        todo = [p for p, x in ids.items() if x is None]
        ids.update(zip(todo, self.merge_all(list(map(str.encode, todo)))))
        return [b"".join(map(ids.__getitem__, some)) for some in pretokens]

    def _learn(self, found: set[str]) -> set[str]:
        """Puts the words among the known ones, each as it stands after a space; returns those that a space does not part."""
        if len(self._words) > self._half:
            self._before, self._words = self._words, {}
        known, older = self._words, self._before
        new = found.difference(known)
        if older:
            again = new.intersection(older)
            known.update(zip(again, map(older.__getitem__, again)))
            new -= again
        plain = [w for w in new if w.isascii() and w.isalpha()]
        known.update(zip(plain, self.merge_all([b" " + w.encode() for w in plain])))
        new.difference_update(plain)
        odd = {w for w in new if not w or w[0] in _SPACES or w[-1] in _SPACES}
        others = list(new - odd)
        known.update(zip(others, self._spelt(list(map(" ".__add__, others)))))
        return odd

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; special tokens in them are recognised."""
        pieces: list[tuple[int, str]] = []  # number of the text, and a plain part of it or a special token
        for k, text in enumerate(texts):
            special = self._split is not None and any(x in text for x in self.special)
            pieces += [(k, x) for x in self._split.split(text)] if special else [(k, text)]
        words = [[] if x in self.special else x.split(" ") for _, x in pieces]
        odd = self._learn(set().union(*words))
        known = self._words
        if odd:
            again = [k for k, w in enumerate(words) if not odd.isdisjoint(w)]
            for k in again:
                words[k] = _CUT.split(pieces[k][1])
            spaced = {w for k in again for w in words[k][1:] if w not in known}
            known = _Both(known, dict(zip(spaced, self._spelt(list(map(" ".__add__, spaced))))))
        # The first word of a part has no space before it.
        heads = list({w[0] for w in words if w})
        head = dict(zip(heads, self._spelt(heads)))
        out: list[list[bytes]] = [[] for _ in texts]
        for (k, piece), w in zip(pieces, words):
            if not w:
                out[k].append(self.special[piece].to_bytes(4, "little"))
            else:
                out[k].append(head[w[0]])
                out[k].extend(map(known.__getitem__, itertools.islice(w, 1, None)))
        return list(map(b"".join, out))

    def encode(self, text: str) -> bytes:
        """Ids of one whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens are kept, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


#: What ``tokenize`` can return, by name: the outputs themselves and digests of them.
OUTPUTS = {
    "ids": (T.BinaryType(), pa.binary(), lambda ids, text: ids),
    "decoded": (T.StringType(), pa.string(), lambda ids, text: text),
    "n_tokens": (T.LongType(), pa.int64(), lambda ids, text: len(ids) // 4),
    "ids_sha256": (T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(text.encode()).hexdigest()),
}


def tokenize(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encodes every whole text with the vocabulary at ``path``, decodes the ids again, returns ``keep`` and ``outputs``.

    ``ids`` are little-endian unsigned 32-bit integers.  Digests are taken of
    the ids and of the decoded text in the worker that made them, so that a
    query that wants only those does not ship texts.  Rows are independent: no
    shuffle; a worker holds one batch and bounded word caches.
    """
    small_batches(df.sparkSession)
    kept = [c for c in keep if c not in outputs]
    src = df.select(*kept, df[text_col].alias("__text"))
    schema = T.StructType([*src.select(*kept).schema.fields, *(T.StructField(n, OUTPUTS[n][0], True) for n in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            columns: list[list] = [[] for _ in outputs]
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for some in portions(texts):
                for ids in bpe.encode_all(some):
                    back = bpe.decode(ids)
                    for column, name in zip(columns, outputs):
                        column.append(OUTPUTS[name][2](ids, back))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, OUTPUTS[n][1]) for c, n in zip(columns, outputs))], names=[*kept, *outputs])

    return src.mapInArrow(run, schema)
