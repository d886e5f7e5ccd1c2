"""Byte-level BPE of a public vocabulary, merged through a segment tree.

A text is cut into pre-tokens by the vocabulary's published pattern.  Each distinct pre-token is merged once per worker:
a segment tree is laid over the ranks of its adjacent pairs, its root names the leftmost pair of lowest rank, and every
merge updates three leaves in logarithmic time, so that a pre-token of n bytes costs O(n log n) however long it is.
The trees of all new pre-tokens of a slice are the rows of one array and advance together, one merge a step.
Merged pre-tokens are kept in a bounded table, as words repeat.

Defined results: an empty and a null text have the empty list; the names of special tokens are ordinary text; lone
surrogates cannot occur in Spark strings.  Every row gives exactly one row, repeated rows included.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threshline.llm.batches import slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where a text is ASCII, for the faster engine.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pre-tokens remembered per worker; bounds memory and changes no result.
MEMO_ENTRIES = 500_000
#: Trees of up to 2 ** ROW_BITS leaves advance together as rows of an array.
ROW_BITS = 7
#: Leaves hold rank << SHIFT | position; NOTHING is above every rank.
SHIFT, MASK, NOTHING = 36, (1 << 36) - 1, 1 << 24


class SegmentTreeBpe:
    """Segment trees over the pair ranks of many pre-tokens at once, one row of an array each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        order = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(order, np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([pairs[k] for k in order.tolist()], np.int64), NOTHING)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NOTHING where the two do not merge or one of them is -1."""
        keys = left << 20 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], NOTHING)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token.  Rows are grouped by tree width, and groups bounded, so memory follows the input."""
        out: list[list[int]] = [[]] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            groups.setdefault(max(1, (len(piece) - 2).bit_length()), []).append(k)
        for bits, members in groups.items():
            if bits > ROW_BITS:
                for k in members:
                    out[k] = self._merge_long(pieces[k], 1 << bits)
                continue
            step = max(1, (1 << 20) >> bits)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self._merge_rows([pieces[k] for k in part], 1 << bits)):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        count, sizes = len(pieces), np.array([len(p) for p in pieces])
        columns = np.arange(width + 2)
        ids = np.full((count, width + 2), -1, np.int64)
        ids[columns < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(columns + 1, (count, 1)), np.tile(columns - 1, (count, 1))
        # A leaf packs rank and position: the root is the leftmost pair of the lowest rank.
        tree = np.empty((count, 2 * width), np.int64)
        tree[:, width:] = self.rank(ids[:, :width], ids[:, 1 : width + 1]) << SHIFT | columns[:width]
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        live = np.arange(count)
        while True:
            root = tree[live, 1]
            going = root < NOTHING << SHIFT
            live, root = live[going], root[going]
            if not len(live):
                break
            at, merged = root & MASK, root >> SHIFT
            gone = after[live, at]
            following = after[live, gone]
            ids[live, at], ids[live, gone], after[live, at] = merged, -1, following
            before[live, np.minimum(following, width + 1)] = at
            previous = before[live, at]
            left = np.where(previous >= 0, ids[live, previous], -1)
            leaves = np.stack([at, np.minimum(gone, width - 1), np.maximum(previous, 0)])
            values = np.stack([self.rank(merged, ids[live, np.minimum(following, width + 1)]), np.full(len(live), NOTHING), self.rank(left, merged)]) << SHIFT | leaves
            # A leaf that is out of reach keeps its value: the last symbol has none, nor has the place before the first.
            valid = np.stack([at < width, gone < width, previous >= 0])
            rows = np.broadcast_to(live, leaves.shape)
            tree[rows[valid], width + leaves[valid]] = values[valid]
            node = width + leaves
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


    def _merge_long(self, piece: bytes, width: int) -> list[int]:
        """The same tree for one long pre-token: too few rows of that width come together to advance as an array."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        leaves = np.full(width, NOTHING << SHIFT, np.int64)
        leaves[: n - 1] = self.rank(ids[:-1], ids[1:]) << SHIFT | np.arange(n - 1)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [0, *chain.from_iterable(level.tolist() for level in reversed(levels))]
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        empty, rank_of = NOTHING << SHIFT, self.pairs.get

        def put(i: int, rank: int | None) -> None:
            k = width + i
            tree[k] = empty if rank is None else rank << SHIFT | i
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low

        while tree[1] < empty:
            at, merged = tree[1] & MASK, tree[1] >> SHIFT
            gone = after[at]
            following, previous = after[gone], before[at]
            ids[at], ids[gone], after[at] = merged, -1, following
            if gone < n - 1:
                put(gone, None)
            if following < n:
                before[following] = at
            put(at, rank_of(merged << 20 | ids[following]) if following < n else None)
            if previous >= 0:
                put(previous, rank_of(ids[previous] << 20 | merged))
        return [x for x in ids if x >= 0]


class Encoder:
    """Pre-tokens, the trees, and the bounded table of pre-tokens merged so far (offsets into one array of ids)."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.trees = SegmentTreeBpe(ranks)
        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts: list[int] = [0]

    def learn(self, words: list[str]) -> None:
        merged = self.trees.merge([w.encode("utf-8") for w in words])
        for word, ids in zip(words, merged):
            self.known[word] = len(self.starts) - 1
            self.starts.append(self.starts[-1] + len(ids))
        new = np.fromiter(chain.from_iterable(merged), np.int32, self.starts[-1] - self.used)
        while self.starts[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.starts[-1]] = new
        self.used = self.starts[-1]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        if len(self.known) > MEMO_ENTRIES or self.used > 8 * MEMO_ENTRIES:
            self.forget()
        cuts = [(self.cut_ascii(t) if t.isascii() else self.cut(t)) if t else [] for t in texts]
        words = list(chain.from_iterable(cuts))
        self.learn([w for w in dict.fromkeys(words) if w not in self.known])
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = np.array(self.starts, np.int64)
        begin, length = starts[which], starts[which + 1] - starts[which]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(begin - (ends - length), length)]
        word_ends = np.cumsum([len(c) for c in cuts])
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[word_ends]]) if texts else np.zeros(1, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per Python worker and vocabulary; the file must exist on every executor."""
    if vocabulary not in _encoders:
        if not os.path.exists(vocabulary):
            raise FileNotFoundError(f"vocabulary {vocabulary} is not on this executor")
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, in one narrow pass without a shuffle; null and empty texts have []."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                ids, offsets = enc.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists], [key, "ids"])

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def decoded_digest(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text_md5): the MD5 of the bytes that the ids stand for, that is, of the text they were made from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(vocabulary, "rb") as lines:
            words = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            digests = [hashlib.md5(b"".join(map(words.__getitem__, flat[a:b].tolist()))).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], [key, "text_md5"])

    schema = T.StructType([encoded.schema[key], T.StructField("text_md5", T.StringType())])
    return encoded.select(key, ids).mapInArrow(run, schema)
