"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a block of documents lie end to end in one array of token
ids. An inverted index holds, for each merge, the positions of the token pairs it joins.
The merges are applied in rank order, each at all its positions at once, and only the
pairs with the merged tokens' neighbours are looked up again and entered. Each document
is then put together from its pre-tokens' ids.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm.common import CACHE_ENTRIES, cut, map_texts

_NONE = np.int64(1) << 40


class MergeReplay:
    """Encodes sets of pre-tokens by the ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.size = len(self.tokens)
        pairs = [
            (self.ranks[t[:i]] * self.size + self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes; _NONE where it makes none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths[lengths > 0])
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE)  # of the pair that begins at a position
        odd: set[int] = set()

        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            found = rank[at]
            at = at[found < _NONE]
            if not len(at):
                return
            found = rank[at]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(found[np.array(starts[:-1])].tolist(), starts[:-1], starts[1:], strict=True):
                index.setdefault(r, []).append(at[a:b])

        paired = np.flatnonzero(after >= 0)
        rank[paired] = self._rank_of(ids[paired], ids[after[paired]])
        enter(paired)
        for r in range(self.size):
            lists = index.pop(r, None)
            if lists is None:
                continue
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                joined = after[at[:-1]] == at[1:]
                if joined.any():  # overlapping pairs: the left one goes first
                    take, last = np.ones(len(at), bool), -1
                    for i in np.flatnonzero(joined).tolist():
                        if take[i]:
                            take[i + 1] = False
                    at = at[take]
            gone = after[at]
            alive[gone] = False
            ids[at] = r
            rank[gone] = _NONE
            behind = after[gone]
            after[at] = behind
            has = behind >= 0
            before[behind[has]] = at[has]
            rank[at] = _NONE
            right = at[has]
            rank[right] = self._rank_of(ids[right], ids[behind[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._rank_of(ids[left], ids[after[left]])
            near = np.concatenate((right, left))
            early = near[rank[near] < r]
            if len(early):  # a lower rank appears late: such words are done one by one
                odd.update(word[early].tolist())
                rank[early] = _NONE
            enter(near)
        kept = np.flatnonzero(alive)
        data = ids[kept].astype("<u4").tobytes()
        ends = np.searchsorted(word[kept], np.arange(len(words)), side="right").tolist()
        out, start = [], 0
        for end in ends:
            out.append(data[4 * start : 4 * end])
            start = end
        for w in odd:
            out[w] = self.encode_one(words[w])
        return out

    def encode_one(self, word: bytes) -> bytes:
        """One word by the rule itself: the lowest rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            r, i = min(found)
            if r == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return np.array([self.ranks[p] for p in parts], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class DocumentEncoder:
    """Encodes and decodes texts; keeps the ids of chunks seen before."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        self.replay = MergeReplay(path)
        self.pattern = regex.compile(pattern)
        self.entries = entries
        self.heads: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}
        self.line = self._learned(["\n"])[0]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: each match of the pattern is a pre-token, encoded once for all."""
        parts = [[x.encode() for x in self.pattern.findall(c)] for c in chunks]
        words = sorted({w for p in parts for w in p})
        ids = dict(zip(words, self.replay.encode(words), strict=True))
        return [b"".join([ids[w] for w in p]) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.heads) + len(self.tails) > self.entries:
            self.heads, self.tails = {"": b""}, {}
        parts = [cut(x) for x in texts]
        heads: set[str] = set()
        tails: set[str] = set()
        for lines in parts:
            for head, rest in lines:
                heads.add(head)
                tails.update(rest)
        new_heads, new_tails = sorted(heads.difference(self.heads)), sorted(tails.difference(self.tails))
        ids = self._learned(new_heads + [" " + x for x in new_tails])
        self.heads.update(zip(new_heads, ids))
        self.tails.update(zip(new_tails, ids[len(new_heads) :]))
        head_of, get = self.heads.__getitem__, self.tails.__getitem__
        return [self.line.join([head_of(h) + b"".join(map(get, rest)) for h, rest in lines]) for lines in parts]


_encoders: dict[tuple[str, str], DocumentEncoder] = {}


def encode_documents(
    documents: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (binary, u32).

    One pass without a shuffle: each task replays the merges over its own blocks' distinct
    pre-tokens and keeps what it has learned for the next block. Null texts are empty: no
    tokens. Repeated rows each give a row; an empty table gives none.
    """

    def run(texts, others):
        key = (ranks, pattern)
        if key not in _encoders:
            _encoders[key] = DocumentEncoder(ranks, pattern)
        own = _encoders[key]
        ids = own.encode(texts)
        out = {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(own.replay.decode(x)).hexdigest() for x in ids],
        }
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    return map_texts(
        documents.select("doc_id", "text"),
        run,
        "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else ""),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.parquet(f"{path}/documents.parquet")
    return encode_documents(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)
