"""Token counts under a unigram model, by dynamic programming shared along a trie.

The distinct pre-tokens of a block go into a trie. A node's forward score is the best
total of piece scores over all ways to cut the characters from the root to it, and is
computed once for all pre-tokens with that prefix; at a terminal the number of pieces of
that best cut is stored. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from parcelwise.llm.common import CACHE_ENTRIES, map_texts, words_of

MARK = "▁"


class UnigramCounts:
    """Piece counts of words by the pieces of a sentencepiece file.

    The file ranks its pieces; a piece of rank r gets the score -log(r + 1) - 1, so that
    frequent and few pieces win. A character that no piece covers falls back to its UTF-8
    bytes, each a token with the lowest score of all. Of equal totals the cut with fewer
    tokens wins.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.scores = {x: -math.log(r + 1) - 1 for r, x in enumerate(names)}
        self.longest = max(map(len, names))
        self.byte_score = -math.log(len(names) + 1) - 1
        self.entries = entries
        self.counts: dict[bytes, int] = {}

    def learn(self, words: list[str]) -> list[int]:
        """Counts of `words`, which must be sorted: a depth-first walk of their trie.

        Neighbours share the nodes of their common prefix, which keep their scores; the
        walk holds the nodes from the root to where it is.
        """
        score, count, path, out = [0.0], [0], "", []
        pieces, longest = self.scores, self.longest
        for word in words:
            word = MARK + word
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, n = score[end - 1] + size * self.byte_score, count[end - 1] + size
                for start in range(max(0, end - longest), end):
                    own = pieces.get(word[start:end])
                    if own is not None:
                        total, many = score[start] + own, count[start] + 1
                        if total > best or total == best and many < n:
                            best, n = total, many
                score.append(best)
                count.append(n)
            path = word
            out.append(count[len(word)])
        return out

    def document(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))

    def documents(self, texts: list[str]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        if len(self.counts) > self.entries:
            self.counts = {}
        split = [words_of(x) for x in texts]
        new = {w for x in split for w in x}.difference(self.counts)
        found = sorted(w.decode("utf-8", "surrogatepass") for w in new)
        self.counts.update(zip((w.encode("utf-8", "surrogatepass") for w in found), self.learn(found)))
        return [(len(x), self.document(x)) for x in split]


_models: dict[str, UnigramCounts] = {}


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every document; no shuffle.

    Null and empty texts have no tokens; repeated rows each give a row; an empty table
    gives none.
    """

    def run(texts, others):
        if vocabulary not in _models:
            _models[vocabulary] = UnigramCounts(vocabulary)
        found = _models[vocabulary].documents(texts)
        return {"n_words": pa.array([a for a, _ in found], pa.int64()), "n_tokens": pa.array([b for _, b in found], pa.int64())}

    return map_texts(documents.select("doc_id", "text"), run, "n_words long, n_tokens long")


def query(spark: SparkSession, path: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
