import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
from edge import none, rows
from tokenizers import Tokenizer

from parcelwise.llm import binary_ids, merge_replay, packing, token_counts
from parcelwise.llm.common import ChunkEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
MULTI, PIECE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


def odd_texts(n=4000):
    rng = random.Random(5)
    chars = " \n\t  ab'sé|1.2<|endoftext|> 　\x1c\x85ñ, Aßğ aaththe"
    made = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    letters = "abcXYZÀßéñſİıŉǅǰʹ.!;'" + "e" * 9
    made += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(n)]
    return made + ["a" * 3000 + "ab" * 900, "", " ", "\n"]


def corpus(data, n=60):
    return pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()[:n]


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_encode_as_whole_texts(path, data):
    texts = odd_texts() + corpus(data)
    want = [x.ids for x in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(path).encode(texts)] == want


def test_merge_replay_is_the_rule(data):
    texts = odd_texts() + corpus(data)
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = merge_replay.DocumentEncoder(MULTI, P.PATTERN)
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode_ordinary(x) for x in texts]
    assert [own.replay.decode(x).decode() for x in got] == texts


def test_late_low_ranks_are_done_word_by_word(tmp_path):
    # b+c comes first; then a+bc makes a token with a lower rank than the next merge's.
    tokens = [bytes([i]) for i in range(256)] + [b"bcd", b"ab", b"bc", b"cd", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = merge_replay.MergeReplay(str(path))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    assert own.encode(words) == [own.encode_one(w) for w in words]


def test_merge_replay_edges(spark):
    got = merge_replay.encode_documents(rows(spark), MULTI).collect()
    want = {(r.doc_id, r.text or "") for r in rows(spark).collect()}
    assert len(got) == 9
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want}
    assert merge_replay.encode_documents(none(spark), MULTI).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in (
        np.zeros(0, "<u4"),
        np.array([7], "<u4"),
        np.full(300, 4_294_967_295, "<u4"),
        rng.integers(0, 50_000, 1000).astype("<u4"),
        rng.integers(0, 2**32, 517).astype("<u4"),
        np.where(rng.random(2000) < 0.05, rng.integers(0, 2**32, 2000), rng.integers(90, 99, 2000)).astype("<u4"),
    ):
        data = binary_ids.write_segment([(1, ids.tobytes()), (None, b"")])
        own = binary_ids.Segment(data)
        assert own.n_ids == len(ids) and own.nulls.tolist() == [0, 1]
        assert (own.read(0, len(ids)) == ids).all()
        assert (own.read(len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2]).all()
        if len(ids):
            last = binary_ids.unpack_block(own.data, own.body + int(own.starts[-1]))
            at = len(ids) - 1
            assert last[at % binary_ids.BLOCK] == ids[at]


@pytest.mark.parametrize("segment_ids", [200, 1_000_000])
def test_id_files(spark, data, segment_ids):
    documents = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    got = sorted(binary_ids.read_ids(binary_ids.write_ids(documents, BYTE, segment_ids=segment_ids), True).collect())
    t, start = tokenizer(BYTE), 0
    for r, row in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = np.array(t.encode(row.text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (row.doc_id, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_id_file_edges(spark):
    got = binary_ids.read_ids(binary_ids.write_ids(rows(spark), BYTE)).collect()
    assert len(got) == 9
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 3, 4, 5, 5, 7, 8]
    assert [r.n_tokens for r in order][2:4] == [1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:]))
    assert binary_ids.read_ids(binary_ids.write_ids(none(spark), BYTE)).count() == 0


def viterbi(word, model):
    """Scores and counts of one word by itself."""
    word = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + size * model.byte_score, -(-best[end - 1][1] + size))]
        for start in range(end):
            if word[start:end] in model.scores:
                ways.append((best[start][0] + model.scores[word[start:end]], best[start][1] - 1))
        best.append(max(ways))
    return -best[-1][1]


def test_trie_counts(spark, data):
    model = token_counts.UnigramCounts(PIECE)
    texts = corpus(data, 20) + odd_texts(300)
    words = sorted({w.decode() for t in texts for w in t.encode().split()})
    words = [w for w in words if len(w) < 100]
    assert [viterbi(w, model) for w in words] == model.learn(words)
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert math.isclose(model.scores[pieces.id_to_piece(259)], -1.0)


def test_trie_count_edges(spark):
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.count_tokens(rows(spark), PIECE).collect()}
    assert {(2, 0, 0), (3, 0, 0), (7, 0, 0)} <= got
    assert token_counts.count_tokens(rows(spark), PIECE).count() == 9
    assert token_counts.count_tokens(none(spark), PIECE).count() == 0


def slow_packing(lengths, capacity):
    """Sum of squares as stated, over all gaps."""
    gaps, out = [], []
    for s in lengths:
        counts = {}
        for g in gaps:
            if g:
                counts[g] = counts.get(g, 0) + 1
        square = lambda c: sum(v * v for v in c.values())
        ways = []
        for g in sorted({*counts, capacity}, key=lambda g: (g == capacity and not counts.get(g), g)):
            if g < s:
                continue
            new = dict(counts)
            if g in counts:
                new[g] -= 1
            if g - s:
                new[g - s] = new.get(g - s, 0) + 1
            ways.append(square(new))
        out.append(min(ways))
        yield out[-1]
        pick = next(g for g, v in zip([g for g in sorted({*counts, capacity}, key=lambda g: (g == capacity and not counts.get(g), g)) if g >= s], ways) if v == min(ways))
        if pick in counts:
            gaps[gaps.index(pick)] = pick - s
        else:
            gaps.append(pick - s)


def test_sum_of_squares():
    rng = random.Random(4)
    for capacity in (10, 37):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), capacity)
        gaps, got = {}, []
        for s, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
            assert at == capacity - gaps.get(b, capacity) and gaps.get(b, capacity) >= s
            gaps[b] = gaps.get(b, capacity) - s
            counts = {}
            for g in gaps.values():
                if g:
                    counts[g] = counts.get(g, 0) + 1
            got.append(sum(v * v for v in counts.values()))
        assert got == list(slow_packing(lengths, capacity))


def test_packing(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    got = packing.pack_documents(documents, WORD, shard_pieces=60).toPandas()
    t = tokenizer(WORD)
    for r in documents.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        own = got[got.doc_id == r.doc_id].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)]
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 4096
    one = packing.pack_documents(documents, WORD).toPandas()
    assert one.sequence_id.nunique() <= 1.05 * -(-one.length.sum() // 4096) + 1


def test_packing_edges(spark):
    got = packing.pack_documents(rows(spark), WORD, with_ids=True).collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 7, 8}
    assert [r.length for r in got if r.doc_id in (2, 3, 7)] == [1, 1, 1]
    assert sum(r.doc_id == 5 for r in got) == 2 and all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack_documents(none(spark), WORD).count() == 0
