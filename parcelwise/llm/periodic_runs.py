"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, of at least
max(LEAST, TIMES * q) words, that no neighbouring word extends. Each of its words stands
in it TIMES times or more, so a word that occurs less often within a segment lies in no
run of it and splits the segment. Splitting goes on until nothing changes; segments under
LEAST words are dropped.

The lag scan then goes through the surviving segments lag by lag. A run of TIMES * q words
holds TIMES multiples of q, so lag q compares only the words at multiples of q: all lags
together cost n log n comparisons. Places where TIMES - 1 of these pairs in a row are equal
are checked at more pairs and extended word by word. Lags go upwards, and a stretch of
(TIMES - 1) * q + 1 words inside a known run can only be a part of that run (both periods
fit into it, so their greatest common divisor is a period), so it is passed over. TIMES is
3 at least for this.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelwise.llm.common import map_texts, words_of

LEAST = 6
TIMES = 4

Run = tuple[int, int, int]


def split_rare(word: np.ndarray, segment: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Places and segment numbers of the words that are left when no word occurs fewer than
    `times` times in its segment and no segment has fewer than `least` words."""
    kinds = int(word.max(initial=0)) + 1
    done, at = [], np.arange(len(word))
    while len(at):
        size = np.bincount(segment)
        long = size[segment] >= least
        at, segment = at[long], segment[long]
        if not len(at):
            break
        _, where, count = np.unique(segment * kinds + word[at], return_inverse=True, return_counts=True)
        rare = count[where] < times
        split = np.bincount(segment[rare], minlength=int(segment[-1]) + 1) > 0
        stable = ~split[segment]
        if stable.any():
            done.append(at[stable])
        left = ~stable & ~rare
        # Segments are numbered anew: one ends where its neighbour is gone or of another segment.
        old, at = segment[left], at[left]
        segment = np.cumsum(np.concatenate(([0], (np.diff(at) != 1) | (np.diff(old) != 0)))) if len(at) else old
    places = [np.column_stack((x, np.full(len(x), i))) for i, x in enumerate(done)]
    return (np.concatenate(places)[:, 0], np.concatenate(places)[:, 1]) if places else (at, at)


def _back(x: np.ndarray, m: int, q: int) -> int:
    """The first place from which all words up to m equal the word q later."""
    step = 64
    while m > 0:
        a = max(0, m - step)
        bad = np.flatnonzero(x[a:m] != x[a + q : m + q])
        if len(bad):
            return a + int(bad[-1]) + 1
        m, step = a, 2 * step
    return 0


def _forth(x: np.ndarray, m: int, q: int) -> int:
    """The first place from m on whose word differs from the word q later, or has none."""
    step, end = 64, len(x) - q
    while m < end:
        b = min(end, m + step)
        bad = np.flatnonzero(x[m:b] != x[m + q : b + q])
        if len(bad):
            return m + int(bad[0])
        m, step = b, 2 * step
    return end


def scan_lags(x: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs (start, length, period) of x, which holds segments of falling sizes without
    a common code."""
    ends = np.cumsum(sizes)
    reach = np.zeros(len(x), np.int64)  # the furthest end of the known runs over a place
    found, count, q = [], len(sizes), 0
    while True:
        q += 1
        need = max(least, times * q)
        count = int(np.searchsorted(-sizes[:count], -need, side="right"))
        if not count:
            return found
        y = x[: ends[count - 1] : q]
        same = y[1:] == y[:-1]
        hit = same[: max(0, len(same) - times + 2)]
        for k in range(1, times - 1):
            hit = hit & same[k : k + len(hit)]
        m = np.flatnonzero(hit) * q
        span = (times - 1) * q
        m = m[reach[m] <= m + span]
        # A run that has its first multiple of q at m holds the pairs from m to m + (times - 2) * q.
        a, b = 1, 2
        while len(m) and a <= (times - 2) * q:
            m = m[x[m + a] == x[m + a + q]]
            a, b = b, a + b
        while len(m):
            start, end = _back(x, int(m[0]), q), _forth(x, int(m[0]), q) + q
            if end - start >= need and end > m[0] + span:  # else the run, if any, has another place
                found.append((start, end - start, q))
                reach[start:end] = np.maximum(reach[start:end], end)
            m = m[np.searchsorted(m, max(int(m[0]) + 1, end - span)) :]


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs (start, length, period) of each text's words, by start, then period."""
    if times < 3:
        raise ValueError("runs hold their period three times at least")
    ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    counts = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    at, group = split_rare(word, text, least, times)
    out: list[list[Run]] = [[] for _ in texts]
    if not len(at):
        return out
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(group) != 0) | (np.diff(text[at]) != 0))))
    sizes = np.diff(np.append(cut, len(at)))
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], at[cut[order]]  # where each segment begins among all words
    offset = np.cumsum(sizes) - sizes
    place = np.repeat(begin - offset, sizes) + np.arange(len(at))
    code = np.repeat(np.arange(len(sizes)), sizes) * len(ids) + word[place]
    x = np.unique(code, return_inverse=True)[1]
    for start, length, period in scan_lags(x, sizes, least, times):
        where = int(place[start])
        t = int(text[where])
        out[t].append((where - int(first[t]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words outside of runs and those of each run's first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(
    documents: DataFrame,
    least: int = LEAST,
    times: int = TIMES,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period) and collapsed, the
    text with each run cut to its first period, of every document (doc_id, text, others).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; collapsed joins them by single spaces.
    `change` may rewrite a document's words, from its doc_id, before the search. Null and
    empty texts have no runs and collapse to the empty text; repeated rows each give a row;
    an empty table gives none. A text is searched whole in its task, in memory in
    proportion to its length.
    """

    def run(texts, others):
        words = [words_of(t) for t in texts]
        if change:
            words = [change(k, w) for k, w in zip(others["doc_id"].to_pylist(), words, strict=True)]
        found = find_runs(words, least, times)
        names = ("start", "length", "period")
        left = [b" ".join(collapse(w, r)) for w, r in zip(words, found, strict=True)]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        return {
            "runs": pa.array([[dict(zip(names, r)) for r in runs] for runs in found], kind),
            "collapsed": pa.array(left, pa.binary()).cast(pa.string()),
        }

    kind = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_texts(documents.select("doc_id", "text"), run, kind)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; the earlier in the list among equals."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def repeated_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail, for one document in ten by the crc32 of its doc_id;
    others, and those without a doc_id, as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    full, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * full + words[a : a + rest]


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the strongest run, and digests of all runs and the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    return summary(periodic_runs(spark.read.parquet(f"{path}/documents.parquet"), change=repeated_tail))
