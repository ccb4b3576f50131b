"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

A document becomes a row of statistics of its whole text. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each partition sums its part of
the normal equations, Spark adds the parts, and the driver solves one system of a fixed
size. Scores are calibrated on a fold that the fit did not see.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm.common import map_texts
from parcelwise.llm.perplexity import repeat_words
from parcelwise.session import durable

FEATURES = 256
RIDGE = 1e-3
SEED = 7
THRESHOLD = 0.3
FOLDS = 5
#: Bins of the raw score between -1 and 2 in which labels are counted for calibration.
BINS = 3000

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "lower", "upper", "digits",
    "high_bytes", "symbols", "stops", "bangs", "bars", "other_punctuation", "distinct_words", "distinct_lines",
    "line_words", "repeat_windows", "deflated", "end_marks", "end_bangs", "end_symbols", "capital_words",
    "short_words", "long_words", "commonest",
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, m = len(data), len(words)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda chars: int(byte[list(chars)].sum())
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    last = np.bincount(np.fromiter((w[-1] for w in words), np.uint8, m), minlength=256)
    first = np.bincount(np.fromiter((w[0] for w in words), np.uint8, m), minlength=256)
    ends = lambda chars: int(last[list(chars)].sum()) / m
    punctuation = count(range(33, 48)) + count(range(58, 65)) + count(range(91, 97)) + count(range(123, 127))
    symbols = count(b"#*$%&<>")
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(lines)), math.log1p(n / m), math.log1p(float(sizes.std())),
        count(range(97, 123)) / n, count(range(65, 91)) / n, count(range(48, 58)) / n, count(range(128, 256)) / n,
        math.sqrt(symbols / n), count(b".,;:") / n, math.sqrt(count(b"!?") / n), math.sqrt(count(b"|") / n),
        math.sqrt(max(0, punctuation - symbols - count(b".,;:!?|")) / n), len(kinds) / m, len(set(lines)) / max(1, len(lines)),
        math.log1p(m / max(1, len(lines))), repeat_words(words) / m, len(zlib.compress(data, 1)) / n, ends(b".,;:"),
        math.sqrt(ends(b"!?")), math.sqrt(ends(b"#*$%&<>|")), int(first[65:91].sum()) / m,
        int((sizes <= 3).sum()) / m, int((sizes >= 12).sum()) / m, max(kinds.values()) / m,
    ]


def document_statistics(documents: DataFrame) -> DataFrame:
    """The other columns and x, the statistics as an array of doubles."""
    return map_texts(documents, lambda texts, _: {"x": pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))}, "x array<double>")


class Kernel:
    """Standardises statistics and maps them to Fourier features, a bias and themselves."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.w = rng.normal(0, 1 / math.sqrt(d), (d, features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = math.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([np.ones((len(x), 1)), z, waves])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def fit_ridge(rows: DataFrame, kernel: Kernel, ridge: float = RIDGE) -> np.ndarray:
    """Weights from rows (x, y). A partition sends one row of sums for each feature; the sums
    of a feature are added in one task, and the driver gets a matrix of a fixed size."""

    def part(batches):
        sums = None
        for batch in batches:
            if batch.num_rows:
                z = kernel(_matrix(batch))
                own = np.hstack([z, batch.column("y").to_numpy()[:, None]])
                sums = z.T @ own if sums is None else sums + z.T @ own
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "v": pa.array([r.tobytes() for r in sums], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "v": [sum(np.frombuffer(v) for v in rows["v"]).tobytes()]})

    parts = rows.mapInArrow(part, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary")
    table = sorted((r.i, r.v) for r in parts.collect())
    if not table:
        return None
    m = np.array([np.frombuffer(v) for _, v in table])
    a, y = m[:, :-1], m[:, -1]
    penalty = ridge * a[0, 0] * np.eye(len(a))
    penalty[0, 0] = 0
    return np.linalg.solve(a + penalty + 1e-9 * np.eye(len(a)), y)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over means y of n rows at x (ascending): places and levels."""
    out: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        out.append([xi * ni, yi * ni, ni])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            a = out.pop()
            out[-1] = [p + q for p, q in zip(out[-1], a, strict=True)]
    return np.array([a / c for a, _, c in out]), np.array([b / c for _, b, c in out])


def fold():
    """crc32 of the doc_id's text, modulo FOLDS."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def score_documents(documents: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, empty texts too.

    Fold 0 is held out; fold 1 calibrates; the others fit. Labels of null or of documents
    that are not there are left out; without usable labels every score is 0.5. A null text
    is empty; a null doc_id is in no fold and counts as not held out; repeated rows each
    give a row; an empty table gives none.
    """
    stats = durable(document_statistics(documents.select("doc_id", "text")))
    d = len(STATISTICS)
    at = [F.col("x")[i] for i in range(d)]
    got = stats.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    kernel = Kernel(np.array([got[f"m{i}"] or 0.0 for i in range(d)]), np.array([got[f"s{i}"] or 0.0 for i in range(d)]), features)
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null").distinct()
    labelled = durable(known.where(fold() != 0).join(stats, "doc_id").withColumn("fold", fold()).select("fold", "y", "x"))
    weights = fit_ridge(labelled.where("fold > 1"), kernel, ridge)
    raw = lambda x: np.clip(kernel(x) @ weights, -1, 2)
    places, levels = np.array([0.0]), np.array([0.5])
    if weights is not None:

        def score(batches):
            for batch in batches:
                if batch.num_rows:
                    bins = np.floor((raw(_matrix(batch)) + 1) / 3 * BINS).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "y": batch.column("y")})

        counted = labelled.where("fold = 1").mapInArrow(score, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
        rows = sorted((r.bin, r.y, r.n) for r in counted.collect())
        if rows:
            b, y, n = np.array(rows, float).T
            places, levels = isotonic((b + 0.5) / BINS * 3 - 1, y / n, n)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                value = np.full(batch.num_rows, 0.5) if weights is None else np.interp(raw(_matrix(batch)), places, levels)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.clip(value, 0, 1))})

    scored = stats.mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
