"""Quality rules with n-gram perplexity under a modified Kneser-Ney model.

The model predicts each character of a text's words, joined by single spaces, from the
three before it, for each language of its own; contexts run across words. Characters are
not folded, so the n-grams grow with the corpus. Spark counts them over every word of every
document, derives continuation counts, discounts and probabilities level by level, and
stores log probabilities as whole units of 2**-32, so sums don't depend on their order.

The FREQUENT most frequent n-grams at most, a fixed bound, go to the tasks as sorted arrays of
hashes; a task adds them up in place. The others of a document are joined to the stored
model. Both ways give the same sums. A document whose log perplexity lies outside its
language's band, set by the quartiles over all documents, is rejected, and so is one that
fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelwise.llm.common import blocks, map_texts
from parcelwise.session import durable

ORDER = 4
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters that count as symbols.
MARKS = "#*$%&|<>"
#: A band reaches so many interquartile ranges of its language beyond the quartiles.
BAND_RANGES = 4.0
#: N-grams that are broadcast at most; the rest is joined.
FREQUENT = 1_000_000
#: Stands before a text; no word holds it.
START = "\n"
#: Log probabilities are whole multiples of 1 / UNIT.
UNIT = 2.0**32
#: Quartiles are those of log perplexities in steps of 1 / STEPS.
STEPS = 10_000
#: Characters looked at together.
SLICE = 1 << 20
#: A symbol's number in a packed n-gram has so many bits at most.
BITS = 16


def lang_key(name: str = "lang") -> Column:
    """A language as a string that is never null; null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def symbols(words: list[bytes]) -> bytes:
    """What the model predicts of a text, behind ORDER - 1 start marks."""
    return START.encode() * (ORDER - 1) + b" ".join(words) + b" " if words else b""


def points(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts).decode().encode("utf-32-le"), "<u4")


def count_array(text: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The distinct n-grams of code points `text` that end in no start mark, and how often
    each occurs. The symbols of a slice are numbered, so that an n-gram is one integer."""
    found = np.flatnonzero(np.bincount(text)) if len(text) else np.zeros(0, np.int64)
    if len(found) > 1 << BITS:  # a short slice can't hold so many
        step = (1 << BITS) - ORDER
        for at in range(0, len(text) - ORDER + 1, step):
            yield from count_array(text[at : at + step + ORDER - 1])
        return
    bits = max(1, (len(found) - 1).bit_length())
    kind = np.uint32 if bits * ORDER <= 32 else np.uint64
    table = np.zeros(found[-1] + 1 if len(found) else 1, kind)
    table[found] = np.arange(len(found), dtype=kind)
    number = table[text]
    size = len(text) - ORDER + 1
    code = np.zeros(max(size, 0), kind)
    for i in range(ORDER):
        code = (code << kind(bits)) | number[i : i + size]
    keys, n = np.unique(code[text[ORDER - 1 :] != ord(START)], return_counts=True)
    shifts = np.arange(ORDER - 1, -1, -1, dtype=kind) * kind(bits)
    spelt = found[((keys[:, None] >> shifts) & kind((1 << bits) - 1)).astype(np.int64)]
    joined = spelt.astype("<u4").tobytes().decode("utf-32-le")
    yield [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], n


def count_grams(documents: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in each language; lang is a lang_key."""

    def run(batches):
        for rows, texts in blocks(batches, 4 * SLICE):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(symbols(text.encode().split()))
            for lang, parts in by_lang.items():
                for grams, n in count_array(points(parts)):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(n, pa.int64())})

    part = documents.select(lang_key().alias("lang"), "text").mapInArrow(run, "lang string, gram string, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def continuations(grams: DataFrame, k: int) -> DataFrame:
    """(lang, gram, n) of level k from level k + 1: how many different symbols stand before
    an n-gram, or how often it occurs where it opens a text."""
    low = F.substring("gram", 2, k)
    found = grams.groupBy("lang", low.alias("gram")).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    first = F.col("gram").startswith(START)
    return found.select("lang", "gram", F.when(first, F.col("total")).otherwise(F.col("kinds")).alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts for counts 1, 2 and 3 or more.
    Where the counts of counts don't allow the estimate, a half of each step. Stored, so that
    Spark sees its size and doesn't move n-grams by language to join it."""
    n = {i: F.count_if(F.col("n") == i).cast("double") for i in range(1, 5)}
    found = grams.groupBy("lang").agg(*[n[i].alias(f"n{i}") for i in n])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = (F.col("n1") > 0) & (F.col("n2") > 0)
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        held = F.least(F.greatest(d, F.lit(0.0)), F.lit(float(i)))
        out.append(F.when(known & (F.col(f"n{i}") > 0), held).otherwise(i - 0.5).alias(f"d{i}"))
    return durable(found.select("lang", *out))


def probabilities(grams: DataFrame, k: int, lower: DataFrame | None) -> DataFrame:
    """(lang, gram, n, p) of level k; lower is level k - 1, without one all symbols of the
    language and one more are alike."""
    context = F.substring("gram", 1, k - 1)
    rows = grams.withColumn("context", context)
    sums = rows.groupBy("lang", "context").agg(
        F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"k{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("k3")
    )
    held = sum(F.col(f"d{i}") * F.col(f"k{i}") for i in (1, 2, 3))
    sums = sums.join(discounts(grams), "lang").withColumn("weight", held / F.col("total"))
    own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.join(sums, ["lang", "context"]).withColumn("own", (F.col("n") - own) / F.col("total"))
    if lower is None:
        size = durable(grams.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("low")))
        rows = rows.join(size, "lang")
    else:
        rows = rows.withColumn("tail", F.substring("gram", 2, k - 1))
        rows = rows.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("low")), ["lang", "tail"])
    return rows.select("lang", "gram", "n", (F.col("own") + F.col("weight") * F.col("low")).alias("p"))


def train(documents: DataFrame) -> DataFrame:
    """(lang, gram, n, log_p) of every n-gram of the documents, a stored table; log_p counts
    units of 1 / UNIT."""
    levels = {ORDER: durable(count_grams(documents))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = durable(continuations(levels[k + 1], k))
    found = None
    for k in range(1, ORDER + 1):
        found = probabilities(levels[k], k, found)
        if k < ORDER:
            found = durable(found)
    return durable(found.select("lang", "gram", "n", F.round(F.log("p") * UNIT).cast("long").alias("log_p")))


def frequent(model: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent n-grams of the model, `most` (FREQUENT) at most: those with a count
    above a bound that a histogram in steps of an eighth of a power of two gives."""
    most = FREQUENT if most is None else most
    step = F.floor(F.log2("n") * 8)
    above, bound = 0, None
    for r in model.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        above += r["count"]
        if above > most:
            break
        bound = r["step"]
    return model.where(step >= bound) if bound is not None else model.limit(0)


#: Odd multipliers of the symbols of an n-gram; their products add up to its hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the n-gram at each place of `text` where one ends."""
    size = len(text) - ORDER + 1
    out = np.zeros(max(size, 0), np.uint64)
    wide = text.astype(np.uint64) + np.uint64(1)
    for i in range(ORDER):
        out += wide[i : i + size] * _MIX[i]
    return out ^ (out >> np.uint64(32))


class SortedHashes:
    """Sorted hashes, their log_p, and where the hashes of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = np.append(keys, np.uint64(2**64 - 1)), np.append(logs, 0)
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.size = len(keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes and whether they are known."""
        place = self.first[(h >> self.shift).astype(np.int64)]
        hit = self.keys[place] == h
        rest = np.flatnonzero(~hit)
        place[rest] = np.searchsorted(self.keys, h[rest])
        hit[rest] = self.keys[place[rest]] == h[rest]
        return place, hit & (place < self.size)


def sorted_arrays(rows: pa.Table) -> dict[str, SortedHashes]:
    """The arrays of each language. N-grams that share a hash are left out: they are joined."""
    out = {}
    table = rows.to_pandas()
    for lang, part in table.groupby("lang"):
        code = hashes(points([g.encode() for g in part["gram"]]))[::ORDER]
        keys, at, n = np.unique(code, return_index=True, return_counts=True)
        out[lang] = SortedHashes(keys[n == 1], part["log_p"].to_numpy(np.int64)[at[n == 1]])
    return out


def look_up(parts: list[bytes], known: SortedHashes | None) -> tuple[np.ndarray, list[dict[str, int]]]:
    """For each part (`symbols` of a text): the sum of log_p over its n-grams found in the
    arrays, and how often each of the others occurs."""
    texts = [p.decode() for p in parts]
    ends = np.cumsum([len(t) for t in texts])
    whole = "".join(texts)
    text = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    value = np.zeros(len(text) + 1, np.int64)  # one more, for reduceat
    others: list[dict[str, int]] = [{} for _ in parts]
    for at in range(0, len(text) - ORDER + 1, SLICE):
        piece = text[at : at + SLICE + ORDER - 1]
        h, real = hashes(piece), piece[ORDER - 1 :] != ord(START)
        hit = np.zeros(len(h), bool)
        if known:
            place, hit = known.find(h)
            hit &= real
            value[at + ORDER - 1 : at + ORDER - 1 + len(h)] = np.where(hit, known.logs[place], 0)
        missed = np.flatnonzero(real & ~hit) + at
        for i, of in zip(missed.tolist(), np.searchsorted(ends, missed + ORDER - 1, "right").tolist(), strict=True):
            gram = whole[i : i + ORDER]
            others[of][gram] = others[of].get(gram, 0) + 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    total = np.add.reduceat(value, starts) if len(parts) else np.zeros(0, np.int64)
    return total, others


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    if len(ids) > len(words) - window:  # too few repeated words for a repeated window
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29))
        mixed += (code[i : i + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + window, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover)[: len(words)] > 0).sum())


def base_rules(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        sum(map(text.count, MARKS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang (a lang_key), the base figures and log perplexity of every row."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", lang_key().alias("lang"), "text")
    model = train(documents)
    sent = spark.sparkContext.broadcast(sorted_arrays(frequent(model).select("lang", "gram", "log_p").toArrow()))

    def run(texts, columns):
        split = [x.encode().split() for x in texts]
        base = [base_rules(t, w) for t, w in zip(texts, split, strict=True)]
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(columns["lang"].to_pylist()):
            if split[i]:
                by_lang.setdefault(lang, []).append(i)
        total, others = [0] * len(texts), [{}] * len(texts)
        for lang, at in by_lang.items():
            sums, rest = look_up([symbols(split[i]) for i in at], sent.value.get(lang))
            for i, v, r in zip(at, sums.tolist(), rest, strict=True):
                total[i], others[i] = v, r
        out = {"n_words": [len(w) for w in split]}
        out |= dict(zip(("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, zip(*base)), strict=True))
        out = {k: pa.array(v, pa.int64()) for k, v in (out | {"found": total}).items()}
        return out | {"grams": pa.array([list(x) for x in others], pa.list_(pa.string())), "times": pa.array([list(x.values()) for x in others], pa.list_(pa.int64()))}

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, found long, grams array<string>, times array<long>"
    found = durable(map_texts(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", "lang", F.explode(F.arrays_zip("grams", "times")).alias("x"))
    each = each.select("row", "lang", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
    joined = each.join(model.select("lang", "gram", "log_p"), ["lang", "gram"])
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("rest"))
    total = F.col("found") + F.coalesce(F.col("rest"), F.lit(0))
    ppl = F.when(F.col("n_words") > 0, -total / UNIT / (F.col("word_chars") + F.col("n_words")))
    return found.join(rest, "row", "left").withColumn("log_ppl", ppl).drop("row", "grams", "times", "found", "rest")


def judge(documents: DataFrame, ranges: float = BAND_RANGES) -> DataFrame:
    """doc_id, n_words, the base figures, base_failed, log_ppl and kept of every document.

    Null texts have no words and fail; a null lang is a language of its own; repeated rows
    each give a row; an empty table gives none. Bands come from the documents that pass
    the base rules; a language without such documents has no band and rejects none. Log
    perplexities are held against a band in steps of 1 / STEPS; its edges are inside.
    """
    found = durable(measure(documents))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    marked = found.withColumn("base_failed", failed).withColumn("step", F.round(F.col("log_ppl") * STEPS))
    steps = marked.where("not base_failed").groupBy("lang", "step").count()
    quartile = F.percentile("step", F.array(F.lit(0.25), F.lit(0.75)), F.col("count"))
    bands = steps.groupBy("lang").agg(quartile.alias("q"))
    reach = F.lit(ranges) * (F.col("q")[1] - F.col("q")[0])
    bands = durable(bands.select("lang", (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high")))
    inside = F.coalesce(F.col("step").between(F.col("low"), F.col("high")), F.lit(True))
    return marked.join(bands, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "log_ppl",
    )


def query(spark: SparkSession, path: str) -> DataFrame:
    return judge(spark.read.parquet(f"{path}/documents.parquet"))
