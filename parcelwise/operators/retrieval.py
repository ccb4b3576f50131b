"""Policy retrieval: chunking, BM25, vector search and rank fusion over tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelwise.config import RetrievalParams
from parcelwise.functions.columns import strip, tokens
from parcelwise.operators.scale import top_n
from parcelwise.session import durable, parts_for, small_table, spread


def chunk_documents(
    docs: DataFrame,
    params: RetrievalParams = RetrievalParams(),
    section_mark: str = "\n## ",
    paragraph_mark: str = "\n\n",
) -> DataFrame:
    """Cut documents (source, text) into sections, and long sections into runs of
    paragraphs of about `max_chunk_size` characters.

    The packing only needs paragraph lengths, so the fold carries the first
    paragraph number of every chunk and the text is joined once at the end. Both
    marks must begin and end in whitespace or be blank.
    """
    size = params.max_chunk_size
    quoted = lambda mark: F.lit("\\Q" + mark + "\\E")
    prefix = section_mark.lstrip("\n")
    sections = docs.select(
        "source", F.posexplode(F.split("text", quoted(section_mark), -1)).alias("section_no", "raw")
    ).select(
        "source",
        "section_no",
        F.when(F.col("section_no") == 0, strip(F.col("raw")))
        .otherwise(F.concat(F.lit(prefix), strip(F.col("raw"))))
        .alias("body"),
    )
    paragraphs = F.when(
        F.length("body") > size, F.split("body", quoted(paragraph_mark), -1)
    ).otherwise(F.array("body"))
    sections = sections.withColumn("paragraphs", paragraphs)

    start = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("at")
    )

    def place(state: Column, paragraph: Column) -> Column:
        length, used, at = F.length(paragraph), state["used"], state["at"]
        opens = (used + length > size) & (used > 0)
        joined = F.when(used > 0, used + len(paragraph_mark) + length).otherwise(length)
        return F.struct(
            F.when(opens, F.concat(state["starts"], F.array(at))).otherwise(state["starts"]).alias(
                "starts"
            ),
            F.when(opens, length).otherwise(joined).alias("used"),
            (at + 1).alias("at"),
        )

    starts = F.aggregate("paragraphs", start, place, lambda state: state["starts"])
    sections = sections.withColumn("starts", starts)

    def packed(first: Column, part: Column) -> Column:
        following = F.try_element_at("starts", part + 2)
        count = F.coalesce(following, F.size("paragraphs")) - first
        joined = strip(F.array_join(F.slice("paragraphs", first + 1, count), paragraph_mark))
        return F.struct(joined.alias("text"), following.isNull().alias("last"))

    # Texts are cut before the explode, so no row carries the whole section. The outer
    # form keeps Spark from adding a filter that would compute the texts twice.
    whole = F.array(F.struct(F.col("body").alias("text"), F.lit(True).alias("last")))
    texts = F.when(F.length("body") > size, F.transform("starts", packed)).otherwise(whole)
    chunks = (
        sections.select("source", "section_no", texts.alias("texts"))
        .select("source", "section_no", F.posexplode_outer("texts").alias("part_no", "chunk"))
        .select("source", "section_no", "part_no", "chunk.text", "chunk.last")
    )
    chunk_id = F.concat_ws("/", F.col("source").cast("string"), "section_no", "part_no")
    # A blank chunk stays only between two others.
    return chunks.where((F.col("text") != "") | ~F.col("last")).select(
        "source",
        "section_no",
        "part_no",
        chunk_id.alias("chunk_id"),
        "text",
        F.left(F.substring_index("text", "\n", 1), F.lit(params.label_chars)).alias("section"),
    )


#: Characters of a task that counts terms, and postings of a task that scores or packs them, about.
TASK_CHARS = 8_000_000
TASK_POSTINGS = 500_000


@dataclass(frozen=True)
class LexicalIndex:
    """postings(chunk_id, dl, term, tf), terms(term, df, idf), and corpus figures."""

    postings: DataFrame
    terms: DataFrame
    chunks: int
    mean_length: float


def postings_of(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Term counts per chunk; chunks: chunk_id, text. parts: partitions, if not the session's own number."""
    # Texts are spread by chunk once; the counts then need no shuffle of their own.
    texts = chunks.select("chunk_id", "text")
    dealt = spread(texts, parts, "chunk_id") if parts else texts.repartition("chunk_id")
    words = dealt.select("chunk_id", tokens(F.col("text")).alias("words"))
    return (
        words.select("chunk_id", F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_stats(postings: DataFrame, chunks: int, params: RetrievalParams = RetrievalParams()) -> DataFrame:
    """Document frequency and inverse document frequency per term.

    A negative idf is replaced by a share of the mean idf over all terms.
    """
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.lit(float(chunks)) - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    terms = counts.withColumn("raw_idf", raw)
    # Equal df means equal idf, so the mean comes from few groups in a fixed order.
    mean = terms.groupBy("df").agg(F.first("raw_idf").alias("i"), F.count(F.lit(1)).alias("n"))
    mean = mean.agg((F.sum(F.col("i") * F.col("n")) / F.sum("n"))).scalar()
    floor = F.lit(params.negative_idf_share) * mean
    return terms.select(
        "term", "df", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf")
    )


def build_index(chunks: DataFrame, params: RetrievalParams = RetrievalParams()) -> LexicalIndex:
    """Store the index tables once; queries then read only what they need."""
    count, chars = chunks.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = parts_for(chunks.sparkSession, chars or 0, TASK_CHARS)
    postings = durable(postings_of(chunks, parts))
    words = postings.agg(F.sum("tf")).first()[0]
    terms = durable(term_stats(postings, count, params))
    return LexicalIndex(postings, terms, count, (words or 0) / count if count else 0.0)


def save_index(index: LexicalIndex, path: str) -> None:
    """Write the index tables and figures as one folder."""
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    figures = {"chunks": [index.chunks], "mean_length": [float(index.mean_length)]}
    small_table(index.terms.sparkSession, figures).write.mode("overwrite").parquet(f"{path}/figures")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    figures = spark.read.parquet(f"{path}/figures").first()
    return LexicalIndex(
        spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"),
        figures["chunks"], figures["mean_length"],
    )


def posting_parts(index: LexicalIndex) -> int | None:
    """Partitions for shuffles of the postings by chunk."""
    return parts_for(index.postings.sparkSession, index.postings.count(), TASK_POSTINGS)


def query_terms(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """Query words with their counts and idf, stored so that Spark knows the size and
    picks the join with the postings accordingly."""
    words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    counted = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return durable(counted.join(index.terms.select("term", "idf"), "term"))


def bm25_topk(
    queries: DataFrame,
    index: LexicalIndex,
    n: int | None = None,
    params: RetrievalParams = RetrievalParams(),
    include_zero: DataFrame | None = None,
) -> DataFrame:
    """Best n chunks per query: query_id, chunk_id, score, rank.

    Scores are rounded to 6 digits before ranking; ties go to the smaller chunk
    id. Only chunks with a positive score are kept, unless `include_zero` names
    the chunks (chunk_id) that may fill a short list.
    """
    n = n or params.lexical_candidates
    tf = F.col("tf").cast("double")
    norm = params.k1 * (1.0 - params.b + params.b * F.col("dl") / F.lit(float(index.mean_length)))
    gain = F.col("qtf") * F.col("idf") * (tf * (params.k1 + 1.0) / (tf + norm))
    asked = query_terms(queries, index)
    postings, parts = index.postings, posting_parts(index)
    if parts:
        # Postings move, and not the more numerous pairs of query and chunk.
        named = postings.join(asked.select("term").distinct(), "term", "left_semi")
        postings = spread(named, parts, "chunk_id")
    scored = (
        postings.join(asked, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(gain), 6).alias("score"))
    )
    best = top_n(
        scored.where(F.col("score") > 0), ["query_id"], [F.desc("score"), "chunk_id"], n, "rank"
    )
    if include_zero is None:
        return best
    # n fillers suffice: of the n + n smallest ids at most n are ranked already.
    short = queries.select("query_id").distinct()
    fillers = include_zero.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * n)
    ids = fillers.agg(F.array_sort(F.collect_list("chunk_id"))).scalar()
    zero = short.select("query_id", F.explode(ids).alias("chunk_id")).join(
        best, ["query_id", "chunk_id"], "left_anti"
    )
    both = best.drop("rank").unionByName(zero.withColumn("score", F.lit(0.0)))
    return top_n(both, ["query_id"], [F.desc("score"), "chunk_id"], n, "rank")


def _best_rows(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best scores, ties to the smaller id."""
    if len(scores) > n:
        kept = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:n]


def _search_cell(schema: pa.Schema, n: int, at_once: int = 256):
    """Task function: the n best vectors of a shard for every query of a block."""

    def matrix(table: pa.Table) -> np.ndarray:
        values = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return values.astype("float64").reshape(table.num_rows, -1)

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = vectors["chunk_id"].to_numpy()
        names, x, q = queries["query_id"].to_numpy(), matrix(vectors), matrix(queries)
        asked, found, score = [], [], []
        for first in range(0, len(q), at_once):
            scores = np.round(x @ q[first : first + at_once].T, 6)
            for i in range(scores.shape[1]):
                top = _best_rows(ids, scores[:, i], n)
                asked.append(np.repeat(names[first + i : first + i + 1], len(top)))
                found.append(ids[top])
                score.append(scores[top, i])
        columns = [np.concatenate(c) for c in (asked, found, score)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    n: int = RetrievalParams.vector_candidates,
    block: int = 4096,
    shard: int = 20_000,
) -> DataFrame:
    """Exhaustive inner-product search: query_id, chunk_id, score, rank.

    queries: query_id, embedding. vectors: chunk_id, embedding (unit length). Rows
    without an embedding take no part. Queries fall into blocks and vectors into shards by the
    hash of their ids, of about `block` and `shard` rows; each pair of a block and a
    shard is one group, which hands on only its n best rows per query. Only the two
    counts reach the driver.
    """
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    source = vectors.select("chunk_id", "embedding").where(F.col("embedding").isNotNull())
    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    schema = f"query_id {types[0]}, chunk_id {types[1]}, score double"
    blocks, shards = -(-asked.count() // block), -(-source.count() // shard)
    if not blocks or not shards:
        return top_n(queries.sparkSession.createDataFrame([], schema), ["query_id"], [F.desc("score"), "chunk_id"], n, "rank")
    # Both sides need keys of one type, else no groups meet.
    part = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = source.select("chunk_id", "embedding", part("chunk_id", shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("query_id", "embedding", part("query_id", blocks).alias("block"), every(shards).alias("shard"))
    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    found = cells.applyInArrow(_search_cell(arrow, n), schema)
    return top_n(found, ["query_id"], [F.desc("score"), "chunk_id"], n, "rank")


def rrf_fuse(
    lexical: DataFrame, vector: DataFrame, params: RetrievalParams = RetrievalParams()
) -> DataFrame:
    """Fuse two ranked lists: each list adds 1 / (k + rank). Ties go to the better
    lexical rank, then the smaller chunk id."""
    first = lexical.select("query_id", "chunk_id", "rank", F.col("rank").alias("lexical_rank"))
    second = vector.select(
        "query_id", "chunk_id", "rank", F.lit(None).cast("bigint").alias("lexical_rank")
    )
    part = F.lit(1.0) / (F.lit(float(params.rrf_k)) + F.col("rank"))
    fused = (
        first.unionByName(second)
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(part).alias("fused"), F.min("lexical_rank").alias("lexical_rank"))
    )
    order = [F.desc("fused"), F.asc_nulls_last("lexical_rank"), F.asc("chunk_id")]
    return top_n(fused, ["query_id"], order, params.top_k, "rank").select(
        "query_id", "chunk_id", F.round("fused", 5).alias("rrf_score"), "rank"
    )


def case_query(df: DataFrame) -> Column:
    """Retrieval text of a case with its figures."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        text("category"), F.lit(" "), text("reason_category"), F.lit(" "), text("return_type"),
        F.lit(" return "),
        F.when(F.col("is_non_returnable") == 1, "non-returnable").otherwise("returnable"),
        F.lit(" "),
        F.when(F.coalesce("within_return_window", F.lit(0)) == 0, "outside return window").otherwise(
            "within return window"
        ),
        F.lit(" order value "), text("order_value"), F.lit(" days left "), text("days_left_to_return"),
    )


def policy_query(df: DataFrame) -> Column:
    """Short retrieval text; few distinct texts cover all cases."""
    return F.concat_ws(
        " ",
        F.col("category"), F.col("reason_category"), F.lit("return"),
        F.when(F.col("is_non_returnable") == 1, "non-returnable").otherwise("returnable"),
        F.lit("policy"),
    )


def case_policies(
    cases: DataFrame, chunks: DataFrame, index: LexicalIndex, params: RetrievalParams = RetrievalParams()
) -> DataFrame:
    """return_id, retrieved_clause, policy_source, policy_passages: the best chunks for the
    query text of each case; null where no chunk shares a word with it.

    Few distinct texts cover all cases. Each is searched once, and the stored answers
    are joined back by text. chunks: chunk_id, source, section, text, as indexed.
    """
    asked = cases.select("return_id", policy_query(cases).alias("query"))
    texts = durable(asked.select("query").distinct())
    hits = bm25_topk(texts.select(F.col("query").alias("query_id"), "query"), index, params.top_k, params)
    found = hits.join(chunks.select("chunk_id", "source", "section", "text"), "chunk_id")
    # At most top_k rows for each text.
    ranked = F.array_sort(F.collect_list(F.struct("rank", "section", "source", "text")))
    answers = durable(
        found.groupBy(F.col("query_id").alias("query")).agg(ranked.alias("best")).select(
            "query",
            F.col("best")[0]["section"].alias("retrieved_clause"),
            F.col("best")[0]["source"].alias("policy_source"),
            F.transform("best", lambda b: b["text"]).alias("policy_passages"),
        )
    )
    return asked.join(answers, "query", "left").drop("query")


def policy_context(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The retrieved texts of each query (at most top_k) joined in rank order."""
    hits = fused.join(chunks.select("chunk_id", "source", "text"), "chunk_id")
    entry = F.concat(F.lit("[Source: "), F.col("source"), F.lit("]\n"), F.col("text"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda r: r["entry"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("passages"),
    )
