"""Hybrid retrieval: BM25 over substrings, exact vector similarity, reciprocal rank fusion."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion, how many candidates a branch brings for each answer, BM25's parameters.
RRF_K, OVERFETCH, K1, B = 60, 4, 1.2, 0.75


def phrases(query: str) -> list[str]:
    """Terms of a query with three characters or more, lower-cased, each once; without any the query is a plain substring."""
    return list(dict.fromkeys(t.lower() for t in query.split() if len(t) >= 3))


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping occurrences of a phrase in a lower-cased text."""
    n = len(phrase)
    overlaps = any(phrase[i:] == phrase[: n - i] for i in range(1, n))
    if not overlaps:
        return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / n).cast("int")
    places = F.filter(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)) == phrase)
    return F.when(F.contains(text, F.lit(phrase)), F.size(places)).otherwise(0)


def bm25(chunks: DataFrame, query: str, row_id: str, text: str, heading: str | None = None) -> DataFrame:
    """(row_id, score) of the chunks with any phrase of the query, the best with the highest score.

    Document frequencies and the mean length come from one aggregate over all chunks; its single row is all that
    reaches the driver. Then one scan scores, with the frequencies as constants.
    """
    terms = phrases(query)
    gram_length = lambda c: F.greatest(F.coalesce(F.length(c), F.lit(0)) - 2, F.lit(0))
    size = gram_length(F.col(text)) + (gram_length(F.col(heading)) if heading else F.lit(0))
    tf = [occurrences(F.lower(F.col(text)), t) + (occurrences(F.lower(F.coalesce(F.col(heading), F.lit(""))), t) if heading else F.lit(0)) for t in terms]
    rows = chunks.select(row_id, size.alias("size"), *(c.alias(f"tf{i}") for i, c in enumerate(tf)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = stats[f"df{i}"]
        idf = math.log((stats.n - df + 0.5) / (df + 0.5))
        weight = F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("size") / F.lit(stats["mean"] or 1.0)))
        score = score + F.lit(idf if idf > 0 else 1e-6) * weight
    return rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))) if terms else "false").select(row_id, score.alias("score"))


def like(chunks: DataFrame, query: str, row_id: str, text: str) -> DataFrame:
    """(row_id, score) of the chunks that hold the query, letters A-Z without case, signs literally; in row order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.col(text), upper, lower)
    return chunks.where(F.contains(low, F.lit(query.translate(str.maketrans(upper, lower))))).select(row_id, F.lit(0.0).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def nearest(vectors: DataFrame, query: list[float], row_id: str, vector: str) -> DataFrame:
    """(row_id, score) by dot product with a query vector."""
    return vectors.select(row_id, dot(F.col(vector), F.lit(query).cast("array<double>")).alias("score"))


def ranked(scored: DataFrame, row_id: str, limit: int) -> DataFrame:
    """(row_id, rank) of the first ``limit`` rows, best score first, ties by id. Only those reach the window."""
    first = scored.orderBy(F.desc("score"), row_id).limit(limit)
    return first.select(row_id, F.row_number().over(Window.orderBy(F.desc("score"), row_id)).alias("rank"))


def fuse(rankings: list[DataFrame], row_id: str, k: int = RRF_K) -> DataFrame:
    """(row_id, score, first): reciprocal ranks of several rankings summed; ``first`` orders ties as the lists came."""
    every = None
    for number, ranking in enumerate(rankings):
        part = ranking.select(row_id, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(number).alias("list"), "rank").alias("place"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(row_id).agg(F.sum("part").alias("score"), F.min("place").alias("first"))


def hybrid(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, limit: int = 8, row_id: str = "row_id", text: str = "text", vector: str = "embedding", where: Column | None = None, index=None) -> DataFrame:
    """The chunks of the first ``limit`` answers with place and score.

    The keyword branch is BM25, or a substring scan if the query has no phrase; the vector branch is left out without a
    vector. A filter holds in both branches, but BM25's frequencies are those of all chunks. A blank query has no answer.
    With an ``index`` of the chunks' trigrams the keyword branch reads its postings, without one all texts.
    """
    from folio.operators import gram_index

    if not query.strip():
        return chunks.limit(0).withColumn("place", F.lit(1)).withColumn("score", F.lit(0.0))
    if index is None:
        found = bm25(chunks, query, row_id, text) if phrases(query) else like(chunks, query.strip(), row_id, text)
    elif phrases(query):
        found = gram_index.bm25(index, query).withColumnRenamed("row_id", row_id)
    else:
        found = gram_index.holding(index, chunks, query.strip(), row_id, text)
    if where is not None:
        allowed = chunks.where(where).select(row_id)
        found = found.join(allowed, row_id, "left_semi")
        vectors = None if vectors is None else vectors.join(allowed, row_id, "left_semi")
    lists = [ranked(found, row_id, limit * OVERFETCH)]
    if vectors is not None and query_vector is not None:
        lists.append(ranked(nearest(vectors.where(F.col(vector).isNotNull()), query_vector, row_id, vector), row_id, limit * OVERFETCH))
    fused = fuse(lists, row_id).orderBy(F.desc("score"), "first").limit(limit)
    placed = fused.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first"))).drop("first")
    return chunks.join(F.broadcast(placed), row_id)  # at most ``limit`` rows


def search_results(answers: DataFrame, page: str) -> DataFrame:
    """A page row at the first answer of each page, then every text row: (place, kind, page)."""
    first = F.row_number().over(Window.partitionBy(page).orderBy("place")) == 1
    pages = answers.withColumn("head", first).where("head").select("place", F.lit("page").alias("kind"), page)
    return pages.unionByName(answers.select("place", F.lit("text").alias("kind"), page))


def citations(text: Column) -> Column:
    """Tokens of the citation groups of a text: ``p:<slug>`` for pages, ``s:<ref>`` for sources; a group with any bad entry counts for nothing."""
    groups = F.regexp_extract_all(text, F.lit(r"\[\^[^\]]+\](?!:)|\[[A-Za-z0-9_.:-]+-p\d+[A-Za-z0-9_.:-]*\](?!\()"), F.lit(0))
    page = lambda e: F.regexp_replace(F.regexp_replace(F.split_part(F.regexp_replace(e, "^page:", ""), F.lit("#"), F.lit(1)), r"^/?(docs/)+", ""), "/+$", "")
    token = lambda e: (
        F.when(e.startswith("page:") | F.contains(e, F.lit("/")), F.when(page(e).rlike(r"^[\p{L}\p{N}_.%/-]+$"), F.concat(F.lit("p:"), page(e))))
        .when(e.rlike(r"^[\p{L}\p{N}_.:-]+$"), F.concat(F.lit("s:"), e))
    )
    entries = lambda g: F.filter(F.transform(F.split(F.regexp_replace(g, r"^\[\^?|\]$", ""), ","), lambda e: F.trim(F.regexp_replace(F.trim(e), r"^\^", ""))), lambda e: e != "")
    tokens = F.transform(groups, lambda g: F.transform(entries(g), token))
    return F.flatten(F.filter(tokens, lambda ts: ~F.exists(ts, lambda t: t.isNull())))


def packed(vector: Column) -> Column:
    """A vector as bytes, four for each component, little-endian; bytes have no expression in SQL, so batches go through numpy."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector)


def unpacked(blob: Column) -> Column:

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(blob)
