"""Vector, lexical and hybrid search for batches of questions.

``chunks``: id, filename, chunk_index, text, embedding, ord. ``questions``: query_id, question, query_vector, k.
Ties go to the lower ``ord``; scores are compared after rounding to nine places, so that last bits cannot decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.operators import pairs
from corvida.operators.lexical import SMALL_BATCH, bm25_parts, counted, filename_boost
from corvida.scratch import kept


def fetch_size(k: Column, n: Column) -> Column:
    return F.least(F.greatest(8 * k, F.lit(12)), n)


def largest(questions: DataFrame, limit: Column | int) -> int:
    """The largest limit of a batch of questions: a number, by which each partition can be cut before rows are moved."""
    return limit if isinstance(limit, int) else questions.agg(F.max(limit)).first()[0] or 0


def ranked(rows: DataFrame, score: str, limit: Column | int, most: int, rank: str) -> DataFrame:
    """The ``limit`` best rows of each query, ``most`` at most, with a rank from 0."""
    order = W.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "ord")
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return best.withColumn(rank, F.col("place") - 1).drop("place").where(F.col(rank) < limit)


def every_pair(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Each row with each question. Up to ``SMALL_BATCH`` questions are sent to all tasks; of more, each block meets each block of rows."""
    if questions.limit(SMALL_BATCH + 1).count() > SMALL_BATCH:
        return rows.hint("shuffle_replicate_nl").crossJoin(questions)
    return rows.crossJoin(F.broadcast(questions))


def vector_topk(chunks: DataFrame, questions: DataFrame, limit: Column | int) -> DataFrame:
    """(query_id, id, ord, sim, v_rank)."""
    rows = chunks.where("embedding is not null").select("id", "ord", "embedding")
    asked = questions.where("query_vector is not null").select(*[c for c in questions.columns if c in ("query_id", "k", "query_vector")])
    most = largest(questions, limit)
    scored = pairs.meet(rows, asked, pairs.topk(most), pairs.schema_of(asked, rows, "sim double, place double"))
    return ranked(scored, "place", limit, most, "v_rank").drop("place")


def lexical_topk(docs: DataFrame, questions: DataFrame, limit: Column | int) -> DataFrame:
    """(query_id, id, ord, score, l_rank) of ``counted`` rows: BM25 and filename boost, positive scores only."""
    parts = bm25_parts(docs, questions)
    boosted = docs.select("id", "ord", "filename").join(F.broadcast(filename_boost(questions, docs)), "filename").select("query_id", "id", "ord", F.col("boost").alias("part"))
    total = parts.unionByName(boosted).groupBy("query_id", "id").agg(F.first("ord").alias("ord"), F.sum("part").alias("score")).where("score > 0")
    total = total.join(questions.select("query_id", "k"), "query_id")
    return ranked(total, "score", limit, largest(questions, limit), "l_rank")


def rrf(vector: DataFrame, lexical: DataFrame, weight: float = 0.5, constant: int = 60, most: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, id, v_rank) and (query_id, id, l_rank): adds rrf and rank (from 1, up to ``most``)."""
    both = vector.join(lexical, ["query_id", "id"], "full")
    term = lambda w, r: F.coalesce(F.lit(w) / (F.col(r) + (constant + 1)), F.lit(0.0))
    both = both.withColumn("rrf", term(1 - weight, "v_rank") + term(weight, "l_rank"))
    order = W.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.asc_nulls_last("v_rank"), F.asc_nulls_last("l_rank"))
    both = both.withColumn("rank", F.row_number().over(order))
    return both if most is None else both.where(F.col("rank") <= most)


def hybrid_search(chunks: DataFrame, questions: DataFrame, weight: float = 0.5, docs: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, filename, chunk_index, ord, rrf, distance: the k best of each question; of rows with one id the last counts.

    ``docs`` are the ``counted`` chunks, if they are kept already.
    """
    docs = docs if docs is not None else kept(counted(chunks, questions), "counted")
    limit = fetch_size(F.col("k"), F.lit(docs.count()))
    vector = vector_topk(chunks, questions, limit).select("query_id", "id", "v_rank", "sim")
    lexical = lexical_topk(docs, questions, limit).select("query_id", "id", "l_rank")
    fused = rrf(vector, lexical, weight, most=largest(questions, F.col("k"))).join(questions.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    found = fused.join(docs.select("id", "filename", "chunk_index", "ord"), "id").groupBy("query_id", "rank", "id", "rrf", "sim").agg(F.max_by(F.struct("filename", "chunk_index", "ord"), "ord").alias("c"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "c.filename", "c.chunk_index", "c.ord", "rrf", F.coalesce(1 - F.col("sim"), F.lit(1.0)).alias("distance"))


def passes_gate(hits: DataFrame, threshold: float) -> DataFrame:
    """(query_id, best, found): the first fused hit decides; a lexical-only hit has similarity 0."""
    return hits.where("rank = 1").select("query_id", (1 - F.col("distance")).alias("best"), (1 - F.col("distance") >= threshold).alias("found"))
