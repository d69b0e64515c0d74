"""Context of a question: neighbours of its hits, cut to a budget, as text and as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T

FEW = 10_000


def with_texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Few rows, with their chunks' ``text``, by ``ord`` where there is one: a text is read where it lies, not moved to be numbered."""
    keys = ["filename", "ord" if "ord" in rows.columns else "chunk_index"]
    return chunks.select(*keys, "text").join(F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows, keys)


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(query_id, filename, chunk_index, doc_rank, and ord if chunks have it): hits and chunks whose index is within ``reach``, in the hits' files.

    A band condition on the index, turned into an equi-join by listing the wanted indexes.
    """
    ranks = hits.groupBy("query_id", "filename").agg(F.min("rank").alias("doc_rank"))
    wanted = hits.select("query_id", "filename", F.explode(F.expr(f"sequence(chunk_index - {reach}, chunk_index + {reach})")).alias("chunk_index")).distinct()
    own = [c for c in ("filename", "chunk_index", "ord") if c in chunks.columns]
    return wanted.join(chunks.select(*own), ["filename", "chunk_index"]).join(ranks, ["query_id", "filename"])


def build_context(hits: DataFrame, chunks: DataFrame, budget: int, reach: int = 1) -> DataFrame:
    """query_id, pos (from 0), filename, chunk_index, text: documents by their best hit, chunks in order, ``budget`` in all."""
    order = W.partitionBy("query_id").orderBy("doc_rank", "chunk_index")
    cut = neighbours(hits, chunks, reach).withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < budget)
    return with_texts(cut, chunks).select("query_id", "pos", "filename", "chunk_index", "text")


def capped(rows: DataFrame, most: int = 3, chars: int = 12_000) -> DataFrame:
    """Rows of (query_id, pos, text) while at most ``most`` and ``chars`` in all; the first always stays."""
    order = W.partitionBy("query_id").orderBy("pos")
    so_far = F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("n", F.row_number().over(order)).withColumn("so_far", so_far).where((F.col("n") <= most) & ((F.col("n") == 1) | (F.col("so_far") <= chars))).drop("n", "so_far")


def context_string(context: DataFrame) -> DataFrame:
    """(query_id, context): blocks with their headers, in order. A context is bounded by its budget."""
    block = F.concat(F.lit("[CHUNK "), F.col("pos"), F.lit(" | "), F.col("filename"), F.lit("]\n"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"])
    return context.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"), F.count("*").alias("chunks_used"))


def ordered_sources(context: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, filename, relevance, source_rank): files by roots shared with the question, then first appearance."""
    first = context.groupBy("query_id", "filename").agg(F.min("pos").alias("first"))
    asked = questions.select("query_id", T.word_roots(F.regexp_replace("question", "[_-]", "  ")).alias("roots"))
    scored = first.join(asked, "query_id").withColumn("relevance", F.size(F.array_intersect("roots", T.word_roots(F.col("filename")))))
    order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "first")
    return scored.select("query_id", "filename", "relevance", F.row_number().over(order).alias("source_rank"))
