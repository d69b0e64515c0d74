"""The older profile: cosine search with a section filter, keyword hits from the first rows, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.functions.vector import cosine_gate
from corvida.operators import pairs
from corvida.operators.search import largest

SCAN_LIMIT = 500  # a feature of the profile: keywords are sought in the first rows only


def cosine_topk(chunks: DataFrame, questions: DataFrame, section: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity, gate) by cosine; the section is filtered before scoring."""
    rows = chunks.where("embedding is not null")
    rows = rows if section is None else rows.where(F.col("section") == section)
    rows, asked, most = rows.select("id", "ord", "embedding"), questions.select("query_id", "query_vector", "k"), largest(questions, F.col("k"))
    scored = pairs.meet(rows, asked, pairs.topk(most, cosine=True), pairs.schema_of(asked, rows, "sim double, place double"))
    order = W.partitionBy("query_id").orderBy(F.col("place").desc(), "ord")
    ranked = scored.withColumnRenamed("sim", "similarity").withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= most).where(F.col("rank") <= F.col("k"))
    return ranked.select("query_id", "rank", "id", "similarity", cosine_gate(F.col("similarity")).alias("gate"))


def keyword_hits(chunks: DataFrame, question: str, exclude: DataFrame, k: int, scan: int = SCAN_LIMIT) -> DataFrame:
    """(id, ord, n_match, kw_rank): chunks among the first ``scan`` that hold a root of the question, most roots first."""
    roots = T.question_roots(F.lit(question))
    rows = chunks.orderBy("ord").limit(scan).join(exclude.select("id"), "id", "left_anti")
    matched = F.size(F.filter(roots, lambda r: F.contains(F.lower(F.col("text")), r)))
    found = rows.select("id", "ord", matched.cast("long").alias("n_match")).where("n_match > 0").orderBy(F.desc("n_match"), "ord").limit(k)
    return found.withColumn("kw_rank", F.row_number().over(W.orderBy(F.desc("n_match"), "ord")))  # k rows


def union_context(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(id, side, pos): vector hits, then keyword hits."""
    return vector.select("id", F.lit(0).alias("side"), F.col("rank").alias("pos")).unionByName(keyword.select("id", F.lit(1).alias("side"), F.col("kw_rank").alias("pos")))
