"""The one document whose illustrations an answer may show, and its markers' URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T


def markers(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, number, image, at): a row per marker in order."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(T.MARKER), F.lit(1)).alias("number"), T.marker_names(F.col("text")).alias("image"))
    return chunks.select(*keys, F.posexplode(pairs).alias("at", "m")).select(*keys, F.col("m.number").cast("int").alias("number"), "m.image", "at")


def image_source(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, filename): among hits with markers the file that shares most roots with the question; if none does, the one
    with most such chunks; first seen of equals. ``hits``: query_id, pos, filename, text."""
    shown = hits.where(F.col("text").rlike(T.MARKER)).groupBy("query_id", "filename").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    asked = questions.select("query_id", T.word_roots(F.regexp_replace("question", "[_-]", "  ")).alias("roots"))
    scored = shown.join(asked, "query_id").withColumn("score", F.size(F.array_intersect("roots", T.word_roots(F.col("filename")))))
    rank = F.when(F.col("score") > 0, F.col("score")).otherwise(0)
    best = W.partitionBy("query_id").orderBy(rank.desc(), F.when(F.col("score") > 0, 0).otherwise(F.col("n")).desc(), "first")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("query_id", "filename", "score")


def image_urls(context: DataFrame, source: DataFrame, base: str) -> DataFrame:
    """(query_id, marker, url), first place of each marker: illustrations of the source file in the expanded context."""
    own = context.join(source.select("query_id", "filename"), ["query_id", "filename"])
    found = markers(own, "query_id", "pos", "filename")
    marker = F.concat(F.lit("[Рисунок "), F.col("number"), F.lit(": "), F.col("image"), F.lit("]"))
    url = F.concat(F.lit(base.rstrip("/") + "/files/"), T.stem(F.col("filename")), F.lit("_images/"), F.col("image"))
    return found.groupBy("query_id", marker.alias("marker")).agg(F.min_by(url, F.struct("pos", "at")).alias("url"))
