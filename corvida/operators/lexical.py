"""BM25 with five-letter stems for batches of questions.

``questions`` is (query_id, question). A term counts where a token equals it, else where both have five letters and share
them. Each text is cut into tokens once, where it is read (``counted``): only its length and the counts of the questions'
terms go on, and no text is moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.functions import text as T

K1, B = 1.5, 0.75
SMALL_BATCH = 1000


def terms_of(questions: DataFrame) -> DataFrame:
    """Distinct (query_id, term)."""
    return questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))


def _counter(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    token, ascii_gaps, five = re.compile(T.TOKEN), "".join(chr(i) if chr(i).isalnum() else " " for i in range(128)), T.STEM
    wanted, by_stem = set(terms), {}
    for t in terms:
        if len(t) >= five:
            by_stem.setdefault(t[:five], []).append(t)

    def count(text: str) -> tuple[int, dict[str, int]]:
        toks = text.translate(ascii_gaps).split() if text.isascii() else token.findall(text)
        n = Counter(toks)
        found, near = {t: n[t] for t in n.keys() & wanted}, {}
        for t, m in n.items():
            stem = t[:five]
            if stem in by_stem and len(t) >= five:
                near[stem] = near.get(stem, 0) + m
        for stem, m in near.items():
            for t in by_stem[stem]:
                found.setdefault(t, m)
        return len(toks), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [c for c in b.schema.names if c != "words"]
            lengths, offsets, term, tf = [], [0], [], []
            for x in b["words"]:
                n, found = count(x.as_py())
                lengths.append(float(n))
                term += found.keys()
                tf += found.values()
                offsets.append(len(term))
            hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(term, pa.string()), pa.array(tf, pa.int64())], names=["term", "tf"]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in own), pa.array(lengths, pa.float64()), hits], names=[*own, "dl", "hits"])

    return run


def counted(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``chunks`` without ``text`` and ``embedding``, with dl, the number of tokens of filename and text, and hits, the (term, tf) of the questions' terms: exact count, else stem count."""
    terms = [r["term"] for r in terms_of(questions).select("term").distinct().collect()]
    own = [c for c in chunks.columns if c not in ("text", "embedding")]
    schema = ", ".join([*(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in own), "dl double, hits array<struct<term: string, tf: bigint>>"])
    return chunks.select(*own, F.lower(F.concat_ws(" ", "filename", "text")).alias("words")).mapInArrow(_counter(terms), schema)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of ``counted`` rows."""
    return docs.select(F.explode("hits.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25_parts(docs: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, ord, part) of ``counted`` rows: what each term adds to a score."""
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avg_dl"))
    df = document_frequencies(docs).withColumn("df", F.col("df").cast("double"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_dl")  # one row
    asked = terms_of(questions).join(idf, "term")
    asked = F.broadcast(asked) if questions.limit(SMALL_BATCH + 1).count() <= SMALL_BATCH else asked
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.try_divide(F.col("dl"), F.col("avg_dl"))))
    hits = docs.select("id", "ord", "dl", F.explode("hits").alias("h")).select("id", "ord", "dl", "h.term", "h.tf")
    return hits.join(asked, "term").select("query_id", "id", "ord", part.alias("part"))


def bm25(docs: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, ord, score) of the ``counted`` rows that match a term; all others score 0."""
    return bm25_parts(docs, questions, k1, b).groupBy("query_id", "id").agg(F.first("ord").alias("ord"), F.sum("part").alias("score"))


def filename_boost(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, filename, boost) where a question and a file's stem share tokens: 0.35 each, at most 1.4."""
    asked = terms_of(questions)
    named = names.select("filename").distinct().select("filename", F.explode(F.array_distinct(T.tokens(T.stem(F.col("filename"))))).alias("term"))
    return asked.join(named, "term").groupBy("query_id", "filename").agg(F.least(F.count("*") * F.lit(0.35), F.lit(1.4)).alias("boost"))
