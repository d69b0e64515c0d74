"""Chunk profiles and the splitter.

The splitter is sentence-first with a budget in words and an overlap of whole sentences. It is this library's own: its boundaries
are documented and tested by their invariants (order, coverage, budget).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.functions import text as T

# Profile, chunk size, overlap.
CHEATSHEET, MANUAL = ("cheatsheet", 350, 50), ("manual", 800, 120)


def line_stats(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, total_lines, short_ratio, numbered_ratio, heading_ratio) over non-empty lines."""
    lines = docs.select(*keys, F.explode(T.lines(F.col("text"))).alias("line"))
    share = lambda c: F.avg(c.cast("int"))
    return lines.groupBy(*keys).agg(F.count("*").alias("total_lines"), share(F.length("line") <= 80).alias("short_ratio"), share(T.is_numbered(F.col("line"))).alias("numbered_ratio"), share(T.is_heading(F.col("line"))).alias("heading_ratio"))


def chunk_profile(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, profile, chunk_size, chunk_overlap); documents without lines are manuals."""
    stats = docs.select(*keys).distinct().join(line_stats(docs, *keys), list(keys), "left")
    cheat = F.coalesce((F.col("short_ratio") > 0.45) | (F.col("numbered_ratio") > 0.15) | (F.col("heading_ratio") > 0.20), F.lit(False))
    pick = lambda k: F.when(cheat, CHEATSHEET[k]).otherwise(MANUAL[k])
    return stats.select(*keys, pick(0).alias("profile"), pick(1).alias("chunk_size"), pick(2).alias("chunk_overlap"))


#: Between sentences: white space after an end mark, or a line end; a mark within a word or a name ends nothing.
_BETWEEN = re.compile(r"(?<=[.!?])\s+|\n+")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` words, each beginning with the last sentences of the one before, up to ``overlap`` words."""
    sentences = []
    for s in _BETWEEN.split(text):
        words = s.split()
        sentences += [words[i : i + size] for i in range(0, len(words), size)]
    out, chunk, fresh = [], [], False
    for s in sentences:
        if chunk and sum(map(len, chunk)) + len(s) > size:
            out.append(chunk)
            tail: list[list[str]] = []
            for old in reversed(chunk):
                if sum(map(len, tail)) + len(old) > overlap or sum(map(len, tail)) + len(old) + len(s) > size:
                    break
                tail.insert(0, old)
            chunk = tail
        chunk, fresh = [*chunk, s], True
    if fresh:
        out.append(chunk)
    return [" ".join(w for s in c for w in s) for c in out]


def split_documents(docs: DataFrame) -> DataFrame:
    """(filename, pos, text) of the chunks of (filename, text, chunk_size, chunk_overlap)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [(name, i, c) for name, text, size, overlap in x.itertuples(index=False) for i, c in enumerate(split_text(text or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["filename", "pos", "text"])

    return docs.select("filename", "text", "chunk_size", "chunk_overlap").mapInPandas(run, "filename string, pos int, text string")
