"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source should get its weight's share of all words; a source stops at ``max_epochs`` times its size and the
excess is dealt to the others by weight, again and again until none is above (the water level only rises, so this ends
after at most one round per source). A source repeated r times takes every document floor(r) times as a whole, and for
the rest walks its documents in a seeded order until the remaining words are taken: whole documents, and a prefix of the
one where they run out.

Native: DataFrame and SQL functions only. Scale: one row per source after a partially aggregated count; a round
of the water level is one aggregate over that table. The seeded walk is cut into strata of about ``STRATUM`` documents, by hash,
so a source with a third of all rows is many small windows; each stratum meets its own share of the target to one word.
The source table is broadcast only below ``SMALL`` rows; above, it is a shuffled join.

Defined cases. Null or empty text: size 0. Null source: a source of its own, last in order; the empty string is a source.
A source without words has target 0. Null doc_ids are dealt out by their texts; repeated rows are documents like any other (equal seeds walk side by side).
Empty input: empty result. Extra columns of any names are kept; ``mix_sources`` replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.llm.common import WORD, as_rows, of_rows, stored

MAX_EPOCHS, STRATUM, SMALL = 3, 2000, 10_000
WEIGHTS = (5, 2, 1)


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The words per unit of weight at which sources fill, capped ones aside. ``sources``: source_size, weight."""
    cap = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = float(total) / float(weights) if weights else 0.0
    while True:
        full = cap <= F.col("weight") * level
        capped, free = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if not free or (higher := float(total - capped) / float(free)) <= level:
            return level
        level = higher


RESULTS = ("size", "source_size", "target", "whole", "extra", "taken")


def _mixed(docs: DataFrame, weights: DataFrame | None, cycle: tuple[int, ...], max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``RESULTS`` beside the column ``row``, which has the columns of ``docs``."""
    id_, text, source = (F.col("row").getField(c) for c in (id_col, text_col, source_col))
    rows = as_rows(docs).withColumn("size", F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")).withColumn("its_source", source)
    sources = stored(rows.groupBy(F.col("its_source").alias("of")).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs_n")), "mix-sources")
    if weights is None:
        rank = F.row_number().over(W.orderBy(F.asc_nulls_last("of")))  # one row per source
        sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), ((rank - 1) % len(cycle) + 1).cast("int")))
    else:
        sources = sources.join(weights.select(F.col("source").alias("its"), "weight"), F.col("of").eqNullSafe(F.col("its")), "left").drop("its").fillna(0, ["weight"])
    sources = stored(sources, "mix-weights")
    level = water_level(sources, max_epochs)
    targets = sources.select("of", "source_size", F.least((F.col("source_size") * max_epochs).cast("double"), F.col("weight") * F.lit(level)).alias("target"), F.ceil(F.col("docs_n") / STRATUM).alias("strata"))
    if sources.count() <= SMALL:
        targets = F.broadcast(targets)
    rows = rows.join(targets, F.col("its_source").eqNullSafe(F.col("of")))
    # rows without an id are dealt out by their texts
    rows = rows.withColumn("seeded", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")))))))
    rows = rows.withColumn("stratum", F.expr("cast(conv(substr(seeded, 1, 8), 16, 10) as bigint) % strata"))
    rows = rows.withColumn("times", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).withColumn("whole", F.floor("times"))
    own = W.partitionBy("of", "stratum")
    before = F.sum("size").over(own.orderBy("seeded", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    due = F.floor((F.col("times") - F.col("whole")) * F.sum("size").over(own) + 0.5)
    rows = rows.withColumn("extra", F.least(F.greatest(due - before, F.lit(0)), F.col("size")).cast("long"))
    return rows.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long")).select("row", *RESULTS)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, whole (copies), extra (words of one more, partial copy) and taken, in place of columns of these names.

    ``weights`` has (source, weight); without it, weights follow ``cycle`` over the sources in code point order.
    """
    rows = _mixed(docs, weights, cycle, max_epochs, seed, id_col, text_col, source_col)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, the partial copy as its first words joined by one space. Documents without words go.

    All columns but the text are as they were, whatever their names.
    """
    rows, text = _mixed(docs, weights, cycle, max_epochs, seed, id_col, text_col, source_col), F.col("row").getField(text_col)
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("extra").cast("int")), " ")
    copies = F.concat(F.array_repeat(text, F.col("whole").cast("int")), F.when(F.col("extra") == F.col("size"), F.array(text)).when(F.col("extra") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    rows = rows.where("size > 0").select("row", F.explode(copies).alias("copy"))
    return of_rows(rows.withColumn("row", F.col("row").withField(text_col, F.col("copy"))), docs.columns)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; weights 5, 2, 1 by turns, at most 3 epochs."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('7|' || coalesce(cast(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS seeded FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, list_extract([5, 2, 1], cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight::DOUBLE AS ratio, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST) AS k FROM w),
p AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
l AS (SELECT level FROM p WHERE ratio > level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce((SELECT level FROM l), 0)) AS target, cast(ceil(n / 2000.0) AS BIGINT) AS strata FROM w),
r AS (SELECT d.*, t.source_size, t.target, ('0x' || substr(seeded, 1, 8))::BIGINT % strata AS stratum, coalesce(target / nullif(source_size, 0), 0) AS times FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, sum(size) OVER (PARTITION BY source, stratum ORDER BY seeded, size ROWS UNBOUNDED PRECEDING) - size AS before, floor((times - floor(times)) * sum(size) OVER (PARTITION BY source, stratum) + 0.5) AS due FROM r)
SELECT doc_id, size, source_size, target, cast(floor(times) * size + least(greatest(due - before, 0), size) AS BIGINT) AS taken FROM x
"""
