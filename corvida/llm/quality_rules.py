"""Quality rules whose cutoffs are chosen with a guarantee on false rejections.

Rules are upper limits on per-word or per-line rates. Cutoffs come from the data: of each stratum's (language's) labelled good
documents, dealt into two halves by a hash of their ids, the first gives for each rule the values at ``QUANTILES``, from mild
to strict; level k rejects a document if any rate is above its rule's k-th value. The second half is the holdout: with k of n
rejected, the exact binomial tail P(X <= k | n, ``risk``) is a p-value for "this level rejects over ``risk`` of good documents".
Holding it against ``delta`` / (strata * levels) (Bonferroni over all tests made) gives the exact (Clopper-Pearson) upper bound;
the strictest level that passes is used, and where none passes only the base rules apply. So, with probability
1 - ``delta``, no stratum loses over ``risk`` of its good documents to the rules, all rules taken together.

Scale. One Arrow pass over the texts computes the features, which are kept as a narrow table; labels meet features by
an equi-join; what is aggregated is quantile summaries and (stratum, level) counts. The tables of cutoffs and levels have one row per stratum and are
broadcast only up to ``SMALL`` rows; above, they are shuffled joins.

Defined cases. Null or empty text: no words, so base_failed. Null language: a stratum of its own. Null labels count
for nothing; with several labels for a document the highest counts. Documents without a doc_id have no label. A stratum without good labels has no cutoffs.
Repeated rows are each judged and returned. Empty tables give an empty result. Other columns are not read, and kept by ``kept_documents`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import as_rows, of_rows, row_key, stored

RULES = ("symbols_per_word", "repeat_word_share", "dup_line_share", "upper_share", "exclaims_per_word")
#: Shares of the good documents that are not above a rule's cutoff, by level.
QUANTILES = (0.9995, 0.999, 0.9975, 0.995, 0.99, 0.98)
RISK, DELTA = 0.02, 0.05
SMALL = 4096

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims")


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    pairs = np.unique(at[:-1] << np.uint64(32) | at[1:], return_inverse=True)[1].astype(np.uint64)  # numbered, so that any text's windows fit in a word
    keys = pairs[:-1] << np.uint64(32) | at[2:]
    if len(order := np.sort(keys)) == 0 or not (same := order[1:] == order[:-1]).any():
        return 0
    hit = np.isin(keys, order[1:][same])
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : len(hit) + k] |= hit
    return int(cover.sum())


def features(text: str | None) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), len(lines) - len(set(lines)), _repeat_words(words), len(lines), upper, upper + lower, raw.count(b"!")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([features(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "stratum")), *map(pa.array, got.T)], names=["doc_id", "key", "stratum", *_COUNTS])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function, by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            f *= (step := c * d)
        if abs(step - 1) < 1e-14:
            break
    return min(1.0, 1 - front * f if flip else front * f)


def reject_level(levels: int) -> Column:
    """The mildest level (from 0) that rejects the row, whose cutoffs stand in the arrays ``cut_<rule>``; null if none does."""
    first = F.least(*[F.expr(f"size(filter(cut_{rule}, c -> {rule} <= c))") for rule in RULES])
    return F.when((first >= 0) & (first < levels), first)


def _rates(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.withColumns({"symbols_per_word": share("n_symbols", "n_words"), "repeat_word_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "upper_share": share("n_upper", "n_letters"), "exclaims_per_word": share("n_exclaims", "n_words")})


def choose_levels(judged: DataFrame, levels: int, risk: float, delta: float) -> DataFrame:
    """(stratum, level) of the strictest level that is safe, from good labelled rows with stratum and reject_level."""
    counts = judged.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("reject_level") <= i, 1)).alias(f"k{i}") for i in range(levels)])
    tests = counts.agg(F.count("*").alias("strata"))

    def certify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            safe = [[i for i in range(levels) if binomial_tail(int(r[f"k{i}"]), int(r["n"]), risk) <= delta / (levels * r["strata"])] for _, r in x.iterrows()]
            yield pd.DataFrame({"stratum": x["stratum"], "level": [max(s, default=-1) for s in safe]})

    return counts.crossJoin(F.broadcast(tests)).mapInPandas(certify, "stratum string, level int")


def _by_stratum(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with what ``facts``, a stored table of one row per stratum, has for theirs."""
    facts = facts.withColumnRenamed("stratum", "of")
    small = F.broadcast(facts) if facts.count() <= SMALL else facts
    return rows.join(small, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")


def cutoffs(good: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(stratum, cut_<rule> ...): each rule's values at the quantiles, from rows of good documents with their rates."""
    shares = F.array(*map(F.lit, quantiles))
    return good.groupBy("stratum").agg(*[F.percentile_approx(rule, shares, 10_000).alias(f"cut_{rule}") for rule in RULES])


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", quantiles: tuple[float, ...] = QUANTILES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, key (content key of the row), stratum, the counts, base_failed, reject_level, level (chosen; -1: none), kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum")).withColumn("key", row_key("doc_id", "text", "stratum"))
    rows = source.mapInArrow(_measured, f"doc_id {id_type}, key long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))
    rows = stored(_rates(rows).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "quality-features")
    good = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).groupBy("doc_id").agg(F.max("label").alias("label")).where("label = 1 and doc_id is not null")
    judged = rows.where("not base_failed").select("doc_id", "stratum", *RULES).join(good.select("doc_id"), "doc_id").withColumn("half", F.expr("pmod(xxhash64(doc_id, 'half'), 2)"))
    judged = stored(judged, "quality-judged")
    levels = len(quantiles)
    cuts = stored(cutoffs(judged.where("half = 0"), quantiles), "quality-cutoffs")
    held = _by_stratum(judged.where("half = 1"), cuts).select("stratum", reject_level(levels).alias("reject_level"))
    chosen = stored(choose_levels(held, levels, risk, delta), "quality-levels")
    rows = _by_stratum(rows, cuts).withColumn("reject_level", reject_level(levels)).drop(*RULES, *[f"cut_{rule}" for rule in RULES])
    rows = _by_stratum(rows, chosen).withColumn("level", F.coalesce(F.col("level"), F.lit(-1)))
    return rows.withColumn("kept", F.expr("not base_failed and coalesce(reject_level > level, true)"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    judged = apply_quality_rules(docs, labels, id_col, text_col, stratum_col, **options)
    stays = judged.where("kept").select("key").distinct()
    at = lambda c: F.col("row").getField(c)
    keyed = as_rows(docs).withColumn("key", row_key(at(id_col), at(text_col), at(stratum_col).cast("string")))
    return of_rows(keyed.join(stays, "key", "left_semi"), docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, judged with the quality labels of ``labels``."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return apply_quality_rules(table("documents"), table("labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "level")
