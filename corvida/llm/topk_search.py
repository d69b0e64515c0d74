"""Exact top-k inner products by three-phase uniform thresholds.

The components are dealt to ``LISTS`` slices, as lists of partial scores held by separate nodes would be. Phase 1
gathers, per query, the k best partial scores of each slice and each slice's minimum. From these, lower bounds of whole
scores follow (an unseen partial score is at least its slice's minimum); with the partial scores taken from their
minima on, the k-th best lower bound divided by the number of slices is the uniform cutoff. Phase 2 broadcasts (joins)
the cutoffs back to the queries and collects the entries with a partial score at or over it in any slice: whatever is not collected has
a whole score under the k-th best. Phase 3 resolves the collected vectors' scores exactly, keeping per block the k best.

Scale. Vectors and queries are cut into blocks (``BLOCK``, ``QUERY_BLOCK``), and each pair of a vector block and
a query block is one group of bounded size, multiplied as matrices; only partial lists and collected entries
leave it. Scores are integers: products of floats are exact below 2**53 (checked per block), else integer products are used.

Defined cases. Null vectors, those with null or non-finite components, and null ids take no part. Rows that share an
id count once (the smallest vector). Vectors of another length than the query's take no part for it. Ties go to
the smaller id. Fewer candidates than k: all. Empty input: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.llm.common import stored

LISTS = 4
BLOCK, QUERY_BLOCK = 8192, 1024


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q @ c.T).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T


def _slices(dim: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, dim, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _blocks(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    for dim in sorted(set(q["dim"]) & set(c["dim"])):
        yield q[q["dim"] == dim].reset_index(drop=True), c[c["dim"] == dim].reset_index(drop=True)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _phase1(k: int, lists: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, c in _blocks(q, c):
            a, b, ids = _matrix(q), _matrix(c), c["id"].to_numpy()
            for j, cut in enumerate(_slices(a.shape[1], lists)):
                partial = _product(a[:, cut], b[:, cut])
                for i, qid in enumerate(q["id"]):
                    other = ids != qid
                    s, own = partial[i][other], ids[other]
                    if len(s):
                        at = _best(s, own, k)
                        out.append((qid, j, own[at].tolist(), s[at].tolist(), int(s.min())))
        return pd.DataFrame(out, columns=["query_id", "slice", "ids", "scores", "least"])

    return run


def _phase2(k: int, lists: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, c in _blocks(q, c):
            a, b, ids = _matrix(q), _matrix(c), c["id"].to_numpy()
            partial = [_product(a[:, cut], b[:, cut]) for cut in _slices(a.shape[1], lists)]
            for i, (qid, cutoff, least) in enumerate(zip(q["id"], q["cutoff"], q["least"])):
                rows = np.stack([p[i] for p in partial])
                sent = ((rows - np.asarray(least)[:, None]) * lists >= cutoff).any(axis=0) & (ids != qid)
                at = np.flatnonzero(sent)
                whole = rows[:, at].sum(axis=0)  # phase 3
                best = _best(whole, ids[at], k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at][best], "score": whole[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def exact_topk(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on ``id``, the id column's name in here."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    clean = clean.where("id is not null and x is not null and size(x) > 0 and forall(x, y -> y is not null and not isnan(y) and abs(y) < double('infinity'))")
    clean = clean.groupBy("id").agg(F.min("x").alias("x")).select("id", F.expr(f"transform(x, y -> double(floor({scale} * y)))").alias("v"), F.expr("size(x)").alias("dim"))
    clean = stored(clean, "topk-vectors")
    rows, asked = clean.count(), clean.where(is_query).count()
    parts, turns = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    block = lambda n, seed: F.expr(f"cast(pmod(xxhash64(id, {seed}), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = clean.withColumn("part", block(parts, 1)).withColumn("turn", every(turns))
    own = [F.col(c).alias(c) for c in ("id", "v", "dim")]  # fresh columns: the two sides stem from one table
    queries = clean.where(is_query).select(*own).withColumn("turn", block(turns, 2))
    spread = lambda q: q.withColumn("part", every(parts)).groupBy("part", "turn")
    grouped = candidates.groupBy("part", "turn")

    lists_ = spread(queries).cogroup(grouped).applyInPandas(_phase1(k, lists), "query_id long, slice int, ids array<long>, scores array<long>, least long")
    lists_ = stored(lists_, "topk-lists")
    low = lists_.groupBy("query_id", "slice").agg(F.min("least").alias("least"))
    entries = lists_.select("query_id", "slice", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query_id", "slice", "e.ids", "e.scores")
    first = W.partitionBy("query_id", "slice").orderBy(F.desc("scores"), "ids")
    entries = entries.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    above = entries.join(low, ["query_id", "slice"]).groupBy("query_id", "ids").agg(F.sum(F.col("scores") - F.col("least")).alias("bound"))
    kth = W.partitionBy("query_id").orderBy(F.desc("bound"), "ids")
    cutoffs = above.withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("bound")).otherwise(0).alias("cutoff"))
    leasts = low.groupBy("query_id").agg(F.expr("transform(array_sort(collect_list(struct(slice, least))), e -> e.least)").alias("least"))
    queries = queries.join(cutoffs, F.col("id") == F.col("query_id")).drop("query_id").join(leasts, F.col("id") == F.col("query_id")).drop("query_id")
    found = spread(queries).cogroup(grouped).applyInPandas(_phase2(k, lists), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``; every fiftieth id is a query."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")
