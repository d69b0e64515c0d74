"""Vectors of rows against vectors of questions, as matrices.

Rows and questions are packed into blocks of bounded size, one row of a table each, and each block of rows meets each block of
questions in one task. Products of matrices find what can matter; what is kept or lies near a rounding edge is summed anew in the
order of the components, so scores have the bits of a plain sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, QUESTIONS = 8192, 1024
AT_ONCE = 1 << 19  # scores held at once


def _packer(keys: list[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = t["v"].combine_chunks()
        dims = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
        gaps = pc.is_null(vectors.flatten()).to_numpy(zero_copy_only=False)
        dims[np.repeat(np.arange(len(dims)), np.maximum(dims, 0))[gaps]] = -1
        for dim in np.unique(dims).tolist():
            part = t.filter(pa.array(dims == dim))
            values = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if dim > 0 else np.zeros(0)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays(part[k].chunks)) for k in keys]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([dim], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=[*keys, "dim", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield from packed(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield from packed(pa.Table.from_batches(held))

    return run


def blocks(rows: DataFrame, vector: str, size: int, prefix: str) -> DataFrame:
    """Blocks of at most ``size`` rows with vectors of one length: the other columns as arrays, ``dim`` (-1: no vector, or one with a gap) and ``v``."""
    keys = [c for c in rows.columns if c != vector]
    schema = ", ".join([*(f"`{k}` array<{rows.schema[k].dataType.simpleString()}>" for k in keys), "dim int", "v binary"])
    out = rows.select(*keys, F.col(vector).cast("array<double>").alias("v")).mapInArrow(_packer(keys, size), schema)
    return out.select(*[F.col(c).alias(prefix + c) for c in out.columns])


def _matrix(values: pa.Buffer, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(values).reshape(n, dim) if dim else np.zeros((n, 0))


def meet(rows: DataFrame, questions: DataFrame, score: Callable, schema: str) -> DataFrame:
    """``score(question keys, their matrix or None, row keys, theirs)`` of each pair of blocks, as record batches.

    ``rows`` has an ``embedding``, ``questions`` a ``query_vector``; keys are the other columns. The matrices are None where lengths differ.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    left = blocks(rows, "embedding", ROWS, "r_").repartition(max(3 * cores, -(-rows.count() // ROWS)))
    right = blocks(questions.repartition(max(1, -(-questions.count() // (4 * QUESTIONS)))), "query_vector", QUESTIONS, "q_")
    names = [[c for c in t.columns if c[2:] not in ("dim", "v")] for t in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys = [{c[2:]: b[c][i].values for c in own} for own in names]
                dims = [b[p + "dim"][i].as_py() for p in ("r_", "q_")]
                c = q = None
                if dims[0] == dims[1] >= 0:
                    c, q = (_matrix(b[p + "v"][i].as_buffer(), len(next(iter(k.values()))), dims[0]) for p, k in zip(("r_", "q_"), keys))
                yield from score(keys[1], q, keys[0], c)

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows of ``a`` and ``b``, component after component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero, as in DuckDB."""
    y = np.abs(x) * 10.0**places
    down = np.floor(y)
    return np.copysign(down + (y - down >= 0.5), x) / 10.0**places


def _steps(q: np.ndarray, c: np.ndarray) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(1, len(c)))
    for at in range(0, len(q), step):
        yield slice(at, min(at + step, len(q)))


def _norms(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt(summed(q, q)), np.sqrt(summed(c, c))


def topk(most: int, cosine: bool = False) -> Callable:
    """A score for ``meet``: the ``most`` best rows of the block for each question by (score to nine places, then ``ord``).

    Columns: the questions' keys, the rows' keys, sim (null for a cosine of a zero vector: last), place (the score to nine places).
    """

    def score(qk: dict, q: np.ndarray | None, rk: dict, c: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if q is None or most < 1:
            return
        order = rk["ord"].to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            nq, nc = _norms(q, c)
            finite = bool(np.isfinite(nq).all() and np.isfinite(nc).all())
            for cut in _steps(q, c):
                rough = q[cut] @ c.T
                if cosine:
                    rough /= nq[cut, None] * nc
                size = 1.0 if cosine else float(nq[cut].max(initial=0)) * float(nc.max(initial=0))
                asked, found = [], []
                for i in range(len(rough)):
                    own = np.where(np.isnan(rough[i]), -np.inf, rough[i]) if cosine else rough[i]
                    if len(own) > most and finite:
                        at = np.flatnonzero(own >= np.partition(own, len(own) - most)[len(own) - most] - 2e-9 - 1e-12 * size)
                    else:
                        at = np.arange(len(own))
                    asked.append(np.full(len(at), cut.start + i))
                    found.append(at)
                asked, found = np.concatenate(asked), np.concatenate(found)
                sim = summed(c[found], q[asked])
                none = np.zeros(len(sim), bool)
                if cosine:
                    both = nc[found] * nq[asked]
                    none, sim = both == 0, sim / both
                place = rounded(sim, 9)
                first = np.lexsort((order[found], np.where(np.isnan(place), 0, -place), ~np.isnan(place), none, asked))
                asked, found, sim, none, place = (x[first] for x in (asked, found, sim, none, place))
                nth = np.arange(len(asked)) - np.searchsorted(asked, asked)
                keep = nth < most
                asked, found = pa.array(asked[keep]), pa.array(found[keep])
                values = [pa.array(x[keep], mask=none[keep]) for x in (sim, place)]
                yield pa.RecordBatch.from_arrays([*(k.take(asked) for k in qk.values()), *(k.take(found) for k in rk.values()), *values], names=[*qk, *rk, "sim", "place"])

    return score


def gates(threshold: float) -> Callable:
    """A score for ``meet``: of every pair (1 + cosine) / 2 to six places, and whether it reaches ``threshold``."""
    gate_of = lambda dots, norms: 1 - (1 - dots / norms) / 2

    def score(qk: dict, q: np.ndarray | None, rk: dict, c: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        n, m = len(next(iter(qk.values()))), len(next(iter(rk.values())))
        with np.errstate(all="ignore"):
            nq, nc = _norms(q, c) if q is not None else (np.zeros(n), np.zeros(m))
            for cut in _steps(nq, nc):
                asked, found = np.repeat(np.arange(cut.start, cut.stop), m), np.tile(np.arange(m), cut.stop - cut.start)
                gate = None
                if q is not None:
                    norms = (nc * nq[cut, None]).ravel()
                    gate = gate_of((q[cut] @ c.T).ravel(), norms)
                    y = gate * 1e6
                    edge = np.flatnonzero(~((np.abs(y - np.floor(y) - 0.5) > 1e-5) & (np.abs(y) > 1e-5)))  # also what is not finite
                    gate[edge] = gate_of(summed(c[found[edge]], q[asked[edge]]), norms[edge])
                    gate = rounded(gate, 6)
                values = [pa.array(gate), pa.array((gate >= threshold) | np.isnan(gate))] if q is not None else [pa.nulls(len(asked), pa.float64()), pa.nulls(len(asked), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(asked)) for k in qk.values()), *(k.take(pa.array(found)) for k in rk.values()), *values], names=[*qk, *rk, "gate", "passes"])

    return score


def schema_of(questions: DataFrame, rows: DataFrame, values: str) -> str:
    """The schema of a score's batches: keys of ``questions`` and of ``rows``, then ``values``."""
    keys = [f for t, v in ((questions, "query_vector"), (rows, "embedding")) for f in t.schema if f.name != v]
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), values])
