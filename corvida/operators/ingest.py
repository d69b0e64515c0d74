"""From parsed documents to chunk rows with vectors, in one lazy plan; the store's write is the only action.

``embed`` is the caller's function from a list of texts to vectors (or None for a rejected text), called in batches of 32; if a batch
fails, its texts are tried one by one. A reply of another length than asked is an error.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions.vector import normalized_vector
from corvida.operators.chunking import chunk_profile, split_documents
from corvida.operators.store import ChunkStore, latest_status, number_chunks

BATCH = 32
STATUS = "filename string, status string, chunks_done int, chunks_total int, error string, started_at string, finished_at string, seq bigint"


def vectors_of(reply: dict, n: int) -> list:
    """The ``n`` vectors of an embedding server's reply: ``data`` (ordered by ``index``), ``embeddings``, or ``embedding`` for a single text."""
    if isinstance(reply.get("data"), list):
        got = [x.get("embedding") for x in sorted(reply["data"], key=lambda x: x.get("index", 0))]
    elif isinstance(reply.get("embeddings"), list):
        got = reply["embeddings"]
    else:
        got = [reply["embedding"]] if isinstance(reply.get("embedding"), list) else []
    if len(got) != n:
        raise ValueError(f"{len(got)} vectors for {n} texts")
    return got


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list], batch: int = BATCH, done: Accumulator | None = None) -> DataFrame:
    """``chunks`` with ``embedding``; rejected texts have none. ``done`` counts texts as tasks end."""

    def one(texts: list[str]) -> list:
        try:
            got = list(embed(texts))
        except Exception:
            if len(texts) == 1:
                raise
            return [v for t in texts for v in one([t])]
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return got

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = x["text"].tolist()
            yield x.assign(embedding=[v for i in range(0, len(texts), batch) for v in one(texts[i : i + batch])])
            if done is not None:
                done.add(len(texts))

    return chunks.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>")


def ingest_rows(parsed: DataFrame, embed: Callable[[list[str]], list], section: str | None = None, done: Accumulator | None = None) -> DataFrame:
    """Chunk rows of (filename, part_index, text): profile, split, number, embed, drop rejected ones (their numbers stay), normalise."""
    whole = parsed.where("text is not null").groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "text"))), lambda p: p["text"]), "\n").alias("text"))
    pieces = split_documents(whole.join(chunk_profile(whole, "filename"), "filename"))
    rows = embedded(number_chunks(pieces).select("id", "filename", "chunk_index", "text"), embed, done=done).where("embedding is not null")
    return rows.withColumn("embedding", normalized_vector(F.col("embedding"))).withColumn("section", F.lit(section).cast("string")).withColumn("ord", F.col("chunk_index").cast("long"))


class StatusLog:
    """An append-only log of ingests at ``path``: what was begun, how far it came, how it ended, with UTC stamps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).json(self.path)

    def current(self) -> DataFrame:
        """The last row of each file that has not been deleted since."""
        return latest_status(self.read()).where("status <> 'deleted'")

    def add(self, filename: str, status: str, done: int = 0, total: int = 0, error: str | None = None, started: str | None = None, finished: str | None = None) -> None:
        seq = int(datetime.datetime.now(datetime.timezone.utc).timestamp() * 1e6)
        self.spark.createDataFrame([(filename, status, done, total, error, started, finished, seq)], STATUS).coalesce(1).write.mode("append").json(self.path)

    def busy(self, filename: str) -> bool:
        last = self.read().where(F.col("filename") == filename).orderBy(F.desc("seq")).select("status").first()
        return last is not None and last[0] == "indexing"


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")


def ingest_document(store: ChunkStore, parsed: DataFrame, filename: str, embed: Callable[[list[str]], list], section: str | None = None, log: StatusLog | None = None) -> dict:
    """Replace one document in the store; the status row tells how it went, and a failure leaves the old rows."""
    started, done = now(), store.spark.sparkContext.accumulator(0)
    note = log.add if log is not None else lambda *a, **k: None
    note(filename, "indexing", started=started)
    try:
        mine = parsed.where(F.col("filename") == filename)
        if "error" in mine.columns and (bad := mine.where("error is not null").select("error").first()):
            raise ValueError(bad[0])
        _, n = store.replace(filename, ingest_rows(mine, embed, section, done))
        state = {"filename": filename, "status": "ready", "chunks_done": n, "chunks_total": n, "error": None, "started_at": started, "finished_at": now()}
    except Exception as e:
        state = {"filename": filename, "status": "error", "chunks_done": done.value, "chunks_total": done.value, "error": str(e)[:500], "started_at": started, "finished_at": now()}
    note(filename, state["status"], state["chunks_done"], state["chunks_total"], state["error"], started, state["finished_at"])
    return state
