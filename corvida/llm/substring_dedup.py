"""Incremental removal of repeated word windows with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts anywhere else, in the same document or another.

Method. Each window is represented by its smallest hash among its ``GRAM``-word sub-windows (a minimiser): equal
windows have equal minimisers, and one minimiser stands for a *stretch* of up to ``WINDOW - GRAM + 1`` consecutive
windows, so the index has about a twelfth as many entries as there are windows. The index is a log-structured set of
immutable Parquet runs of fingerprints, each bucketed and sorted by fingerprint. Each new batch is aggregated, sorted,
merge-joined with the runs of history, added as a new run, and runs of the same level are compacted two by two. What
the joins bring up is verified: stretches whose whole word sequence recurs are settled by (fingerprint, hash of the
whole stretch); the others are opened and their windows compared one by one by (fingerprint, window hash), 128 bits in all.

Scale. Nothing is broadcast or collected. Entries are pre-aggregated by fingerprint, so a passage that fills a third
of all rows is one entry; runs share their buckets, so history is never shuffled again; joins back to documents are
plain equi-joins that adaptive execution splits. Shuffle files of a step go when it ends.

Repeated rows share a key and are opened once, so neither their stretches nor their spans are gathered per copy. Keys, fingerprints
and window hashes have 64 bits each, and windows are told apart by two of them.

Defined cases. Null and empty texts have no words. Fewer than 35 words: nothing goes. Repeated rows are documents like
any other, so each is the other's copy. A null doc_id is kept as null. Empty input gives an empty result. Only the id
and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import delete_path, delete_table, mixed, rolled, row_key, scratch, shuffles_removed, sliding_min, stored

WINDOW, GRAM = 35, 12
#: Index entries per bucket, beyond which there are more buckets.
BUCKET_ENTRIES = 4_000_000

_POSTING = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("stretch", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
_POSTING_DDL = "key long, fp long, stretch long, start long, n int"


def _word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _stretches(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(window hashes, starts, lengths, fingerprints, hashes) of the stretches of one document."""
    w = rolled(h, window)
    reach = window - gram + 1
    least = sliding_min(mixed(rolled(h, gram)), reach)
    fresh = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    lengths = np.diff(np.r_[fresh, len(least)])
    if lengths.max() > reach:  # a minimum that recurs within reach: cut, so that it is seen as recurring
        pieces = -(-lengths // reach)
        first = np.repeat(fresh, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        fresh = first + nth * reach
        lengths = np.diff(np.r_[fresh, len(least)])
    offset = np.arange(len(w)) - np.repeat(fresh, lengths)
    folded = np.add.reduceat(mixed(w + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), fresh)
    return w, fresh, lengths, least[fresh], mixed(folded + lengths.astype(np.uint64))


def _repeated(w: np.ndarray) -> np.ndarray:
    """Windows that occur more than once in their own document."""
    order = np.sort(w)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    return np.isin(w, twice) if len(twice) else np.zeros(len(w), bool)


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def _postings(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            valid: list[np.ndarray] = []
            for key, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()):
                h = _word_hashes(text)
                if len(h) < window:
                    continue
                w, starts, lengths, fp, stretch = _stretches(h, window, gram)
                own, own_n = _spans(_repeated(w))  # settled at once: fingerprint null
                n = len(starts) + len(own)
                for part, x in zip(parts, (np.full(n, key), np.r_[fp.view(np.int64), np.zeros(len(own), np.int64)], np.r_[stretch.view(np.int64), np.zeros(len(own), np.int64)], np.r_[starts, own], np.r_[lengths, own_n])):
                    part.append(x)
                valid.append(np.arange(n) >= len(starts))
            if valid:
                null = np.concatenate(valid)
                key, fp, stretch, start, n = map(np.concatenate, parts)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp, mask=null), pa.array(stretch, mask=null), pa.array(start), pa.array(n.astype(np.int32))], schema=_POSTING)

    return run


def _opened(window: int, gram: int):
    """Rows (key, start, fp, window hash) of the stretches named in the third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, fps, hashes = [], [], [], []
            for key, text, opens in zip(*(c.to_pylist() for c in batch.columns)):
                w = rolled(_word_hashes(text), window)
                for o in {(o["start"], o["n"], o["fp"]) for o in opens}:
                    at = np.arange(o[0], min(o[0] + o[1], len(w)))
                    keys.append(np.full(len(at), key)), starts.append(at), fps.append(np.full(len(at), o[2])), hashes.append(w[at].view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, starts, fps, hashes)], names=["key", "start", "fp", "hash"])

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed_n, digests, texts = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                words_n.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int32)
                    start, n = np.array([s["start"] for s in spans]), np.array([s["n"] for s in spans])
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed_n.append(words_n[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints; ``runs`` has (level, table), oldest first.

    Every run is bucketed by ``fp`` into the same number of buckets, so matching and compaction merge bucket with
    bucket and shuffle nothing of the history.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = 2):
        self.spark, self.buckets, self.fan_in, self.runs, self._paths = spark, buckets, fan_in, [], {}

    def _write(self, rows: DataFrame, name: str) -> str:
        table, path = f"{name}_{uuid.uuid4().hex}", scratch(self.spark, name)
        with shuffles_removed(self.spark):
            rows.write.format("parquet").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(table)
        self._paths[table] = path
        return table

    def _delete(self, table: str) -> None:
        self.spark.sql(f"drop table {table}")
        delete_path(self.spark, self._paths.pop(table))

    def add(self, postings: DataFrame) -> DataFrame:
        """Match a batch's fingerprints with history and itself, then keep it as a run. Returns the shared ones (fp), stored."""
        name = self._write(postings.groupBy("fp").agg((F.count("*") > 1).alias("again")), "fp_run")
        batch = self.spark.table(name)
        shared = batch.where("again").select("fp")
        for _, run in self.runs:
            shared = shared.unionByName(batch.select("fp").join(self.spark.table(run).select("fp").hint("merge"), "fp", "left_semi"))
        shared = stored(shared, "fp-shared")
        self.runs.append((0, name))
        self.compact()
        return shared

    def compact(self) -> None:
        """Merge the newest runs while ``fan_in`` of them have the same level."""
        while len(self.runs) >= self.fan_in and len({level for level, _ in self.runs[-self.fan_in :]}) == 1:
            old = self.runs[-self.fan_in :]
            first, *rest = [self.spark.table(run).select("fp") for _, run in old]
            for other in rest:
                first = first.join(other.hint("merge"), "fp", "full_outer")
            self.runs = self.runs[: -self.fan_in] + [(old[0][0] + 1, self._write(first.withColumn("again", F.lit(False)), "fp_run"))]
            for _, run in old:
                self._delete(run)

    def drop(self) -> None:
        """Delete all runs."""
        for _, run in self.runs:
            self._delete(run)
        self.runs = []


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 4, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text (if ``with_text``). ``batches`` arrive one after the other."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", row_key("doc_id", "text"))
    path = scratch(spark, "postings")
    docs.select("key", "text").mapInArrow(_postings(window, gram), _POSTING_DDL).withColumn("batch", F.expr(f"pmod(key, {batches})")).write.partitionBy("batch").parquet(path)
    postings = spark.read.schema(_POSTING_DDL + ", batch int").parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = FingerprintIndex(spark, parts * max(1, -(-postings.count() // (parts * BUCKET_ENTRIES))))
    try:
        shared = [index.add(postings.where((F.col("batch") == b) & F.col("fp").isNotNull()).select("fp")) for b in range(batches)]
    finally:
        index.drop()  # also after a failed step: its tables are in the caller's catalogue
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    shared = stored(union(shared).distinct(), "fp-shared")  # a plain table, so that the join on a hot fingerprint can be split
    own = postings.where("fp is null").select("key", "fp", "stretch", "start", "n")
    found = stored(postings.where("fp is not null").join(shared, "fp").select(*own.columns).unionByName(own), "fp-found")
    delete_path(spark, path)  # all that is read later is stored
    # stretches whose whole word sequence recurs are settled, as are the windows that recur in their own document
    whole = stored(found.where("fp is not null").groupBy("fp", "stretch").count().where("count > 1").select("fp", "stretch", F.lit(True).alias("recurs")), "fp-whole")
    found, unjudged = stored(found.join(whole, ["fp", "stretch"], "left"), "fp-judged"), found
    delete_table(unjudged)
    settled = found.where("fp is null or recurs").select("key", "start", "n")
    # of stretches that recur as a whole, one stands for all where the fingerprint has others too
    others = found.where("fp is not null and recurs is null")
    one = found.where("recurs").groupBy("fp", "stretch").agg(F.min(F.struct("key", "start", "n")).alias("x")).join(others.select("fp").distinct(), "fp", "left_semi").select("x.key", "fp", "x.start", "x.n")
    opens = others.select("key", "fp", "start", "n").unionByName(one).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n", "fp")).alias("opens"))
    windows = stored(docs.select("key", "text").join(opens, "key").select("key", "text", "opens").dropDuplicates(["key"]).mapInArrow(_opened(window, gram), "key long, start long, fp long, hash long"), "fp-windows")
    twice = windows.groupBy("fp", "hash").count().where("count > 1").select("fp", "hash")
    settled = settled.unionByName(windows.join(twice, ["fp", "hash"]).select("key", "start", F.lit(1).alias("n")))
    spans = stored(settled.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "fp-spans")
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_kept(window, with_text), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` through the index in four batches."""
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
