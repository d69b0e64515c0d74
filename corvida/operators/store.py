"""The chunk table: schema, reading, replacing, deleting, listing and ingest status.

A store is a folder of Parquet tables, one per bucket of file names, and manifests that list the valid ones. A mutation writes
the buckets of its files anew and then a manifest, so readers see one state or the other, and a file costs its bucket, not the
store; there is a single writer. Manifests are driver-side metadata; rows never pass through the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T

CHUNKS = "id string, filename string, chunk_index int, text string, embedding array<float>, section string, ord bigint"


def number_chunks(texts: DataFrame, gaps: bool = False) -> DataFrame:
    """(filename, pos, text) to chunks: blank texts go before numbering, or after it with ``gaps`` (older profile)."""
    rows = texts.withColumn("text", T.strip(F.col("text")))
    blank = F.coalesce(F.col("text"), F.lit("")) == ""
    rows = rows if gaps else rows.where(~blank)
    index = (F.row_number().over(W.partitionBy("filename").orderBy("pos")) - 1).cast("int")
    rows = rows.withColumn("chunk_index", index)
    return (rows.where(~blank) if gaps else rows).withColumn("id", F.concat_ws("_", "filename", "chunk_index"))


def replace_document(chunks: DataFrame, filename: str, new: DataFrame) -> DataFrame:
    """``chunks`` without the file's rows, then ``new``, whose ``ord`` goes on after the others'."""
    old = chunks.where(F.col("filename") != filename)
    last = chunks.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    return old.unionByName(new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("last") + 1).drop("last"))  # one row


def delete_document(chunks: DataFrame, filename: str) -> DataFrame:
    return chunks.where(F.col("filename") != filename)


def chunks_per_document(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*(keys or ("filename",))).agg(F.count("*").alias("chunks"))


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("filename").alias("total_documents"))


def latest_status(status: DataFrame) -> DataFrame:
    """The row of highest ``seq`` of each file of an append-only status log."""
    rest = [c for c in status.columns if c != "filename"]
    return status.groupBy("filename").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("filename", "s.*")


def progress(done: Column, total: Column) -> Column:
    """Percent to one place, ties to even; multiplied first, so that 245 of 400 is the tie 61.25 and no bit less or more."""
    return F.rint(done * F.lit(100.0) / F.coalesce(F.nullif(total, F.lit(0)), F.lit(1)) * 10) / 10


def document_status(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """filename, status, chunks_done, chunks_total, progress_pct, error, started_at, finished_at: the last row of the log, else what the chunks tell."""
    have = chunks_per_document(chunks).withColumnRenamed("chunks", "have")
    both = latest_status(log).where("status <> 'deleted'").withColumn("logged", F.lit(True)).join(have, "filename", "full")
    done, total = (F.when(F.col("logged"), F.col(c)).otherwise(F.col("have")).cast("int") for c in ("chunks_done", "chunks_total"))
    rows = both.select("filename", F.coalesce("status", F.lit("ready")).alias("status"), done.alias("chunks_done"), total.alias("chunks_total"), "error", "started_at", "finished_at")
    return rows.select("filename", "status", "chunks_done", "chunks_total", progress(F.col("chunks_done"), F.col("chunks_total")).alias("progress_pct"), "error", "started_at", "finished_at")


def started_and_skipped(files: DataFrame, status: DataFrame) -> DataFrame:
    """(filename, state): supported files whose ingest may start, and those being ingested, which are skipped."""
    busy = status.where("status = 'indexing'").select("filename", F.lit(True).alias("busy")).distinct()
    rows = files.where(T.supported(F.col("filename"))).select("filename").distinct().join(busy, "filename", "left")
    return rows.select("filename", F.when(F.col("busy"), "skipped").otherwise("started").alias("state"))


def list_documents(chunks: DataFrame, status: DataFrame, base: str = "") -> DataFrame:
    """filename, chunks, indexing_status, download_url; files that only have a status are listed too."""
    both = chunks_per_document(chunks).join(status.select("filename", "status"), "filename", "full")
    n = F.coalesce("chunks", F.lit(0))
    state = F.coalesce("status", F.when(n > 0, "ready").otherwise("unknown"))
    return both.select("filename", n.alias("chunks"), state.alias("indexing_status"), F.concat(F.lit(base.rstrip("/") + "/files/"), F.col("filename")).alias("download_url"))


def section_of(section: Column, default: str = "general") -> Column:
    return F.coalesce(F.nullif(T.strip(section), F.lit("")), F.lit(default))


class ChunkStore:
    """A versioned chunk table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the manifests, oldest first."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions() if version is None else [version]
        if not found:
            return {"buckets": {}, "next_ord": 0}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/v{found[-1]}.json").collect()))

    def _commit(self, manifest: dict, keep: int = 2) -> int:
        """A new manifest, in place at once by a rename; manifests beyond ``keep``, and tables that no manifest names, go."""
        found = self.versions()
        version = max([int(time.time() * 1000), *(v + 1 for v in found)])
        hidden = self._path(f"{self.path}/.v{version}.tmp")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.rename(hidden, self._path(f"{self.path}/v{version}.json"))
        for old in found[: max(0, len(found) + 1 - keep)]:
            self._fs.delete(self._path(f"{self.path}/v{old}.json"), False)
        named = {d for v in self.versions() for d in self._manifest(v)["buckets"].values()}
        for x in self._fs.listStatus(self._path(f"{self.path}/data")) if self._fs.exists(self._path(f"{self.path}/data")) else []:
            if x.getPath().getName() not in named:
                self._fs.delete(x.getPath(), True)
        return version

    def _table(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], CHUNKS)
        rows = self.spark.read.schema(CHUNKS).parquet(*[f"{self.path}/data/{n}" for n in names])
        return rows.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0)))

    def read(self) -> DataFrame:
        return self._table(list(self._manifest()["buckets"].values()))

    def recover(self) -> str | None:
        """Put aside the newest state if it can't be read, so that the one before counts, or an empty store; its new name, if so."""
        found = self.versions()
        if not found:
            return None
        try:
            self._table(list(self._manifest(found[-1])["buckets"].values())).select("id", "embedding").write.format("noop").mode("overwrite").save()
            return None
        except Exception:  # whatever is wrong with it, it is put aside, not deleted
            aside = f"{self.path}/v{found[-1]}.json.bak.{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
            self._fs.rename(self._path(f"{self.path}/v{found[-1]}.json"), self._path(aside))
            return aside

    def _bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(filename), {self.buckets}) as int)")

    def put(self, filenames: list[str], new: DataFrame | None, required: bool = False) -> tuple[int, int]:
        """Replace the rows of these files by ``new``, whose ``ord`` goes on after all others'. (Rows that went, rows that came.)

        ``new`` is evaluated once; if it is ``required`` and has no rows, nothing changes. Only the files' own buckets are read and written.
        """
        manifest = self._manifest()
        staged, came = None, 0
        if new is not None:
            path = f"{self.path}/data/staged-{uuid.uuid4().hex}"
            new.select(*[F.col(f.name) for f in self.spark.createDataFrame([], CHUNKS).schema]).write.parquet(path)
            staged = self.spark.read.schema(CHUNKS).parquet(path)
            came = staged.count()
            if required and not came:
                raise ValueError(f"no chunks for {', '.join(filenames)}")
        names = self.spark.createDataFrame([(f,) for f in filenames], "filename string")
        touched = {r[0] for r in names.select(self._bucket()).distinct().collect()}
        old = self._table([d for b, d in manifest["buckets"].items() if int(b) in touched])
        gone = old.join(F.broadcast(names), "filename", "left_semi").count()
        if not gone and not came:
            return 0, 0
        rows = old.join(F.broadcast(names), "filename", "left_anti").select(*old.columns)
        if staged is not None:
            order = W.partitionBy("filename").orderBy("chunk_index")
            sizes = staged.groupBy("filename").agg(F.count("*").alias("n"))  # one row per new file
            before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("filename").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
            fresh = staged.withColumn("place", F.row_number().over(order) - 1).join(before, "filename")
            rows = rows.unionByName(fresh.withColumn("ord", F.col("before") + F.col("place") + manifest["next_ord"]).select(*old.columns))
        stamp = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/data/{stamp}")
        there = {x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/data/{stamp}"))}
        for b in touched:
            manifest["buckets"].pop(str(b), None)
            if f"bucket={b}" in there:
                name = f"{stamp}-{b}"
                self._fs.rename(self._path(f"{self.path}/data/{stamp}/bucket={b}"), self._path(f"{self.path}/data/{name}"))
                manifest["buckets"][str(b)] = name
        manifest["next_ord"] += came
        self._commit(manifest)
        return gone, came

    def replace(self, filename: str, new: DataFrame) -> tuple[int, int]:
        """Rows that went and came. Without new rows nothing changes: a failed ingest keeps what there was."""
        return self.put([filename], new.where(F.col("filename") == filename), required=True)

    def delete(self, filename: str) -> int:
        return self.put([filename], None)[0]

    def faults(self) -> DataFrame:
        """Rows whose vector is not of unit length, all of them checked, or of another size than most."""
        from corvida.functions.vector import norm

        rows = self.read().where("embedding is not null").withColumn("size", F.size("embedding"))
        usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select(F.col("size").alias("usual"))  # one row
        return rows.crossJoin(F.broadcast(usual)).where((F.abs(norm(F.col("embedding")) - 1) > 0.01) | (F.col("size") != F.col("usual"))).drop("size", "usual")
