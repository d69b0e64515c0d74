"""The service around the engine: settings, request checks, batches of questions answered end to end, re-indexing and removal.

Embedding and chat models are the caller's functions. A question whose embedding or answer fails, or whose ``top_k`` is no positive
number, comes back with a status and an error in its own row; the others are answered.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.functions.vector import normalized_vector
from corvida.operators import answer as A
from corvida.operators import context as C
from corvida.operators import images as I  # noqa: E741
from corvida.operators.ingest import StatusLog, embedded, ingest_document
from corvida.operators.search import hybrid_search, passes_gate
from corvida.operators.store import ChunkStore, started_and_skipped
from corvida.scratch import kept
from corvida.sources.documents import list_files, read_documents

#: What a model is told.
RULES = "Answer only from the context. Do not invent facts. If the context has no answer, say exactly: " + T.NOT_FOUND
SHOWN = 5


class RequestError(Exception):
    """A request that can't be served, with the status that a server would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


# ---- settings
@dataclasses.dataclass(frozen=True)
class Settings:
    """Keys without a default are required."""

    base_url: str
    llm_model: str
    embed_model: str
    api_mode: str
    storage_dir: str
    top_k: int
    chunk_size: int
    chunk_overlap: int
    sim_threshold: float
    api_key: str
    auth_path: str
    auth_user: str
    auth_password: str
    public_url: str = ""
    embed_batch: int = 32
    lexical_weight: float = 0.5

    @classmethod
    def of(cls, values: dict) -> Settings:
        for f in dataclasses.fields(cls):
            if f.default is dataclasses.MISSING and f.name not in values:
                raise KeyError(f"missing required setting {f.name!r}")
        kinds = {"int": int, "float": float, "str": str}
        own = {f.name: kinds[f.type](values[f.name]) for f in dataclasses.fields(cls) if f.name in values}
        return cls(**own | {"api_mode": own["api_mode"].strip().lower()})

    @classmethod
    def read(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                values = json.load(f)
        except FileNotFoundError:
            values = {}
        except ValueError as e:
            raise ValueError(f"{path} is not valid: {e}") from e
        return cls.of(values)

    @property
    def mode(self) -> str:
        """The server's kind: as set, or else as the URL shows."""
        url = self.base_url.rstrip("/").lower()
        if self.api_mode in _ROUTES:
            return self.api_mode
        if any(x in url for x in ("/api/chat/completions", "/ollama/api")):
            return "openwebui"
        if url.endswith("/v1") or "/api/v1" in url:
            return "openai"
        return "openwebui" if self.api_key else "ollama"

    def url(self, task: str) -> str:
        """Where ``task`` (chat or embed) is served."""
        return _root(self.base_url.rstrip("/"), self.mode) + _ROUTES[self.mode][task]


#: Routes by kind of server.
_ROUTES = {
    "ollama": {"chat": "/api/chat", "embed": "/api/embed"},
    "openai": {"chat": "/chat/completions", "embed": "/embeddings"},
    "openwebui": {"chat": "/api/chat/completions", "embed": "/ollama/api/embed"},
}


def _root(url: str, mode: str) -> str:
    if mode == "openai":
        return url if url.endswith("/v1") else f"{url}/api/v1"
    ends = ("/api/chat/completions", "/ollama/api/embed", "/ollama/api", "/api") if mode == "openwebui" else ()
    return next((url.removesuffix(e) for e in ends if url.endswith(e)), url)


# ---- request checks
def checked_top_k(top_k: Column, default: int) -> Column:
    """The number of hits asked for, ``default`` where none is; null where it is not positive."""
    return F.when(top_k.isNull(), F.lit(default)).when(top_k >= 1, top_k).cast("int")


def legacy_top_k(top_k: Column, default: int) -> Column:
    """Older profile: null and 0 are the default, all else is taken as it is."""
    return F.coalesce(F.nullif(top_k, F.lit(0)), F.lit(default)).cast("int")


def require_chunks(chunks: DataFrame) -> None:
    if chunks.isEmpty():
        raise RequestError(503, "the index is empty")


def require_supported(filename: str) -> None:
    if "/" in filename or filename in ("", ".", ".."):
        raise RequestError(400, f"not a plain file name: {filename!r}")
    if not filename.lower().endswith(T.SUPPORTED):
        raise RequestError(400, f"unsupported type; supported are {', '.join(sorted(T.SUPPORTED))}")


# ---- answering
def prompts(context: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, system, user) of (query_id, context) and (query_id, question)."""
    user = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return context.join(questions.select("query_id", "question"), "query_id").select("query_id", F.lit(RULES).alias("system"), user.alias("user"))


def chatted(rows: DataFrame, chat: Callable[[str, str], str]) -> DataFrame:
    """(query_id, raw, failure): the model's answers; an exception or an empty answer is a failure of its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for query_id, system, user in x[["query_id", "system", "user"]].itertuples(index=False):
                try:
                    raw = chat(system, user)
                    out.append((query_id, raw, None) if raw else (query_id, None, "empty answer"))
                except Exception as e:  # one failed call must not end the batch: it is reported in its row
                    out.append((query_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["query_id", "raw", "failure"])

    return rows.mapInPandas(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, raw string, failure string")


def asked_of(questions: DataFrame, embed: Callable[[list[str]], list], default_k: int, rewrite: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(query_id, question, rewritten, k, query_vector) of (query_id, question[, top_k]); a failed embedding has no vector."""

    def safe(texts: list[str]) -> list:
        try:
            return list(embed(texts))
        except Exception:
            if len(texts) > 1:
                raise  # they are tried one by one
            return [None]

    top_k = F.col("top_k") if "top_k" in questions.columns else F.lit(None).cast("int")
    rows = questions.select("query_id", "question", checked_top_k(top_k, default_k).alias("k"))
    if rewrite is None:
        rows = rows.withColumn("text", F.col("question"))
    else:
        rewritten = F.pandas_udf(lambda s: pd.Series(rewrite(s.tolist())), "string")
        rows = rows.withColumn("text", rewritten("question"))
    vector = normalized_vector(F.col("embedding"))
    return embedded(rows, safe).select("query_id", "question", F.col("text").alias("rewritten"), "k", vector.alias("query_vector"))


def context_of(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, pos, filename, chunk_index, text) of hits with their texts: twice as many chunks as hits are asked for; where none are found, the hits."""
    most = 2 * (questions.agg(F.max("k")).first()[0] or 0)
    wide = C.build_context(hits, chunks, most).join(questions.select("query_id", "k"), "query_id").where(F.col("pos") < 2 * F.col("k")).drop("k")
    bare = hits.select("query_id", "rank", "filename", "chunk_index", "text").join(wide.select("query_id").distinct(), "query_id", "left_anti")
    return wide.unionByName(bare.select("query_id", (F.col("rank") - 1).alias("pos"), "filename", "chunk_index", "text"))


def finished(asked: DataFrame, hits: DataFrame, context: DataFrame, replies: DataFrame, base: str = "", threshold: float = 0.65) -> DataFrame:
    """The answers' rows from questions, hits (query_id, rank, filename, text, distance), context and the model's replies.

    query_id, status, error, answer, answer_html, sources, chunks_used, download_urls, image_urls, raw_chunks, rewritten_query.
    """
    base = base.rstrip("/")
    names = F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "filename"))), lambda x: x["filename"])
    sources = C.ordered_sources(context, asked).groupBy("query_id").agg(names.alias("sources"))
    source = I.image_source(hits.withColumn("pos", F.col("rank")), asked)
    pictures = I.image_urls(context, source, base).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("marker", "url"))).alias("image_urls"))
    texts = lambda rows, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias(name))
    shown = texts(context.join(source.select("query_id", "filename"), ["query_id", "filename"]), "shown")
    rows = asked.join(passes_gate(hits, threshold).select("query_id", "found"), "query_id", "left")
    for part in (C.context_string(context), texts(context, "raw"), replies.withColumnRenamed("raw", "reply"), sources, pictures, shown):
        rows = rows.join(part, "query_id", "left")

    found = F.coalesce("found", F.lit(False))
    error = F.when(F.col("k").isNull(), "top_k must be a positive integer").when(F.col("query_vector").isNull(), "embedding failed").when(found & (F.col("failure").isNotNull() | F.col("reply").isNull()), F.concat(F.lit("chat failed: "), F.coalesce("failure", F.lit("no answer"))))
    rows = rows.withColumn("error", error).withColumn("status", F.when(F.col("k").isNull(), 400).when(F.col("error").isNotNull(), 502).otherwise(200)).withColumn("found", found & F.col("error").isNull())
    none = F.array().cast("array<string>")
    if_found = lambda c, other: F.when(F.col("found"), F.coalesce(c, other)).otherwise(other)
    no_urls = F.map_from_arrays(none, none)
    rows = rows.withColumns({"sources": if_found(F.col("sources"), none), "image_urls": if_found(F.col("image_urls"), no_urls), "shown": if_found(F.col("shown"), none), "raw_chunks": if_found(F.slice("raw", 1, SHOWN), none), "chunks_used": if_found(F.col("chunks_used"), F.lit(0)).cast("long")})
    clean = F.when(F.col("found"), A.final_answer(F.col("reply"), F.col("context"))).when(F.col("error").isNull(), F.lit(T.NOT_FOUND))
    rows = rows.withColumn("clean", clean).withColumn("urls", F.transform("sources", lambda f: F.concat(F.lit(f"{base}/files/"), f)))
    rows = rows.withColumn("answer", F.when(F.col("clean") == T.NOT_FOUND, F.col("clean")).otherwise(A.attach_images("clean", "shown", "image_urls")))
    rows = rows.withColumn("pictures", F.map_values("image_urls"))
    return rows.select("query_id", "status", "error", "answer", A.answer_html("answer", "pictures", "sources", "urls").alias("answer_html"), "sources", "chunks_used", F.map_from_arrays("sources", "urls").alias("download_urls"), "image_urls", "raw_chunks", F.col("rewritten").alias("rewritten_query"))


def ask(chunks: DataFrame, questions: DataFrame, embed: Callable[[list[str]], list], chat: Callable[[str, str], str], base: str = "", default_k: int = 5, threshold: float = 0.65, weight: float = 0.5, rewrite: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """A batch of questions (query_id, question[, top_k]) answered: see ``finished``. The model is asked only where the gate lets a question pass."""
    require_chunks(chunks)
    asked = kept(asked_of(questions, embed, default_k, rewrite), "asked")
    search = asked.where("k is not null and query_vector is not null").select("query_id", F.col("rewritten").alias("question"), "query_vector", "k")
    hits = kept(C.with_texts(kept(hybrid_search(chunks, search, weight), "found"), chunks), "hits")
    passed = passes_gate(hits, threshold).where("found").select("query_id")
    found = hits.join(passed, "query_id", "left_semi")
    context = kept(context_of(found, chunks, search), "context")
    replies = kept(chatted(prompts(C.context_string(context), asked), chat), "replies")
    return finished(asked, hits, context, replies, base, threshold)


# ---- documents
def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _stem(filename: str) -> str:
    return filename.rpartition(".")[0] or filename


def delete(store: ChunkStore, log: StatusLog, folder: str, filename: str) -> int:
    """Remove a document, its pictures and its status; how many chunks went."""
    if log.busy(filename):
        raise RequestError(409, f"{filename} is being indexed")
    gone = store.delete(filename)
    if not gone:
        raise RequestError(404, f"{filename} is not in the index")
    _remove(store.spark, f"{folder}/{filename}")
    _remove(store.spark, f"{folder}/{_stem(filename)}_images")
    log.add(filename, "deleted")
    return gone


def reindex(store: ChunkStore, log: StatusLog, folder: str, embed: Callable[[list[str]], list], filename: str) -> dict:
    """Index a stored file again. Its old rows stay until the new ones are there."""
    require_supported(filename)
    if log.busy(filename):
        raise RequestError(409, f"{filename} is being indexed")
    if list_files(store.spark, folder).where(F.col("filename") == filename).isEmpty():
        raise RequestError(404, f"{filename} is not there")
    _remove(store.spark, f"{folder}/{_stem(filename)}_images")
    return ingest_document(store, read_documents(store.spark, f"{folder}/{filename}"), filename, embed, log=log)


def reindex_all(store: ChunkStore, log: StatusLog, folder: str, embed: Callable[[list[str]], list]) -> tuple[list[str], list[str]]:
    """Index all supported files of a folder again, but those being indexed: (started, skipped)."""
    rows = started_and_skipped(list_files(store.spark, folder), log.current()).collect()
    if not rows:
        raise RequestError(404, "no documents")
    started = sorted(r["filename"] for r in rows if r["state"] == "started")
    for filename in started:
        reindex(store, log, folder, embed, filename)
    return started, sorted(r["filename"] for r in rows if r["state"] == "skipped")
