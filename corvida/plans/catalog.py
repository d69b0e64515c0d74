"""Queries by name with the SQL that they are held against. ``QUERIES[name](spark, folder)``; ``SQL[name]`` runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.functions.vector import norm
from corvida.operators import answer as A
from corvida.operators import chunking, context, images, legacy, lexical, pairs, search, service, store
from corvida.scratch import kept
from corvida.sources import documents

QUERIES, SQL = {}, {}
TOP_K, THRESHOLD = 5, 0.65


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as parts of one file per source, not yet numbered."""
    return table(spark, folder, "documents").select(F.concat("source", F.lit(".txt")).alias("filename"), "text", F.col("lang").alias("section"), F.col("doc_id").alias("ord"))


def numbered(rows: DataFrame) -> DataFrame:
    index = (F.row_number().over(W.partitionBy("filename").orderBy("ord")) - 1).cast("int")
    return rows.withColumn("chunk_index", index).withColumn("id", F.concat_ws("_", "filename", "chunk_index"))


def with_vectors(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``embeddings`` by id, where there are any."""
    return rows.join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("ord"), "embedding"), "ord", "left")


def chunks_of(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    """``documents`` as chunks: one file per source; ``embeddings`` by id, where there are any."""
    rows = numbered(texts_of(spark, folder))
    return with_vectors(spark, folder, rows) if vectors else rows


def counted_of(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """The chunks with the counts of the questions' terms: counted first, so that texts are not moved to be numbered."""
    return kept(numbered(lexical.counted(texts_of(spark, folder), asked)), "counted")


def question_of(spark: SparkSession, folder: str) -> DataFrame:
    """The questions: every benchmark text whose id is divisible by 100, with the vector of that id."""
    ask = table(spark, folder, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(TOP_K).alias("k"))
    vector = table(spark, folder, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return ask.join(vector, "query_id", "left")


def hits_of(spark: SparkSession, folder: str) -> DataFrame:
    asked = question_of(spark, folder)
    docs = counted_of(spark, folder, asked)
    return search.hybrid_search(with_vectors(spark, folder, docs), asked, docs=docs)


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# ---- SQL building blocks
TOKEN = T.TOKEN
CHUNKS = "c AS (SELECT source || '.txt' AS filename, cast(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index, source || '.txt_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id, text, lang AS section, doc_id AS ord FROM documents)"
TOKS = f"d AS (SELECT id, ord, filename, regexp_extract_all(lower(filename || ' ' || text), '{TOKEN}') AS toks FROM c)"
TERMS = f"q AS (SELECT item_id AS query_id, text AS question FROM benchmark WHERE item_id % 100 = 0), t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '{TOKEN}')) AS term FROM q), tt AS (SELECT DISTINCT term FROM t)"
TF = """u AS (SELECT id, unnest(toks) AS tok FROM d), k AS (SELECT id, tok, count(*) AS n FROM u GROUP BY ALL),
tf AS (SELECT term, id, CASE WHEN sum(CASE WHEN tok = term THEN n ELSE 0 END) > 0 THEN sum(CASE WHEN tok = term THEN n ELSE 0 END) ELSE sum(n) END AS tf FROM k JOIN tt ON tok = term OR (length(tok) >= 5 AND length(term) >= 5 AND substr(tok, 1, 5) = substr(term, 1, 5)) GROUP BY ALL)"""
BM25 = """s AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)::DOUBLE) AS avg_dl FROM d), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, tf.id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks)::DOUBLE / avg_dl))) AS score FROM tf JOIN df USING (term) JOIN d USING (id) JOIN t USING (term), s GROUP BY query_id, tf.id)"""
BOOST = f"b AS (SELECT query_id, filename, least(count(*) * 0.35::DOUBLE, 1.4::DOUBLE) AS boost FROM (SELECT DISTINCT filename, unnest(regexp_extract_all(lower(regexp_replace(filename, '\\.[^.]+$', '')), '{TOKEN}')) AS term FROM c) JOIN t USING (term) GROUP BY query_id, filename)"
LEX = "lx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) - 1 AS l_rank FROM (SELECT q.query_id, c.id, c.ord, coalesce(bm.score, 0) + coalesce(boost, 0) AS score FROM q CROSS JOIN c LEFT JOIN bm ON bm.query_id = q.query_id AND bm.id = c.id LEFT JOIN b ON b.query_id = q.query_id AND b.filename = c.filename) WHERE score > 0), l AS (SELECT * FROM lx WHERE l_rank < least(40, (SELECT count(*) FROM c)))"
DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
VEC = f"vx AS (SELECT qv.vec_id AS query_id, c.id, {DOT.format('e.embedding', 'qv.embedding')} AS sim, row_number() OVER (PARTITION BY qv.vec_id ORDER BY round({DOT.format('e.embedding', 'qv.embedding')}, 9) DESC, c.ord) - 1 AS v_rank FROM c JOIN embeddings e ON e.vec_id = c.ord, embeddings qv WHERE qv.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 100 = 0)), v AS (SELECT * FROM vx WHERE v_rank < least(40, (SELECT count(*) FROM c)))"
FUSED = "f AS (SELECT query_id, id, sim, v_rank, l_rank, coalesce(0.5::DOUBLE / (v_rank + 61), 0) + coalesce(0.5::DOUBLE / (l_rank + 61), 0) AS rrf FROM v FULL JOIN l USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, v_rank NULLS LAST, l_rank NULLS LAST) AS rank FROM f), h AS (SELECT r.query_id, r.rank, c.*, r.rrf, coalesce(1 - sim, 1::DOUBLE) AS distance FROM r JOIN c USING (id) WHERE rank <= 5)"
HITS = ", ".join((CHUNKS, TOKS, TERMS, TF, BM25, BOOST, LEX, VEC, FUSED))
NEAR = "g AS (SELECT query_id, filename, min(rank) AS doc_rank FROM h GROUP BY query_id, filename), w AS (SELECT DISTINCT h.query_id, c.filename, c.chunk_index, c.text, g.doc_rank FROM c JOIN h ON c.filename = h.filename AND abs(c.chunk_index - h.chunk_index) <= 1 JOIN g ON g.filename = c.filename AND g.query_id = h.query_id), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, chunk_index) - 1 AS pos FROM w)"
ANSWERS = "p AS (SELECT conv_id, turn, text AS answer, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), a AS (SELECT conv_id, turn, answer, context FROM p WHERE role = 'assistant' AND context IS NOT NULL)"
NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


def answers_of(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with the turn before as their context."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, folder, "conversations").withColumn("context", before).where("role = 'assistant' and context is not null")
    return rows.select("conv_id", "turn", F.col("text").alias("answer"), "context")


# ---- listing and chunks
@query(f"WITH {CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT filename) AS total_documents FROM c")
def q01_status(spark, folder):
    return store.totals(chunks_of(spark, folder))


@query(f"WITH {CHUNKS} SELECT filename, count(*) AS chunks FROM c GROUP BY filename")
def q02_chunks_per_document(spark, folder):
    return store.chunks_per_document(chunks_of(spark, folder))


@query("WITH n AS (SELECT source || '.txt' AS filename, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents WHERE trim(text) <> '') SELECT filename, cast(i AS INTEGER) AS chunk_index, filename || '_' || i AS id, doc_id FROM n")
def q03_chunk_numbering(spark, folder):
    texts = table(spark, folder, "documents").select(F.concat("source", F.lit(".txt")).alias("filename"), F.col("doc_id").alias("pos"), "text")
    return store.number_chunks(texts).select("filename", "chunk_index", "id", F.col("pos").alias("doc_id"))


@query(f"SELECT doc_id, cast(len(regexp_extract_all(lower(text), '{TOKEN}')) AS BIGINT) AS n_tokens FROM documents")
def q04_tokens_per_document(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT substr(tok, 1, 5) AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS tok FROM documents) WHERE length(tok) >= 5 GROUP BY 1")
def q05_prefix_stems(spark, folder):
    tok = table(spark, folder, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tok"))
    return tok.select(T.prefix_stem(F.col("tok")).alias("stem")).where("stem is not null").groupBy("stem").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, cast(length({NORM.format('text')}) AS BIGINT) AS n_chars FROM documents")
def q06_normalize_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.length(T.normalized(F.col("text"))).cast("long").alias("n_chars"))


LINES = "ln AS (SELECT {key}, trim(x) AS line FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''), st AS (SELECT {key}, count(*) AS total_lines, avg((length(line) <= 80)::INT) AS short_ratio, avg(regexp_matches(line, '^\\d+[.)]\\s+')::INT) AS numbered_ratio, avg((length(line) <= 120 AND line NOT LIKE '%.' AND len(string_split_regex(line, '\\s+')) <= 12)::INT) AS heading_ratio FROM ln GROUP BY {key})"


@query(f"WITH {LINES.format(key='doc_id')} SELECT doc_id, total_lines, round(short_ratio, 6) AS short_ratio, round(numbered_ratio, 6) AS numbered_ratio, round(heading_ratio, 6) AS heading_ratio FROM st")
def q07_line_stats(spark, folder):
    stats = chunking.line_stats(table(spark, folder, "documents"), "doc_id")
    return stats.select("doc_id", "total_lines", *[F.round(c, 6).alias(c) for c in ("short_ratio", "numbered_ratio", "heading_ratio")])


@query(f"WITH {LINES.format(key='source')}, m AS (SELECT source, short_ratio > 0.45 OR numbered_ratio > 0.15 OR heading_ratio > 0.20 AS cheat FROM st) SELECT source, CASE WHEN cheat THEN 'cheatsheet' ELSE 'manual' END AS profile, CASE WHEN cheat THEN 350 ELSE 800 END AS chunk_size, CASE WHEN cheat THEN 50 ELSE 120 END AS chunk_overlap FROM m")
def q08_chunk_profile(spark, folder):
    return chunking.chunk_profile(table(spark, folder, "documents"), "source")


# ---- vectors
@query(f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 6) AS norm FROM embeddings")
def q09_l2_norm(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {CHUNKS}, {VEC} SELECT query_id, cast(v_rank AS INTEGER) AS v_rank, id, round(1 - sim, 6) + 0 AS distance FROM v")
def q10_vector_topk(spark, folder):
    chunks, n = chunks_of(spark, folder, True), F.lit(table(spark, folder, "documents").count())
    return search.vector_topk(chunks, question_of(spark, folder).drop("question"), search.fetch_size(F.col("k"), n)).select("query_id", F.col("v_rank").cast("int").alias("v_rank"), "id", (F.round(1 - F.col("sim"), 6) + 0.0).alias("distance"))


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format('e.embedding', 'q.embedding')} AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, cast(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 12")
def q11_vector_topk_batch(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("ord % 100 = 0").select(F.col("ord").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = search.vector_topk(vectors, asked, 12)
    return found.select("query_id", F.col("id").alias("vec_id"), (F.col("v_rank") + 1).cast("int").alias("rank"), F.round("sim", 6).alias("sim"))


# ---- lexical search and fusion
@query(f"WITH {CHUNKS}, {TOKS}, {TERMS}, {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def q12_doc_frequency(spark, folder):
    return lexical.document_frequencies(lexical.counted(texts_of(spark, folder), question_of(spark, folder)))


@query(f"WITH {CHUNKS}, {TOKS}, {TERMS}, {TF}, {BM25} SELECT q.query_id, c.id, round(coalesce(score, 0), 6) AS score FROM q CROSS JOIN c LEFT JOIN bm ON bm.query_id = q.query_id AND bm.id = c.id")
def q13_bm25_scores(spark, folder):
    asked = question_of(spark, folder)
    docs = counted_of(spark, folder, asked)
    every = search.every_pair(docs.select("id"), asked.select("query_id"))
    return every.join(lexical.bm25(docs, asked), ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


NAMES = "('a_b_c_d_e.txt'), ('src1 report.txt'), ('plain.txt'), ('a.b.md')"


@query(f"WITH n AS (SELECT * FROM (VALUES {NAMES}) v(filename)), q AS (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'report']) AS term), t AS (SELECT DISTINCT filename, unnest(regexp_extract_all(lower(regexp_replace(filename, '\\.[^.]+$', '')), '{TOKEN}')) AS term FROM n) SELECT filename, round(least(count(*) * 0.35::DOUBLE, 1.4::DOUBLE), 6) AS boost FROM t JOIN q USING (term) GROUP BY filename")
def q14_filename_boost(spark, folder):
    asked = values(spark, "(0, 'a b c d e report')", "query_id, question")
    return lexical.filename_boost(asked, values(spark, NAMES, "filename")).select("filename", F.round("boost", 6).alias("boost"))


@query(f"WITH {HITS} SELECT query_id, id, cast(rank AS INTEGER) AS rank, round(rrf, 6) AS rrf FROM r")
def q15_rrf_fusion(spark, folder):
    asked = question_of(spark, folder)
    docs = counted_of(spark, folder, asked)
    limit = search.fetch_size(F.col("k"), F.lit(docs.count()))
    fused = search.rrf(search.vector_topk(with_vectors(spark, folder, docs), asked, limit).select("query_id", "id", "v_rank"), search.lexical_topk(docs, asked, limit).select("query_id", "id", "l_rank"))
    return fused.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("rrf", 6).alias("rrf"))


@query(f"WITH {HITS} SELECT query_id, cast(rank AS INTEGER) AS rank, id, filename, chunk_index, round(rrf, 6) AS rrf, round(distance, 6) + 0 AS distance FROM h")
def q16_hybrid_search(spark, folder):
    return hits_of(spark, folder).select("query_id", "rank", "id", "filename", "chunk_index", F.round("rrf", 6).alias("rrf"), (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"WITH {HITS} SELECT query_id, round(1 - distance, 6) AS best, 1 - distance >= 0.65 AS found FROM h WHERE rank = 1")
def q17_similarity_gate(spark, folder):
    return search.passes_gate(hits_of(spark, folder), THRESHOLD).select("query_id", F.round("best", 6).alias("best"), "found")


# ---- context
@query(f"WITH {HITS}, {NEAR} SELECT query_id, filename, chunk_index, cast(doc_rank AS INTEGER) AS doc_rank FROM w")
def q18_neighbor_expansion(spark, folder):
    return context.neighbours(kept(hits_of(spark, folder), "hits"), chunks_of(spark, folder)).select("query_id", "filename", "chunk_index", "doc_rank")


@query(f"WITH {HITS}, {NEAR} SELECT query_id, cast(pos AS INTEGER) AS pos, filename, chunk_index FROM x WHERE pos < 10")
def q19_context_budget(spark, folder):
    return context.build_context(kept(hits_of(spark, folder), "hits"), chunks_of(spark, folder), 2 * TOP_K).select("query_id", F.col("pos").cast("int").alias("pos"), "filename", "chunk_index")


@query(f"WITH {HITS}, {NEAR} SELECT query_id, string_agg('[CHUNK ' || pos || ' | ' || filename || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context, count(*) AS chunks_used FROM x WHERE pos < 10 GROUP BY query_id")
def q20_context_string(spark, folder):
    rows = context.build_context(kept(hits_of(spark, folder), "hits"), chunks_of(spark, folder), 2 * TOP_K)
    return context.context_string(rows).select("query_id", "context", "chunks_used")


ROOTS = "list_distinct(list_transform(regexp_extract_all(lower({}), '[а-яёa-z]{{5,}}'), lambda w: substr(w, 1, 5)))"


@query(f"WITH {HITS}, {NEAR}, o AS (SELECT query_id, filename, min(pos) AS first FROM x WHERE pos < 10 GROUP BY query_id, filename), z AS (SELECT query_id, filename, first, len(list_intersect({ROOTS.format('question')}, {ROOTS.format('''replace(replace(filename, '_', ' '), '-', ' ')''')})) AS relevance FROM o JOIN q USING (query_id)) SELECT query_id, filename, cast(relevance AS INTEGER) AS relevance, cast(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, first) AS INTEGER) AS source_rank FROM z")
def q21_ordered_sources(spark, folder):
    rows = context.build_context(kept(hits_of(spark, folder), "hits"), chunks_of(spark, folder), 2 * TOP_K)
    return context.ordered_sources(rows, question_of(spark, folder)).select("query_id", "filename", "relevance", "source_rank")


@query("WITH r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY pos) AS total FROM r) SELECT source, doc_id FROM s WHERE pos <= 3 AND (pos = 1 OR total <= 12000)")
def q22_context_char_cap(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("pos"), "text")
    return context.capped(rows).select(F.col("query_id").alias("source"), F.col("pos").alias("doc_id"))


# ---- answers
BAG = "regexp_extract_all({}, '[A-Za-zА-Яа-яЁё0-9-]{{4,}}')"


@query(f"WITH {ANSWERS}, b AS (SELECT *, {BAG.format(NORM.format('answer'))} AS words, {NORM.format('context')} AS ctx FROM a) SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN true ELSE len(list_filter(words, lambda w: contains(ctx, w)))::DOUBLE / len(words) >= 0.3 END AS faithful FROM b")
def q23_faithfulness(spark, folder):
    return answers_of(spark, folder).select("conv_id", "turn", A.is_faithful(F.col("answer"), F.col("context")).alias("faithful"))


def dressed(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Conversation turns with ``answer``, an expression that gives the text what a model would add."""
    return table(spark, folder, "conversations").select("conv_id", "turn", F.expr(sql).alias("answer"))


@query("SELECT conv_id, turn, text || '~' || CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS answer FROM conversations")
def q24_strip_think(spark, folder):
    rows = dressed(spark, folder, r"concat('<think>', text, '\n', turn, '</think>', text, '~<think>b</think>', if(turn % 2 = 0, text, ''))")
    return rows.select("conv_id", "turn", T.without_thinking(F.col("answer")).alias("answer"))


@query("SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' y' WHEN 2 THEN ' [CHUNK 0 | f]' ELSE '' END AS answer FROM conversations")
def q25_strip_chunk_markers(spark, folder):
    rows = dressed(spark, folder, "concat(text, case turn % 4 when 0 then ' [CHUNK 1]' when 1 then ' ( CHUNK 12 ) y' when 2 then ' [CHUNK 0 | f]' else '(CHUNK 7]' end)")
    return rows.select("conv_id", "turn", T.without_chunk_marks(F.col("answer")).alias("answer"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'a' || text || 'z' WHEN 1 THEN 'a' || text || chr(10) || 'z' ELSE '\"a\" ' || text || ' z' END AS answer FROM conversations")
def q26_clean_answer(spark, folder):
    rows = dressed(spark, folder, r"""case turn % 3 when 0 then concat(' «a', text, 'z» ') when 1 then concat('"\'<think>x\ny</think>a', text, '\\nz [CHUNK 3]\'"') else concat('«"a" ', text, ' z (CHUNK 2)» ') end""")
    return rows.select("conv_id", "turn", T.clean_answer(F.col("answer")).alias("answer"))


@query(f"WITH {ANSWERS}, b AS (SELECT conv_id, turn, {NORM.format('answer')} AS ans, {NORM.format('context')} AS ctx FROM a) SELECT conv_id, turn, length(ans) <= 20 OR contains(ctx, substr(ans, 1, 60)) OR len(list_filter(string_split(ans, ' '), lambda w: contains(ctx, w))) >= greatest(2, len(string_split(ans, ' ')) * 0.4) AS passes FROM b")
def q27_anchor_check(spark, folder):
    return answers_of(spark, folder).select("conv_id", "turn", A.passes_anchor(F.col("answer"), F.col("context")).alias("passes"))


NUMBERED = "SELECT doc_id, doc_id % 50 || ' км, ' || n_chars % 9 || ' %' AS answer, source || ' ' || doc_id % 25 || ' км и ' || n_chars % 7 || ' % от ' || n_chars % 9 || ' %' AS context FROM documents"


@query(f"WITH n AS ({NUMBERED}) SELECT doc_id, len(list_filter(regexp_extract_all(lower(answer), '\\d+[\\s.,]*(?:м|км|мм|%|кг|лет|этаж)'), lambda x: NOT contains(lower(context), trim(x)))) = 0 AS passes FROM n")
def q28_number_check(spark, folder):
    docs = table(spark, folder, "documents")
    answer = F.expr("concat(doc_id % 50, ' км, ', n_chars % 9, ' %')")
    context = F.expr("concat(source, ' ', doc_id % 25, ' км и ', n_chars % 7, ' % от ', n_chars % 9, ' %')")
    return docs.select("doc_id", A.passes_numbers(answer, context).alias("passes"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, cast(len(list_intersect({BAG.format('lower(answer)')}, {BAG.format('lower(context)')})) AS INTEGER) AS shared FROM a")
def q29_bag_overlap(spark, folder):
    words = lambda c: T.bag_words(F.lower(F.col(c)))
    return answers_of(spark, folder).select("conv_id", "turn", F.size(F.array_intersect(words("answer"), words("context"))).alias("shared"))


# ---- mutation and listing
NEW = "('src1.txt_0', 'src1.txt', 0, 'new text', 0), ('src1.txt_1', 'src1.txt', 1, 'more text', 1)"


@query(f"WITH {CHUNKS} SELECT id, filename, chunk_index, text, ord FROM c WHERE filename <> 'src1.txt' UNION ALL SELECT id, filename, chunk_index, text, o + 1 + (SELECT max(ord) FROM c) FROM (VALUES {NEW}) v(id, filename, chunk_index, text, o)")
def q30_replace_document(spark, folder):
    rows = chunks_of(spark, folder).select("id", "filename", "chunk_index", "text", "ord")
    new = values(spark, NEW, "id, filename, chunk_index, text, ord").withColumn("ord", F.col("ord").cast("long"))
    return store.replace_document(rows, "src1.txt", new)


@query(f"WITH {CHUNKS} SELECT id, filename, ord FROM c WHERE filename <> 'src1.txt'")
def q31_delete_document(spark, folder):
    return store.delete_document(chunks_of(spark, folder).select("id", "filename", "ord"), "src1.txt")


STATUS = "('src1.txt', 'indexing'), ('new.pdf', 'error')"


@query(f"WITH {CHUNKS}, n AS (SELECT filename, count(*) AS chunks FROM c GROUP BY filename) SELECT filename, coalesce(chunks, 0) AS chunks, coalesce(status, CASE WHEN coalesce(chunks, 0) > 0 THEN 'ready' ELSE 'unknown' END) AS indexing_status, 'http://host/files/' || filename AS download_url FROM n FULL JOIN (VALUES {STATUS}) v(filename, status) USING (filename)")
def q32_list_documents(spark, folder):
    return store.list_documents(chunks_of(spark, folder), values(spark, STATUS, "filename, status"), "http://host/").orderBy("filename")


@query("WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT 'u' || user_id AS filename, event_type AS status, round_even(event_id % total * 100.0::DOUBLE / total, 1) AS progress_pct FROM r WHERE k = 1")
def q33_document_status(spark, folder):
    log = table(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("filename"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    rows = store.latest_status(log).join(log.groupBy("filename").agg(F.count("*").alias("total")), "filename")
    return rows.select("filename", "status", store.progress(F.col("seq") % F.col("total"), F.col("total")).alias("progress_pct"))


SAFE = "('a.txt'), ('../a.txt'), ('a/b.txt'), (''), ('..'), ('.')"


@query(f"WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT * FROM (VALUES {SAFE}) v(name)) SELECT name, name <> '' AND NOT contains(name, '/') AND name NOT IN ('.', '..') AS safe FROM n")
def q34_safe_filename(spark, folder):
    names = table(spark, folder, "pages").select(F.col("url").alias("name")).unionByName(values(spark, SAFE, "name"))
    return names.select("name", T.safe_filename(F.col("name")).alias("safe"))


ENDS = "CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '.docx' WHEN 4 THEN '/x.md' WHEN 5 THEN '/.hidden' ELSE '.Msg' END"


@query(f"WITH n AS (SELECT doc_id, lang || doc_id || {ENDS} AS name FROM documents), b AS (SELECT *, list_extract(string_split(name, '/'), -1) AS base FROM n), d AS (SELECT *, CASE WHEN contains(base[2:], '.') THEN '.' || list_extract(string_split(base, '.'), -1) ELSE '' END AS ending FROM b) SELECT doc_id, name, lower(ending) AS suffix, base[1:length(base) - length(ending)] AS stem, lower(ending) IN ('.pdf', '.docx', '.txt', '.md', '.msg') AS supported FROM d")
def q35_supported_filter(spark, folder):
    name = F.col("name")
    names = table(spark, folder, "documents").select("doc_id", F.expr(f"concat(lang, doc_id, {ENDS})").alias("name"))
    return names.select("doc_id", "name", T.suffix(name).alias("suffix"), T.stem(name).alias("stem"), T.supported(name).alias("supported"))


# ---- older profile
COSINE = f"({DOT.format('e.embedding', 'q.embedding')} / (sqrt({DOT.format('e.embedding', 'e.embedding')}) * sqrt({DOT.format('q.embedding', 'q.embedding')})))"


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(1 - (1 - {COSINE}) / 2, 6) AS gate, round(1 - (1 - {COSINE}) / 2, 6) >= 0.65 AS passes FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0")
def q36_cosine_gate(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return pairs.meet(vectors, asked, pairs.gates(THRESHOLD), pairs.schema_of(asked, vectors, "gate double, passes boolean"))


KEYWORDS = "about thathe retion wherean"


@query(f"WITH {CHUNKS}, q AS (SELECT list_transform(list_filter(string_split('{KEYWORDS}', ' '), lambda w: length(w) > 4), lambda w: substr(lower(w), 1, 5)) AS roots), s AS (SELECT id, ord, len(list_filter(roots, lambda r: contains(lower(text), r))) AS n FROM (SELECT * FROM c ORDER BY ord LIMIT 500), q WHERE ord >= 3), k AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, ord) AS kw_rank FROM s WHERE n > 0) SELECT id, n AS n_match, cast(kw_rank AS INTEGER) AS kw_rank FROM k WHERE kw_rank <= 5")
def q37_keyword_search(spark, folder):
    chunks = chunks_of(spark, folder)
    return legacy.keyword_hits(chunks, KEYWORDS, chunks.where("ord < 3"), TOP_K).select("id", "n_match", "kw_rank")


@query("SELECT source || '.txt' AS filename, coalesce(nullif(trim(lang), ''), 'general') AS section, count(*) AS chunks FROM documents GROUP BY ALL")
def q38_section_counts(spark, folder):
    rows = chunks_of(spark, folder).withColumn("section", store.section_of(F.col("section")))
    return store.chunks_per_document(rows, "filename", "section")


@query(f"WITH {CHUNKS}, s AS (SELECT q.vec_id AS query_id, c.id, c.ord, {COSINE} AS sim FROM c JOIN embeddings e ON e.vec_id = c.ord, embeddings q WHERE section = 'en' AND q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 100 = 0)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, ord) AS rank FROM s) SELECT query_id, id, cast(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def q39_section_filter_topk(spark, folder):
    found = legacy.cosine_topk(chunks_of(spark, folder, True), question_of(spark, folder), "en")
    return found.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("similarity", 6).alias("similarity"))


# ---- illustrations and pages
PICTURED = "SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' [Рисунок ' || doc_id % 20 || ': img_' || doc_id % 20 || '.png]' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ' then more ' || lang END || '[Рисунок 7: b.jpg] last words [Рисунок x: no]' END AS text FROM documents"
MARK = r"\[Рисунок (\d+): ([^\]]+)\]"


def pictured(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, two of three with two markers, with or without words between them, and something that is none."""
    marks = "concat(text, ' [Рисунок ', doc_id % 20, ': img_', doc_id % 20, '.png]', if(doc_id % 2 = 0, ' ', concat(' then more ', lang)), '[Рисунок 7: b.jpg] last words [Рисунок x: no]')"
    return table(spark, folder, "documents").select("doc_id", "source", "lang", F.expr(f"if(doc_id % 3 = 0, text, {marks})").alias("text"))


@query(f"WITH p AS ({PICTURED}), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{MARK}', 1)) AS number, unnest(regexp_extract_all(text, '{MARK}', 2)) AS image, generate_subscripts(regexp_extract_all(text, '{MARK}', 1), 1) - 1 AS place FROM p) SELECT doc_id, number::INTEGER AS number, image, place::INTEGER AS \"at\" FROM m")
def q40_marker_extract(spark, folder):
    return images.markers(pictured(spark, folder), "doc_id")


@query(f"WITH p AS ({PICTURED}), m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{MARK}', 2)) AS image, unnest(string_split_regex(text, '{MARK}')[:-2]) AS before, generate_subscripts(regexp_extract_all(text, '{MARK}', 2), 1) AS place FROM p), w AS (SELECT *, len(list_distinct(regexp_extract_all(lower(before), '[A-Za-zА-Яа-яЁё0-9-]{{4,}}'))) AS n FROM m), g AS (SELECT *, sum((place = 1 OR n > 0)::INT) OVER (PARTITION BY doc_id ORDER BY place) - 1 AS grp FROM w) SELECT doc_id, grp::INTEGER AS grp, max(CASE WHEN rn = 1 THEN n END)::INTEGER AS n_words, string_agg(image, ',' ORDER BY place) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY place) AS rn FROM g) GROUP BY doc_id, grp")
def q41_marker_groups(spark, folder):
    rows = pictured(spark, folder).withColumn("marks", F.regexp_extract_all("text", F.lit(f"({T.MARKER})"), F.lit(1)))
    rows = rows.withColumn("urls", F.map_from_entries(F.array_distinct(F.arrays_zip("marks", T.marker_names(F.col("text")).alias("url")))))
    groups = rows.select("doc_id", F.posexplode(A.marker_groups(F.col("text"), F.col("urls"))).alias("grp", "g"))
    return groups.select("doc_id", "grp", F.size("g.words").alias("n_words"), F.array_join("g.urls", ",").alias("urls"))


FILE_ROOTS = ROOTS.format("replace(replace(filename, '_', ' '), '-', ' ')")
SHOWN = f"p AS ({PICTURED}), h AS (SELECT doc_id % 10 * 4 AS query_id, doc_id AS pos, substr(list_extract(string_split(text, ' '), 1 + doc_id % 3), 1, 12) || '-' || lang || '_' || source || '.docx' AS filename, text FROM p), q AS (SELECT item_id AS query_id, text || ' source about src' AS question FROM benchmark)"


@query(f"WITH {SHOWN}, f AS (SELECT query_id, filename, count(*) AS n, min(pos) AS first FROM h WHERE regexp_matches(text, '{MARK}') GROUP BY ALL), s AS (SELECT f.*, len(list_intersect({ROOTS.format('question')}, {FILE_ROOTS})) AS score FROM f JOIN q USING (query_id)), r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN top > 0 THEN -score ELSE -n END, first) AS k FROM r) SELECT query_id, filename, score::INTEGER AS score FROM o WHERE k = 1")
def q42_image_source(spark, folder):
    name = "concat(substr(element_at(split(text, ' '), cast(1 + doc_id % 3 as int)), 1, 12), '-', lang, '_', source, '.docx')"
    hits = pictured(spark, folder).select(F.expr("doc_id % 10 * 4").alias("query_id"), F.col("doc_id").alias("pos"), F.expr(name).alias("filename"), "text")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" source about src")).alias("question"))
    return images.image_source(hits, asked)


@query("SELECT * FROM (VALUES (1, '1. open the payment form' || chr(10) || 'u1' || chr(10) || '2. press approve button' || chr(10) || 'u2'), (2, 'no points here')) v(id, answer)")
def q43_attach_images(spark, folder):
    rows = spark.sql("SELECT 1 AS id, concat('1. open the payment form', char(10), '2. press approve button') AS answer, array('open payment form here [Рисунок 1: a.png] then press approve [Рисунок 2: b.png]') AS chunks, map('[Рисунок 1: a.png]', 'u1', '[Рисунок 2: b.png]', 'u2') AS urls UNION ALL SELECT 2, 'no points here', array('text'), map('m', 'u')")
    return rows.select("id", A.attach_images("answer", "chunks", "urls").alias("answer"))


LINE = """CASE turn % 5 WHEN 1 THEN turn || '. ' || text WHEN 2 THEN 'http://h/' || conv_id || '?a=1&b' WHEN 3 THEN turn || ') <b>"' || text || '''' WHEN 4 THEN '  ' ELSE text END"""
ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _markup(template: str, *columns: str) -> str:
    """SQL of a template whose gaps are columns."""
    first, *rest = template.split("{}")
    return " || ".join([_quoted(first), *(f"{c} || {_quoted(after)}" for c, after in zip(columns, rest))])


_NL = " || chr(10) || "
_SOURCE_LIST = _NL.join([*map(_quoted, A._SOURCES), _markup(A._SOURCE, "'http://h/files/f&amp;' || conv_id", "'f&amp;' || conv_id"), "'</ul>'"])
_PAGE = _quoted(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{A._STYLE}</style></head><body>')


@query(rf"""WITH a AS (SELECT conv_id, string_split(string_agg({LINE}, chr(10) ORDER BY turn), chr(10)) AS lines FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM a),
k AS (SELECT conv_id, place, trim(line) AS line, {ESCAPED.format('trim(line)')} AS safe, CASE WHEN trim(line) = 'http://h/' || conv_id || '?a=1&b' THEN 'g' WHEN regexp_matches(trim(line), '^\d+[.)]\s+') THEN 'i' ELSE 'p' END AS kind FROM l WHERE trim(line) <> ''),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'g' THEN kind END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'i', false) AS listed, coalesce(last_value(CASE WHEN kind <> 'g' THEN kind END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'i', false) AS was, lead(kind) OVER (PARTITION BY conv_id ORDER BY place) AS next FROM k),
r AS (SELECT conv_id, place, CASE WHEN kind = 'i' AND NOT was THEN '<ol>' || chr(10) ELSE '' END || CASE kind WHEN 'g' THEN CASE WHEN listed THEN {_markup(A._LIST_IMAGE, 'safe')} ELSE {_markup(A._IMAGE, 'safe')} END WHEN 'i' THEN '<li>' || regexp_replace(safe, '^\d+[.)]\s+', '') ELSE '<p>' || safe || '</p>' END || CASE WHEN listed AND coalesce(next, 'p') = 'p' THEN chr(10) || '</li></ol>' ELSE '' END AS part FROM s)
SELECT conv_id, {_PAGE} || string_agg(part, chr(10) ORDER BY place) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || {_SOURCE_LIST} ELSE '' END || '</body></html>' AS html FROM r GROUP BY conv_id""")
def q44_answer_html(spark, folder):
    line = F.expr(r"""case turn % 5 when 1 then concat(turn, '. ', text) when 2 then concat('http://h/', conv_id, '?a=1&b') when 3 then concat(turn, ') <b>"', text, '\'') when 4 then '  ' else text end""")
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    name, none = F.concat(F.lit("f&"), F.col("conv_id")), F.array().cast("array<string>")
    rows = rows.withColumn("images", F.array(F.concat(F.lit("http://h/"), F.col("conv_id"), F.lit("?a=1&b")))).withColumn("names", F.when(F.col("conv_id") % 2 == 0, F.array(name)).otherwise(none))
    rows = rows.withColumn("urls", F.transform("names", lambda x: F.concat(F.lit("http://h/files/"), x)))
    return rows.select("conv_id", A.answer_html("answer", "images", "names", "urls").alias("html"))


# ---- service
CTX = "y AS (SELECT * FROM x WHERE pos < 10), ctx AS (SELECT query_id, string_agg('[CHUNK ' || pos || ' | ' || filename || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context, count(*) AS chunks_used, list(text ORDER BY pos)[:5] AS raw FROM y GROUP BY query_id)"
SRC = f"o AS (SELECT query_id, filename, min(pos) AS first FROM y GROUP BY query_id, filename), z AS (SELECT o.*, len(list_intersect({ROOTS.format('question')}, {FILE_ROOTS})) AS relevance FROM o JOIN q USING (query_id)), src AS (SELECT query_id, list(filename ORDER BY relevance DESC, first) AS sources FROM z GROUP BY query_id)"


@query(f"WITH {HITS}, {NEAR}, {CTX}, {SRC}, rep AS (SELECT query_id, trim(substr(text, 1, 80)) AS reply FROM y WHERE pos = 0), bb AS (SELECT *, {BAG.format(NORM.format('reply'))} AS words, {NORM.format('context')} AS norm FROM rep JOIN ctx USING (query_id)) SELECT query_id, CASE WHEN len(words) = 0 OR len(list_filter(words, lambda w: contains(norm, w)))::DOUBLE / len(words) >= 0.3 THEN reply ELSE '{T.NOT_FOUND}' END AS answer, array_to_string(sources, '|') AS sources, chunks_used, length(array_to_string(raw, '|')) AS raw_length FROM bb JOIN src USING (query_id)")
def q45_ask(spark, folder):
    asked = question_of(spark, folder).withColumn("rewritten", F.col("question"))
    docs, chunks = counted_of(spark, folder, asked), chunks_of(spark, folder)
    found = kept(search.hybrid_search(with_vectors(spark, folder, docs), asked, docs=docs), "found")
    hits = kept(context.with_texts(found, chunks), "hits")
    found = kept(service.context_of(hits, chunks, asked), "context")
    said = F.concat(F.lit("<think>so\nit is</think> «"), F.trim(F.substring("text", 1, 80)), F.lit(" [CHUNK 1]» "))
    replies = found.where("pos = 0").select("query_id", said.alias("raw"), F.lit(None).cast("string").alias("failure"))
    rows = service.finished(asked, hits, found, replies, "http://host/", threshold=0.0)
    return rows.select("query_id", "answer", F.array_join("sources", "|").alias("sources"), "chunks_used", F.length(F.array_join("raw_chunks", "|")).cast("long").alias("raw_length"))


@query(f"WITH {CHUNKS}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id < 15), l AS (SELECT 'src' || user_id || '.txt' AS filename, event_type AS status, cast(event_id % 40 AS INTEGER) AS done, cast(event_id % 3 * 20 AS INTEGER) AS total FROM e WHERE k = 1), n AS (SELECT filename, cast(count(*) AS INTEGER) AS have FROM c GROUP BY filename) SELECT filename, coalesce(status, 'ready') AS status, coalesce(done, have) AS chunks_done, coalesce(total, have) AS chunks_total, round_even(coalesce(done, have) * 100.0::DOUBLE / CASE WHEN coalesce(total, have) = 0 THEN 1 ELSE coalesce(total, have) END, 1) AS progress_pct FROM l FULL JOIN n USING (filename)")
def q46_document_status(spark, folder):
    log = table(spark, folder, "events").where("user_id < 15").selectExpr("concat('src', user_id, '.txt') as filename", "event_type as status", "cast(event_id % 40 as int) as chunks_done", "cast(event_id % 3 * 20 as int) as chunks_total", "cast(null as string) as error", "cast(ts as string) as started_at", "cast(ts as string) as finished_at", "event_id as seq")
    return store.document_status(log, chunks_of(spark, folder)).select("filename", "status", "chunks_done", "chunks_total", "progress_pct")


@query(f"WITH n AS (SELECT doc_id, lang || doc_id || {ENDS.replace('/', '')} AS filename FROM documents) SELECT filename, CASE WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'started' END AS state FROM n WHERE doc_id % 7 IN (0, 3, 4, 6)")
def q47_started_and_skipped(spark, folder):
    files = table(spark, folder, "documents").select("doc_id", F.expr(f"concat(lang, doc_id, {ENDS.replace('/', '')})").alias("filename"))
    status = files.select("filename", F.when(F.col("doc_id") % 2 == 0, "indexing").otherwise("ready").alias("status"))
    return store.started_and_skipped(files, status)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 5 WHEN event_id % 7 - 2 >= 1 THEN event_id % 7 - 2 ELSE 0 END::INTEGER AS top_k, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 2 THEN 5 ELSE event_id % 7 - 2 END::INTEGER AS legacy FROM events")
def q48_top_k_check(spark, folder):
    asked = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7 - 2)
    return table(spark, folder, "events").select("event_id", F.coalesce(service.checked_top_k(asked, TOP_K), F.lit(0)).alias("top_k"), service.legacy_top_k(asked, TOP_K).alias("legacy"))


@query("WITH b AS (SELECT conv_id, turn, trim(text) AS text, CASE WHEN role = 'assistant' THEN 1 + turn % 3 ELSE 0 END AS n FROM conversations), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS before FROM b), l AS (SELECT conv_id, turn, text || array_to_string(list_transform(range(1, n + 1), lambda i: chr(10) || '[Рисунок ' || (before + i) || ': img_' || lpad((before + i)::VARCHAR, 3, '0') || '.png]'), '') AS part FROM c) SELECT conv_id, trim(string_agg(part, chr(10) || chr(10) ORDER BY turn)) || chr(10) AS preview FROM l GROUP BY conv_id")
def q49_preview_text(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("pos"), F.trim("text").alias("text"), F.expr("if(role = 'assistant', transform(sequence(0L, turn % 3), i -> concat('dir/p', i, '.png')), cast(array() as array<string>))").alias("images"))
    return documents.preview_text(rows, "conv_id")


@query(r"SELECT conv_id, turn, regexp_replace(text || 'Ёж-и 5', '[^ \n\t\r\f\vЀ-ӿɏ-]', '', 'g') AS kept FROM conversations")
def q50_cyrillic_only(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", T.cyrillic_only(F.concat("text", F.lit("Ёж-и 5"))).alias("kept"))


@query(f"WITH p AS ({PICTURED}), m AS (SELECT unnest(regexp_extract_all(text, '{MARK}', 1)) AS number, unnest(regexp_extract_all(text, '{MARK}', 2)) AS image FROM p WHERE source = 'src1') SELECT DISTINCT 0 AS query_id, '[Рисунок ' || number || ': ' || image || ']' AS marker, 'http://host/files/src1_images/' || image AS url FROM m")
def q51_image_urls(spark, folder):
    rows = pictured(spark, folder).select(F.lit(0).alias("query_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.col("doc_id").alias("pos"), "text")
    source = spark.range(1).select(F.col("id").cast("int").alias("query_id"), F.lit("src1.txt").alias("filename"))
    return images.image_urls(rows, source, "http://host/")
