"""The retrieval engine: hand-made cases, invariants, and the catalogue against DuckDB."""

from __future__ import annotations

import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.operators import answer, chunking, context, ingest, search, service, store
from corvida.plans.catalog import QUERIES, SQL
from corvida.sources import documents
from corvida.streaming.ingest import ingest_stream


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue(spark, small, oracle, name):
    got, want = QUERIES[name](spark, small).toPandas(), oracle.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


def test_text(spark):
    assert one(spark, T.clean_answer, a=" «Ответ» ") == "Ответ"
    assert one(spark, T.without_chunk_marks, a="x [CHUNK 0 | f]") == "x [CHUNK 0 | f]"
    assert one(spark, T.tokens, a="Étion Hello-World 5") == ["tion", "hello", "world", "5"]
    assert one(spark, T.normalized, a="  A \n b ") == "a b"
    assert one(spark, T.lines, a="a  b \r\n\n c") == ["a", "b", "c"]
    assert one(spark, T.message_text, s="Hi", f=None, d=" ", b="body") == "Subject: Hi\n\nbody"
    assert one(spark, T.html_escaped, a="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, store.progress, a=0, b=0) == 0.0


def test_progress_rounds_ties_as_sql(spark, oracle):
    totals = "40, 80, 400, 2000, 4020"
    got = spark.sql(f"select t, explode(sequence(0, t - 1)) k from (select explode(array({totals})) t)").select("t", "k", store.progress(F.col("k"), F.col("t")).alias("p"))
    want = oracle.sql(f"SELECT t, k, round_even(k * 100.0::DOUBLE / t, 1) AS p FROM (SELECT unnest([{totals}]) AS t), range(4020) r(k) WHERE k < t").df()
    assert {(r["t"], r["k"]): r["p"] for r in got.collect()} == {(t, k): p for t, k, p in want.itertuples(index=False)}


def test_checks(spark):
    assert one(spark, answer.is_faithful, a="a bc", c="x") is True
    words = " ".join(["same"] * 3 + ["miss"] * 7)
    assert one(spark, answer.is_faithful, a=words, c="the same") is True
    assert one(spark, answer.is_faithful, a=words + " miss", c="the same") is False
    assert one(spark, answer.final_answer, a="nothing shared here", c="ctx") == T.NOT_FOUND


def test_points_and_images(spark):
    assert one(spark, answer.split_points, a="Intro\n1. a\nmore\n2) b\ntail") == ["1. a\nmore", "2) b\ntail"]
    assert one(spark, answer.split_points, a="x\n \ny") == ["x", "y"]
    row = spark.sql("select 'word [Рисунок 1: a.png] [Рисунок 2: b.png] word [Рисунок 3: c.png] [Рисунок 4: d.png]' c, map('[Рисунок 1: a.png]', 'u1', '[Рисунок 2: b.png]', 'u2', '[Рисунок 3: c.png]', 'u3') u")
    assert [g["urls"] for g in row.select(answer.marker_groups(F.col("c"), F.col("u"))).first()[0]] == [["u1", "u2"], ["u3"]]
    page = spark.sql("select '1. a\nu1\nend' a, array('u1') i, array('f') n, array('d') u").select(answer.answer_html("a", "i", "n", "u")).first()[0]
    assert "<ol>\n<li>a\n<br><img" in page and "</li></ol>\n<p>end</p>" in page and 'href="d"' in page


def test_greedy_images(spark):
    # against a plain procedure: points in order, each takes the free group with most shared words, the first of equals
    import random
    import re

    rng, rows = random.Random(3), []
    words = [f"word{i}" for i in range(12)]
    for i in range(60):
        say = lambda n: " ".join(rng.choices(words, k=n))
        lines = [f"{k + 1}. {say(rng.randint(1, 6))}" if rng.random() < 0.7 else say(3) for k in range(rng.randint(0, 5))]
        chunks = [" ".join(f"{say(rng.randint(0, 4))} [Рисунок {k}: {c}{k}.png]" for k in range(rng.randint(0, 4))) for c in "ab"]
        marks = re.findall(r"\[Рисунок \d+: [^\]]+\]", " ".join(chunks))
        rows.append((i, "\n".join(lines), chunks, {m: "u" + m[-9:-1] for m in marks if rng.random() < 0.8}))
    bag = lambda t: set(re.findall(T.BAG_WORD, re.sub(r"\[Рисунок \d+: [^\]]+\]", "", t).lower()))
    want = {}
    for i, text, chunks, urls in rows:
        free = []
        for c in chunks:
            own, seen = [], 0
            for m in re.finditer(r"\[Рисунок \d+: [^\]]+\]", c):
                before, seen = bag(c[seen : m.start()]), m.end()
                if m[0] in urls and (before or not own):
                    own.append((before, [urls[m[0]]]))
                elif m[0] in urls:
                    own[-1][1].append(urls[m[0]])
            free += own
        points = re.findall(r"(?:^|\n)(\d+[.)]\s+.*?)(?=\n\d+[.)]\s+|\Z)", text, re.DOTALL) or [x for x in text.split("\n") if x.strip()]
        out = []
        for p in points:
            best = max(free, key=lambda g: len(bag(p) & g[0]), default=None)
            take = best is not None and len(bag(p) & best[0]) >= 2
            out.append("\n".join([p, *best[1]]) if take else p)
            if take:
                free.remove(best)
        want[i] = "\n".join(out) if points and any(m in urls for c in chunks for m in re.findall(r"\[Рисунок \d+: [^\]]+\]", c)) else text
    df = spark.createDataFrame(rows, "id int, answer string, chunks array<string>, urls map<string,string>")
    assert {r["id"]: r["a"] for r in df.select("id", answer.attach_images("answer", "chunks", "urls").alias("a")).collect()} == want


def test_fusion(spark):
    lists = lambda ids, rank: spark.createDataFrame([(0, x, i) for i, x in enumerate(ids)], f"query_id int, id string, {rank} int")
    order = lambda v, l, w: [r["id"] for r in search.rrf(lists(v, "v_rank"), lists(l, "l_rank"), w).orderBy("rank").collect()]  # noqa: E731, E741
    assert order(["a", "b"], ["b", "a"], 0.5) == ["a", "b"]
    assert order(["a"], ["b"], 1.0) == ["b", "a"]


def test_more_questions_than_a_batch(spark):
    from corvida.operators import legacy

    chunks = spark.createDataFrame([(f"c{i}", i, [float(i == j) for j in range(3)]) for i in range(3)], "id string, ord long, embedding array<double>")
    questions = spark.range(1200).select(F.col("id").alias("query_id"), F.array(*[(F.col("id") % 3 == j).cast("double") for j in range(3)]).alias("query_vector"), F.lit(1).alias("k"))
    for found in (search.vector_topk(chunks, questions, 1), legacy.cosine_topk(chunks, questions)):
        assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(i, f"c{i % 3}") for i in range(1200)]


def test_terms_are_counted_where_texts_are_read(spark, small):
    from corvida.operators import lexical
    from corvida.plans import catalog

    texts = ["Marking mark marks MARK-5 a_b", "ключевые слова, Ключ ключевой 5", "naïve market\x00mark\u0130", "", None]
    rows = spark.createDataFrame([(i, "f.x.txt", t) for i, t in enumerate(texts)], "ord long, filename string, text string")
    asked = spark.createDataFrame([(0, "mark marker Ключевая 5 txt"), (1, "mark")], "query_id long, question string")
    got = {r["ord"]: (r["dl"], {h["term"]: h["tf"] for h in r["hits"]}) for r in lexical.counted(rows, asked).collect()}
    ways = {  # exact count, else stems of five letters: markin, market and marke(r) differ from mark, market has the stem of marker
        0: (10.0, {"mark": 2, "5": 1, "txt": 1}),
        1: (8.0, {"ключевая": 2, "5": 1, "txt": 1}),
        3: (3.0, {"txt": 1}),
        4: (3.0, {"txt": 1}),
    }
    assert {k: v for k, v in got.items() if k != 2} == ways
    tokens = rows.where("ord = 2").select(T.tokens(F.concat_ws(" ", "filename", "text"))).first()[0]
    assert got[2] == (float(len(tokens)), {"marker": 1, "txt": 1})
    for df in (catalog.numbered(lexical.counted(catalog.texts_of(spark, small), asked)), context.with_texts(spark.sql("select 'src1.txt' filename, 1L ord"), catalog.chunks_of(spark, small))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan or plan.index("MapInArrow") > plan.index("Window")  # texts are read below it, and not moved


def test_vectors_meet_in_blocks(spark, tmp_path, monkeypatch):
    # copies, opposite vectors and zero vectors, in blocks that are not full; held against the SQL
    import numpy as np

    from corvida.operators import pairs

    monkeypatch.setattr(pairs, "ROWS", 64)
    monkeypatch.setattr(pairs, "QUESTIONS", 2)
    v = np.random.default_rng(5).normal(size=(650, 8)).astype("float32")
    v[50:90], v[90:95], v[300], v[301] = v[0], -v[0], 0, 0
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [[i, x.tolist()] for i, x in enumerate(v)])
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    for name in ("q11_vector_topk_batch", "q36_cosine_gate"):
        df = QUERIES[name](spark, str(tmp_path))
        assert "zip_with" not in df._jdf.queryExecution().toString()  # no work per pair in the plan: blocks meet
        got, want = df.toPandas(), con.sql(SQL[name]).df()
        columns = sorted(want.columns)
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b)


def test_vectors_of_other_lengths(spark):
    from corvida.operators import legacy, pairs

    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [1.0]), ("d", 3, None), ("e", 4, [0.0, 0.0]), ("f", 5, [1.0, None])], "id string, ord long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0], 3), (8, [2.0], 3), (9, None, 3)], "query_id long, query_vector array<float>, k int")
    best = lambda df, rank: [(r["query_id"], r["id"]) for r in df.orderBy("query_id", rank).collect()]
    assert best(search.vector_topk(rows, asked, F.col("k")), "v_rank") == best(legacy.cosine_topk(rows, asked), "rank") == [(7, "a"), (7, "b"), (7, "e"), (8, "c")]
    gates = pairs.meet(rows.drop("ord"), asked.drop("k"), pairs.gates(0.65), "query_id long, id string, gate double, passes boolean").collect()
    assert len(gates) == 18 and {(r["query_id"], r["id"]) for r in gates if r["passes"]} == {(7, "a"), (7, "b"), (7, "e"), (8, "c")}


def test_context(spark):
    chunks = spark.createDataFrame([("f", i, f"f{i}") for i in (0, 1, 3, 4, 5, 6)] + [("g", i, f"g{i}") for i in (1, 2, 3)], "filename string, chunk_index int, text string")
    hits = spark.createDataFrame([(0, "f", 5, 1), (0, "g", 2, 2)], "query_id int, filename string, chunk_index int, rank int")
    assert [r["text"] for r in context.build_context(hits, chunks, 4).orderBy("pos").collect()] == ["f4", "f5", "f6", "g1"]
    one_hit = spark.createDataFrame([(0, "f", 1, 1)], hits.schema)
    assert sorted(r["chunk_index"] for r in context.neighbours(one_hit, chunks).collect()) == [0, 1]
    cap = lambda *n: [r["pos"] for r in context.capped(spark.createDataFrame([(0, i, "x" * k) for i, k in enumerate(n)], "query_id int, pos int, text string")).orderBy("pos").collect()]
    assert cap(7000, 4000, 2000) == [0, 1] and cap(20000, 10) == [0]


def test_split():
    text = " ".join(f"w{i}" + ("." if i % 7 == 0 else "") for i in range(500))
    chunks = chunking.split_text(text, 50, 10)
    assert all(len(c.split()) <= 50 for c in chunks)
    assert set(" ".join(chunks).split()) == set(text.split()) and chunking.split_text("", 50, 10) == []


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Default Extension="jpeg" ContentType="image/jpeg"/></Types>')
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="x"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p><w:r><a:blip r:embed="r1"/></w:r></w:p><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/p.jpeg"/></Relationships>')
        z.writestr("word/media/p.jpeg", b"bytes")
    return out.getvalue()


def embedder():
    def embed(texts):  # local, so that it travels to the executors by value
        return [None if "reject" in t else [float(len(t)), 1.0] for t in texts]

    return embed


def test_ingest_and_store(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.txt").write_text("One sentence here. Another one follows. " * 200)
    (files / "b.docx").write_bytes(docx())
    (files / "c.docx").write_bytes(b"broken")
    (files / "d.xyz").write_text("no")
    parsed = documents.read_documents(spark, str(files)).cache()
    rows = {r["filename"]: r for r in parsed.collect()}
    assert set(rows) == {"a.txt", "b.docx", "c.docx"} and rows["c.docx"]["error"] and rows["b.docx"]["text"] == "First\n[Рисунок 1: img_001.jpg]\nLast"
    kept = store.ChunkStore(spark, str(tmp_path / "store"))
    assert kept.read().count() == 0
    state = ingest.ingest_document(kept, parsed, "a.txt", embedder())
    assert state["status"] == "ready" and state["chunks_done"] == kept.read().count() > 0
    again = ingest.ingest_document(kept, parsed, "a.txt", embedder())
    assert again["chunks_done"] == state["chunks_done"] == kept.read().count() and kept.faults().count() == 0
    assert ingest.ingest_document(kept, parsed, "c.docx", embedder())["status"] == "error" and kept.read().count() == state["chunks_done"]
    ingest.ingest_document(kept, parsed, "b.docx", embedder())
    assert kept.delete("a.txt") == state["chunks_done"] and kept.delete("a.txt") == 0
    assert {r["filename"] for r in kept.read().select("filename").distinct().collect()} == {"b.docx"}


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("Some text. More text.")
    kept = store.ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), kept, embedder(), str(tmp_path / "cp")).awaitTermination()
        assert [r["id"] for r in kept.read().collect()] == ["x.txt_0"]


def test_streamed_files_follow_each_other(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kept = store.ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    calls = spark.sparkContext.accumulator(0)
    plain = embedder()

    def embed(texts):
        calls.add(len(texts))
        return plain(texts)

    for name in ("a.txt", "b.txt", "c.txt"):
        (tmp_path / "in" / name).write_text("One sentence here. Another one follows. " * 300)
        ingest_stream(spark, str(tmp_path / "in"), kept, embed, str(tmp_path / "cp")).awaitTermination()
    rows = kept.read().collect()
    assert len({r["ord"] for r in rows}) == len(rows) == calls.value > 3 and {r["filename"] for r in rows} == {"a.txt", "b.txt", "c.txt"}


def test_unreadable_store_is_put_aside(spark, tmp_path):
    kept = store.ChunkStore(spark, str(tmp_path / "store"))
    assert kept.recover() is None
    rows = spark.sql("select 'x_0' id, 'x' filename, 0 chunk_index, 't' text, array(1f) embedding, cast(null as string) section, 0L ord")
    kept.put(["x"], rows)
    kept.put(["y"], rows.withColumn("filename", F.lit("y")))
    assert kept.recover() is None and kept.read().count() == 2
    named = kept._manifest()["buckets"].values()
    for name in set(named) - set(kept._manifest(kept.versions()[0])["buckets"].values()):
        for f in (tmp_path / "store" / "data" / name).glob("part-*"):
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert ".json.bak." in kept.recover()
    assert [r["filename"] for r in store.ChunkStore(spark, str(tmp_path / "store")).read().collect()] == ["x"]


def test_docx_types_and_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "t.docx", "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Default Extension="bin" ContentType="image/gif"/><Default Extension="tiff" ContentType="image/tiff"/><Override PartName="/pics/a.dat" ContentType="image/jpeg"/></Types>')
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="x"><w:body><w:p><a:blip r:embed="r1"/></w:p><w:p><a:blip r:embed="r2"/></w:p><w:p><a:blip r:embed="r3"/></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="/pics/a.dat"/><Relationship Id="r2" Target="media/b.bin"/><Relationship Id="r3" Target="../word/media/c.tiff"/></Relationships>')
        for name in ("pics/a.dat", "word/media/b.bin", "word/media/c.tiff"):
            z.writestr(name, name)
    with zipfile.ZipFile(tmp_path / "in" / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"/>')
    parsed = documents.read_documents(spark, str(tmp_path / "in"))
    assert [r["error"] is not None for r in parsed.orderBy("filename").collect()] == [True, False]
    assert [tuple(r) for r in documents.write_images(parsed, str(tmp_path / "out")).collect()] == [("t.docx", 3)]
    assert {f.name: f.read_text() for f in (tmp_path / "out" / "t_images").iterdir()} == {"img_001.jpg": "pics/a.dat", "img_002.gif": "word/media/b.bin", "img_003.png": "word/media/c.tiff"}


SETTINGS = {"base_url": "http://h/", "llm_model": "m", "embed_model": "e", "api_mode": " AUTO ", "storage_dir": "s", "top_k": "4", "chunk_size": 1, "chunk_overlap": 0, "sim_threshold": "0.5", "api_key": "", "auth_path": "", "auth_user": "", "auth_password": ""}


def test_settings(tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps(SETTINGS))
    got = service.Settings.read(str(tmp_path / "c.json"))
    assert (got.top_k, got.sim_threshold, got.lexical_weight, got.api_mode) == (4, 0.5, 0.5, "auto")
    with pytest.raises(KeyError, match="api_key"):
        service.Settings.of({k: v for k, v in SETTINGS.items() if k != "api_key"})
    with pytest.raises(KeyError):
        service.Settings.read(str(tmp_path / "none.json"))
    urls = lambda **x: [service.Settings.of(SETTINGS | x).url(t) for t in ("chat", "embed")]
    assert urls() == ["http://h/api/chat", "http://h/api/embed"]
    assert urls(base_url="http://h/v1") == ["http://h/v1/chat/completions", "http://h/v1/embeddings"]
    assert urls(api_mode="openai") == ["http://h/api/v1/chat/completions", "http://h/api/v1/embeddings"]
    assert urls(api_key="k", base_url="http://h/api") == urls(base_url="http://h/api/chat/completions/") == ["http://h/api/chat/completions", "http://h/ollama/api/embed"]


def test_embedding_replies():
    assert ingest.vectors_of({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1], [2]]
    assert ingest.vectors_of({"embeddings": [[1], [2]]}, 2) == [[1], [2]] and ingest.vectors_of({"embedding": [1]}, 1) == [[1]]
    with pytest.raises(ValueError):
        ingest.vectors_of({"embeddings": [[1]]}, 2)


def test_ask_and_documents(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    text = "Open the payment form first [Рисунок 1: img_001.png] then press the approve button [Рисунок 2: img_002.png]. "
    (folder / "payment_process.txt").write_text(text * 3)
    (folder / "other.txt").write_text("Nothing about that subject. " * 30)
    (folder / "payment_process_images").mkdir()
    kept, log = store.ChunkStore(spark, str(tmp_path / "store")), ingest.StatusLog(spark, str(tmp_path / "log"))

    def embed(texts):
        return [None if "fail" in t else [float("payment" in t), 1.0] for t in texts]

    def chat(system, user):
        if "quiet" in user:
            return ""
        return "<think>hm</think>1. open the payment form\n2. press the approve button [CHUNK 0]"

    with pytest.raises(service.RequestError) as e:
        service.ask(kept.read(), spark.sql("select 1 query_id, 'q' question"), embed, chat)
    assert e.value.status == 503
    assert service.reindex_all(kept, log, str(folder), embed) == (["other.txt", "payment_process.txt"], []) and not (folder / "payment_process_images").exists()
    states = {r["filename"]: r for r in store.document_status(log.read(), kept.read()).collect()}
    assert states["other.txt"]["status"] == "ready" and states["other.txt"]["progress_pct"] == 100.0 and states["other.txt"]["finished_at"]
    asked = spark.createDataFrame([(1, "how does the payment process go", None), (2, "payment", 0), (3, "fail", 2), (4, "payment quiet", 1)], "query_id long, question string, top_k int")
    got = {r["query_id"]: r for r in service.ask(kept.read(), asked, embed, chat, "http://h/").collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == [200, 400, 502, 502] and "empty answer" in got[4]["error"]
    one_ = got[1]
    assert one_["answer"] == "1. open the payment form\nhttp://h/files/payment_process_images/img_001.png\n2. press the approve button\nhttp://h/files/payment_process_images/img_002.png"
    assert one_["sources"][0] == "payment_process.txt" and one_["download_urls"]["other.txt"] == "http://h/files/other.txt" and one_["chunks_used"] >= 1 and "<ol>" in one_["answer_html"]
    strict = service.ask(kept.read(), asked.where("query_id = 1"), embed, chat, threshold=1.1).first()
    assert strict["answer"] == T.NOT_FOUND and strict["sources"] == [] and strict["chunks_used"] == 0
    log.add("other.txt", "indexing")
    for call in (lambda: service.delete(kept, log, str(folder), "other.txt"), lambda: service.reindex(kept, log, str(folder), embed, "other.txt")):
        with pytest.raises(service.RequestError) as e:
            call()
        assert e.value.status == 409
    assert service.delete(kept, log, str(folder), "payment_process.txt") > 0 and not (folder / "payment_process.txt").exists()
    with pytest.raises(service.RequestError) as e:
        service.delete(kept, log, str(folder), "payment_process.txt")
    assert e.value.status == 404 and {r["filename"] for r in log.current().collect()} == {"other.txt"}
