"""The pipeline's stages, one after the other, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_ops import WORD, jaccard_brute, pack_checks

from corvida.llm import jaccard_join, quality_rules, secret_scan


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == kept["documents"].columns
    at = {name: df.collect() for name, df in kept.items()}

    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.apply_quality_rules(kept["documents"], spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in at["quality_rules"]) == sorted(d for d, k in verdict.items() if k)

    classes = defaultdict(list)
    for d, c, _ in jaccard_brute([(r["doc_id"], r["text"]) for r in at["quality_rules"]]):
        classes[c].append(d)
    assert sorted(r["doc_id"] for r in at["near_duplicates"]) == sorted(classes)

    found = defaultdict(list)
    for r in secret_scan.find_secrets(kept["near_duplicates"]).collect():
        found[r["doc_id"]].append((r["start"], r["length"]))
    text = {r["doc_id"]: r["text"] for r in at["near_duplicates"]}
    for r in at["secret_scan"]:
        want = text[r["doc_id"]]
        for start, n in sorted(found[r["doc_id"]], reverse=True):
            want = want[:start] + "[SECRET]" + want[start + n :]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert not any(re.search(r'token = "[0-9a-f]{40}"', r["text"]) for r in at["secret_scan"])

    words = {r["doc_id"]: WORD.findall(r["text"]) for r in at["secret_scan"]}
    times = Counter()
    for r in at["source_mix"]:
        got = WORD.findall(r["text"])
        assert words[r["doc_id"]][: len(got)] == got
        times[r["doc_id"]] += len(got)
    assert all(n <= 3 * len(words[d]) for d, n in times.items())
    assert abs(sum(times.values()) - sum(map(len, words.values()))) <= 20 + len(words) / 100

    pieces = corpus_pipeline.pack(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    padding, tokens = pack_checks([(r["doc_id"], r["text"]) for r in at["source_mix"]], pieces)
    assert padding < 0.02 * tokens
    assert corpus_pipeline.run(spark, small).count() > 0


def test_near_duplicates_of_a_middling_group(spark, small, monkeypatch):
    # 500 texts that share a third of their shingles: all stay but for one real copy, and no paths are multiplied for them
    made, stored = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: made.append(name) or stored(df, name))
    rng, texts = random.Random(3), []
    for i in range(500):
        changed = set(rng.sample(range(160), 16))
        texts.append((i, " ".join(f"new{i}x{k}" if k in changed else f"b{k}" for k in range(160)), "en", "s", 1))
    texts.append((500, texts[0][1] + " end", "en", "s", 1))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()) == list(range(500))
    assert not [name for name in made if name.startswith("jaccard-level")]
