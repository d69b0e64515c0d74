"""License scans with a positional index of rare licence words.

The index has, for every notice of ``TEMPLATES``, its ``ANCHORS`` words of highest inverse document frequency (measured
over all documents) and the ``AGREEING`` such words of its key phrase, with their positions, so that a phrase that stands verbatim is always verified. A file's own highest-IDF licence words are looked up with their
positions; positions minus template positions that agree mark a place where the template may stand; a place where
enough anchors agree is verified by the template's mandatory key phrase, word by word at its relative position.

Native: DataFrame and SQL functions only. Scale: the scan of texts has no shuffle at all, since all lookups are literal
expressions of fixed size; the only aggregate is the document frequency of the templates' few hundred words,
partially aggregated, whose one row per word is all that the driver sees. Places are compared by sorting, so texts
with very many hits cost n log n.

Defined cases. Null text: empty. No phrase: null first_word and last_word, empty label strings, score 0. Repeated rows and
null ids are scanned each. With no documents the result is empty. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by label, in their usual wording, and the phrase that each must have.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": ("released under cc0 1 0 public domain dedication", "cc0 1 0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
}
ANCHORS, AGREEING = 3, 2

_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in lower case; cutting there takes a fraction of what collecting matches takes
#: Base phrases: label, the rarest word (looked up), its place in the phrase, the phrase.
BASE = (("cc-by", "cc", 0, ("cc", "by")), ("gpl", "general", 0, ("general", "public", "license")), ("reserved", "reserved", 2, ("all", "rights", "reserved")))


def words_of(text: Column) -> Column:
    """Words, A-Z in lower case. The two other letters whose lower case holds an ASCII letter are put aside first."""
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ω"))
    return F.array_remove(F.split(F.lower(text), _BETWEEN_WORDS), "")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _phrase_place(text: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


def template_index(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, anchors: int = ANCHORS) -> dict[str, list[tuple[str, int, float]]]:
    """Per template its anchors (word, position, idf), rarest first. ``docs`` has ``words``; at most one row per template word is collected."""
    vocabulary = {w for text, _ in templates.values() for w in text.split()}
    found = docs.select(F.explode(F.array_distinct(F.expr(f"filter(words, w -> w in ({_quoted(vocabulary)}))"))).alias("w")).groupBy("w").count()
    df, n = {r[0]: r[1] for r in found.collect()}, docs.count()
    idf = {w: 1 + math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}  # never 0
    out = {}
    for label, (text, phrase) in templates.items():
        words, phrase = text.split(), phrase.split()
        at = _phrase_place(words, phrase)
        first = {w: words.index(w) for w in words} | {w: at + phrase.index(w) for w in phrase}
        rarest = lambda ws, k: sorted(set(ws), key=lambda w: (-idf[w], w))[:k]
        out[label] = [(w, first[w], idf[w]) for w in rarest(rarest(words, anchors) + rarest(phrase, AGREEING), None)]
    return out


def _sequence_at(start: str, words) -> str:
    return " and ".join(f"get(words, cast({start} + {k} as int)) = '{w}'" for k, w in enumerate(words))


def _coverage(label: str, anchors: list[tuple[str, int, float]], templates: dict[str, tuple[str, str]]) -> str:
    """SQL: the best share of the anchors' idf that agrees on a verified place of one template; null if there is none.

    ``hits`` are the file's licence words of the index with their positions. Equal offsets are runs after sorting.
    """
    text, phrase = (x.split() for x in templates[label])
    at = _phrase_place(text, phrase)
    lookups = ", ".join(f"case when h.w = '{w}' then struct(h.i - {p} as o, {idf:.6f}D as v) end" for w, p, idf in anchors)
    offsets = f"array_sort(flatten(transform(hits, h -> array_compact(array({lookups})))))"
    verified = f"acc.o = x.o and acc.k + 1 >= {AGREEING} and {_sequence_at(f'x.o + {at}', phrase)}"
    step = f"struct(x.o as o, case when acc.o = x.o then acc.k + 1 else 1 end as k, case when acc.o = x.o then acc.v + x.v else x.v end as v, case when {verified} then greatest(coalesce(acc.best, 0D), acc.v + x.v) else acc.best end as best)"
    total = sum(v for _, _, v in anchors) or 1.0
    return f"transform(array(aggregate({offsets}, struct(int(null) as o, 0 as k, 0D as v, double(null) as best), (acc, x) -> {step}).best), b -> case when b is not null then least(1D, b / {total:.6f}D) end)[0]"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, anchors: int = ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    index = template_index(docs, templates, anchors)
    looked_up = {w for rows in index.values() for w, _, _ in rows} | {rare for _, rare, _, _ in BASE}
    hits = F.expr(f"array_compact(transform(words, (w, i) -> case when w in ({_quoted(looked_up)}) then struct(w as w, i as i) end))")
    found = docs.withColumn("n_words", F.size("words").cast("long")).withColumn("hits", hits)
    base = ", ".join(f"transform(filter(hits, h -> h.w = '{rare}' and {_sequence_at(f'h.i - {k}', phrase)}), h -> struct(h.i - {k} as i, '{label}' as label))" for label, rare, k, phrase in BASE)
    # most files have no hit at all, and are done without any of this
    found = found.withColumn("places", F.expr(f"case when size(hits) > 0 then concat({base}) end"))
    covered = ", ".join(f"struct('{label}' as label, {_coverage(label, rows, templates)} as share)" for label, rows in sorted(index.items()))
    found = found.withColumn("covered", F.expr(f"case when size(hits) > 1 then filter(array({covered}), c -> c.share is not null) end"))
    labels = lambda *parts: F.expr(f"array_join(array_sort(array_distinct(concat({', '.join(parts)}))), ',')")
    of_base, of_method = "coalesce(transform(places, p -> p.label), array())", "coalesce(transform(covered, c -> c.label), array())"
    return found.select(
        "doc_id",
        "n_words",
        F.expr("cast(coalesce(size(places), 0) as bigint)").alias("n_base"),
        F.expr("cast(array_min(transform(places, p -> p.i)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(places, p -> p.i)) as bigint)").alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels(of_base, of_method).alias("labels"),
        F.expr("greatest(case when size(places) > 0 then 0.5D else 0D end, coalesce(array_max(transform(covered, c -> c.share)), 0D))").alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all notices."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
