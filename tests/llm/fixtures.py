"""A table of hard cases: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size long, term string, target double, words string, row string"

_LONG = " ".join(f"w{i % 997}x" for i in range(60_000))
_PASSAGE = " ".join(f"p{i}" for i in range(60))
_A = " ".join(f"a{i}." for i in range(80))
TEXTS = [
    (1, _A, "en", "s1"),
    (1, _A, "en", "s1"),  # repeated row
    (2, _A, "en", "s2"),
    (3, None, "en", "s1"),
    (4, "", None, None),
    (5, " \n\t ", "fr", ""),
    (6, _LONG, "en", "s1"),
    (7, f"left {_PASSAGE} right one two", "fr", "s3"),
    (8, f"{_PASSAGE} other end here", "fr", None),
    (9, "a " * 300, "de", "s2"),
    (None, "one two three four five six seven", None, "s3"),
    (None, "one two three four five six seven", None, "s3"),
    (10, "<|endoftext|> ▁▁ a  b \n\n c<s> é İstanbul Kelvin ñandú 日本語 \x00 end ", "es", "s2"),
    (11, "CC BY x cc  by. General Public License; all RIGHTS-reserved", "en", "s2"),
    (12, " ".join(f"a{i}." for i in range(78)) + " changed words", "en", "s4"),
    (13, "x\ny\nx\n\n y\nx " + "q q q q # $ " * 30, "en", "s4"),
]


def hard_cases(spark):
    rows = [(d, t, lang, s, None if t is None else len(t), 5, 6, "t", 0.5, "w", "r") for d, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
