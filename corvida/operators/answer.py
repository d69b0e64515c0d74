"""Checks of answers against their context, clean-up, illustrations and HTML, all as column expressions.

Illustrations: an answer's points meet the marker groups of its chunks by shared words; folding over the points, each takes
the best group that is still free. HTML: an answer's lines have kinds (item, picture, other); an item and what follows up to
the next other line are a list, so that every line is rendered by itself, from its kind and from the kinds around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvida.functions import text as T


def overlap_ratio(answer: Column, context: Column) -> Column:
    """Share of the answer's words of four and more characters that are substrings of the context; null without such words."""
    once = F.array(F.struct(T.bag_words(T.normalized(answer)).alias("words"), T.normalized(context).alias("context")))  # not once a word
    inside = F.transform(once, lambda x: F.when(F.size(x["words"]) > 0, F.size(F.filter(x["words"], lambda w: F.contains(x["context"], w))) / F.size(x["words"])))
    return F.element_at(inside, 1)


def is_faithful(answer: Column, context: Column, least: float = 0.3) -> Column:
    return F.coalesce(overlap_ratio(answer, context) >= least, F.lit(True))


def passes_anchor(answer: Column, context: Column) -> Column:
    """Older profile: the first 60 characters stand in the context, or max(2, 40 %) of the words do; short answers pass."""
    once = F.array(F.struct(T.normalized(answer).alias("a"), T.normalized(context).alias("c")))

    def passes(x: Column) -> Column:
        words = F.split(x["a"], " ")
        inside = F.size(F.filter(words, lambda w: F.contains(x["c"], w)))
        return (F.length(x["a"]) <= 20) | T.anchored(x["a"], x["c"]) | (inside >= F.greatest(F.lit(2.0), F.size(words) * 0.4))

    return F.element_at(F.transform(once, passes), 1)


def passes_numbers(answer: Column, context: Column) -> Column:
    """Older profile: every number with a unit stands in the context."""
    return F.forall(T.numbers_with_units(F.lower(answer)), lambda x: F.contains(F.lower(context), T.strip(x)))


def final_answer(raw: Column, context: Column) -> Column:
    clean = T.clean_answer(raw)
    return F.when((clean == T.NOT_FOUND) | is_faithful(clean, context), clean).otherwise(F.lit(T.NOT_FOUND))


_GROUP = "array<struct<words:array<string>,urls:array<string>>>"
_NO_STRINGS = "array<string>"


def _bag(text: Column) -> Column:
    return F.array_distinct(T.bag_words(F.lower(F.regexp_replace(text, T.MARKER, ""))))


def marker_groups(chunk: Column, urls: Column) -> Column:
    """Of a chunk's markers that have a URL in the map ``urls``, runs without a word between them: the words before each run, and its URLs."""
    marks = F.regexp_extract_all(chunk, F.lit(f"({T.MARKER})"), F.lit(1))
    before = F.split(chunk, T.MARKER, -1)
    known = F.filter(F.transform(marks, lambda m, i: F.struct(_bag(F.get(before, i)).alias("words"), F.element_at(urls, m).alias("url"))), lambda m: m["url"].isNotNull())

    def add(groups: Column, m: Column) -> Column:
        new = F.array(F.struct(m["words"].alias("words"), F.array(m["url"]).alias("urls")))
        last = F.element_at(groups, -1)
        longer = F.array(F.struct(last["words"].alias("words"), F.array_append(last["urls"], m["url"]).alias("urls")))
        return F.when((F.size(groups) == 0) | (F.size(m["words"]) > 0), F.concat(groups, new)).otherwise(F.concat(F.slice(groups, 1, F.size(groups) - 1), longer)).cast(_GROUP)

    return F.aggregate(known, F.array().cast(_GROUP), add)


def split_points(answer: Column) -> Column:
    """The numbered points, each with the lines up to the next; without any, the lines that are not blank."""
    points = F.regexp_extract_all(answer, F.lit(T.POINT), F.lit(1))
    return F.when(F.size(points) > 0, points).otherwise(F.filter(F.split(answer, "\n"), lambda x: T.strip(x) != ""))


def attach_images(answer: str, chunks: str, urls: str, least: int = 2) -> Column:
    """The answer's points, each followed by the URLs of the free group that shares most words with it, ``least`` or more; the first of equals.

    ``chunks``: array of texts with markers; ``urls``: map from marker to URL. Without a group or a point the answer stays as it is.
    """
    groups = F.flatten(F.transform(F.coalesce(F.col(chunks), F.array().cast(_NO_STRINGS)), lambda c: marker_groups(c, F.col(urls))))
    state = f"struct<free:{_GROUP},out:array<string>>"

    def place(acc: Column, point: Column) -> Column:
        score = F.transform(acc["free"], lambda g: F.size(F.array_intersect(_bag(point), g["words"])))
        at = F.when(F.array_max(score) >= least, F.array_position(score, F.array_max(score)).cast("int")).otherwise(0)
        rest = F.filter(acc["free"], lambda g, i: i != at - 1)
        line = F.when(at > 0, F.array_join(F.concat(F.array(point), F.get(acc["free"], at - 1)["urls"]), "\n")).otherwise(point)
        return F.struct(rest.alias("free"), F.array_append(acc["out"], line).alias("out")).cast(state)

    points = split_points(F.col(answer))
    start = F.struct(groups.alias("free"), F.array().cast(_NO_STRINGS).alias("out")).cast(state)
    placed = F.aggregate(points, start, place, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when((F.size(groups) > 0) & (F.size(points) > 0), placed).otherwise(F.col(answer))


#: The page's markup.
_STYLE = "body { font-family: Arial, sans-serif; font-size: 14px; padding: 12px; color: #333; }ol { padding-left: 20px; }li { margin-bottom: 10px; }p { margin: 8px 0; }img { display: block; }a:hover { text-decoration: underline !important; }"
_LIST_IMAGE = '<br><img src="{}" style="max-width:100%; margin-top:8px; border:1px solid #ccc; border-radius:4px;">'
_IMAGE = '<p><img src="{}" style="max-width:100%; border:1px solid #ccc; border-radius:4px;"></p>'
_SOURCES = ('<hr style="margin-top:16px; border:none; border-top:1px solid #ddd;">', '<p style="margin-top:12px; font-size:13px; color:#666;">Источники:</p>', '<ul style="padding-left:20px; font-size:13px;">')
_SOURCE = '<li><a href="{}" style="color:#1a73e8; text-decoration:none;">{}</a></li>'


def _filled(template: str, *values: Column) -> Column:
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[x for v, after in zip(values, rest) for x in (T.html_escaped(v), F.lit(after))])


def answer_html(answer: str, images: str, names: str, urls: str) -> Column:
    """The answer as a page: numbered lines make lists, lines that are image URLs (array ``images``) become images, sources (arrays ``names``, ``urls``) follow."""
    typed = F.transform(F.filter(F.transform(F.split(F.col(answer), "\n"), T.strip), lambda x: x != ""), lambda x: F.struct(x.alias("line"), F.when(F.array_contains(F.col(images), x), "g").when(x.rlike(T.ITEM), "i").otherwise("p").alias("kind")))
    shape = F.array_join(F.transform(typed, lambda x: x["kind"]), "")

    def render(x: Column, at: Column) -> Column:
        until = F.substring(shape, F.lit(1), at + 1)
        listed, was = until.rlike("i[ig]*$"), F.substring(shape, F.lit(1), at).rlike("i[ig]*$")
        ends = listed & (F.substring(shape, at + 2, F.lit(1)).isin("", "p"))
        picture = F.when(listed, _filled(_LIST_IMAGE, x["line"])).otherwise(_filled(_IMAGE, x["line"]))
        item = F.concat(F.lit("<li>"), T.html_escaped(F.regexp_extract(x["line"], T.ITEM, 1)))
        own = F.when(x["kind"] == "g", picture).when(x["kind"] == "i", item).otherwise(F.concat(F.lit("<p>"), T.html_escaped(x["line"]), F.lit("</p>")))
        none = F.array().cast(_NO_STRINGS)
        return F.concat(F.when((x["kind"] == "i") & ~was, F.array(F.lit("<ol>"))).otherwise(none), F.array(own), F.when(ends, F.array(F.lit("</li></ol>"))).otherwise(none))

    body = F.flatten(F.transform(typed, render))
    sources = F.transform(F.arrays_zip(F.col(names).alias("name"), F.col(urls).alias("url")), lambda s: _filled(_SOURCE, s["url"], s["name"]))
    listed = F.when(F.size(F.col(names)) > 0, F.concat(F.array(*map(F.lit, _SOURCES)), sources, F.array(F.lit("</ul>")))).otherwise(F.array().cast(_NO_STRINGS))
    return F.concat(F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><style>{_STYLE}</style></head><body>'), F.array_join(F.concat(body, listed), "\n"), F.lit("</body></html>"))
