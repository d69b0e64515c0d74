"""Text functions as column expressions; all stay in the JVM. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, units and formats that results depend on.
TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
BAG_WORD = "[A-Za-zА-Яа-яЁё0-9-]{4,}"
ROOT_WORD = "[а-яёa-z]{5,}"
NUMBER_UNIT = r"\d+[\s.,]*(?:м|км|мм|%|кг|лет|этаж)"
MARKER = r"\[Рисунок (\d+): ([^\]]+)\]"
POINT = r"(?s)(?:^|\n)(\d+[.)]\s+.*?)(?=\n\d+[.)]\s+|\z)"
ITEM = r"^\d+[.)]\s+(.*)"
NOT_FOUND = "Информация в документах не найдена."
SUPPORTED = (".pdf", ".docx", ".txt", ".md", ".msg")
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"

STEM = 5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def prefix_stem(token: Column) -> Column:
    """The first five characters of tokens of at least five; null for shorter ones."""
    return F.when(F.length(token) >= STEM, F.substring(token, 1, STEM))


def bag_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({BAG_WORD})"), F.lit(1))


def word_roots(text: Column) -> Column:
    """Distinct five-letter beginnings of the words of five and more letters; ``_`` and ``-`` part words."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, "[_-]", " ")), F.lit(f"({ROOT_WORD})"), F.lit(1))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def question_roots(question: Column) -> Column:
    """Beginnings of the words over four characters, punctuation included (older profile)."""
    words = F.filter(F.split(strip(question), f"{SPACE}+"), lambda w: F.length(w) > 4)
    return F.transform(words, lambda w: F.substring(F.lower(w), 1, STEM))


def normalized(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def without_thinking(answer: Column) -> Column:
    return F.regexp_replace(answer, "(?s)<think>.*?</think>", "")


def without_chunk_marks(answer: Column) -> Column:
    return F.regexp_replace(answer, rf"{SPACE}*[(\[]{SPACE}*CHUNK{SPACE}*\d+{SPACE}*[)\]]", "")


def unquoted(answer: Column) -> Column:
    """White space, then each kind of quote in turn, then white space again, off both ends."""
    out = strip(answer)
    for quote in ('"', "'", "«", "»"):
        out = F.btrim(out, F.lit(quote))
    return F.replace(strip(out), F.lit("\\n"), F.lit("\n"))


def clean_answer(answer: Column) -> Column:
    return unquoted(strip(without_chunk_marks(strip(without_thinking(answer)))))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """Lower-case last suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(name), r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    base = basename(name)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def supported(name: Column) -> Column:
    return suffix(name).isin(*SUPPORTED)


def safe_filename(name: Column) -> Column:
    """A non-empty plain name: no folder, neither ``.`` nor ``..``."""
    return F.coalesce((name != "") & ~name.contains("/") & ~name.isin(".", ".."), F.lit(False))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_ENDS), strip), lambda x: x != "")


def is_numbered(line: Column) -> Column:
    return line.rlike(rf"^\d+[.)]{SPACE}+")


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 120) & ~F.endswith(line, F.lit(".")) & (F.size(F.split(line, f"{SPACE}+")) <= 12)


def marker_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(2))


def numbers_with_units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER_UNIT})"), F.lit(1))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def message_text(subject: Column, sender: Column, date: Column, body: Column) -> Column:
    """Header lines that are there, a blank line, the body; null (an error for the caller) when all is empty."""
    has = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    part = lambda label, c: F.when(has(c), F.concat(F.lit(label), c))
    text = F.concat_ws("\n", part("Subject: ", subject), part("From: ", sender), part("Date: ", date), F.when(has(body), F.concat(F.lit("\n"), body)))
    return F.when(text != "", text)


def anchored(answer: Column, context: Column) -> Column:
    return F.contains(context, F.substring(answer, 1, 60))


def cyrillic_only(text: Column) -> Column:
    """The older profile's filter of rewritten questions: all but hyphens, U+024F, Cyrillic letters and white space goes."""
    return F.regexp_replace(text, r"[^\-\u024f\u0400-\u04ff\s]", "")
