"""Secret scans: pattern candidates, with false positives removed by a random forest.

Candidates are what the patterns of ``KINDS`` match. Their features are length, transitions between character classes,
character shares, how much common words cover (the dictionary), path marks, and the words next to them. The forest is
trained on labelled findings (value, text before, text after, label) and then written out as SQL expressions, whose votes are the probability of a
secret. Without labelled findings of the caller's own, ``labelled_findings`` makes ``FINDINGS`` of them from rules
(random keys, and look-alikes: digests, UUIDs, paths, long words, counters), a bounded set by parameter.

Native: DataFrame, SQL and Spark ML only. Plain searches first tell which patterns a text can have at all; most have none, and
are done. Scale: the scan has no shuffle; candidates, features and votes are
array expressions of the row itself, so neither a hot source nor a file full of keys moves data. Only the forest
(``TREES`` trees of depth ``DEPTH``) reaches the driver.

Defined cases. Null and empty texts have no findings. Repeated rows and null ids are scanned each. An empty table gives an empty
result. Other columns are kept by ``redacted`` and not read by ``find_secrets``.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import as_rows, of_rows

FINDINGS, TREES, DEPTH, SEED = 4000, 15, 6, 11

_NAMES = r"(?i:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer)"
#: Where an assigned value begins. The first looks behind are short, since few places pass them.
_ASSIGNED = r"(?<=[\x22'`:=>\s])(?<=[:=>]\s{0,8}[\x22'`]?)(?<=" + _NAMES + r"[\x22'\w-]{0,12}\s{0,8}(?:={1,3}|:=?|=>)\s{0,8}[\x22'`]?)"
#: Kinds that stand out by what is before them.
BY_PLACE = ("in_url", "quoted", "assigned", "generic")

#: Candidate patterns by kind; a value assigned to a secret's name or in a URL may have any length and any characters.
KINDS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
    "in_url": r"(?<=:)(?<=://[^\s:/@]{0,255}:)[^\s/@\x22'`]+(?=@)",
    "quoted": _ASSIGNED + r"(?<=\x22)[^\x22\n]+(?=\x22)|" + _ASSIGNED + r"(?<=')[^'\n]+(?=')",
    "assigned": _ASSIGNED + r"(?<![\x22'`])[^\s\x22'`,;=:(){}<>\[\]][^\s\x22'`,;(){}<>\[\]]*",
    "generic": r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{16,}={0,2}",
}
#: Fragments that words are made of.
COMMON = "able about access action after again and are bench before check class client code common config connect content count create data date default develop digest doc east edit email end error event example file filter for from function group handle have head home host html image index info ing input instance item key language last level library license line link list local main make manage message method model module name network new next node not number object open option order output package page param part path person place point port process product project property public query read record request response result return room run sample script search section server service session setting source state string style system table template test text that the this time tion title tool type under update user value version view water web where with word work world write".split()
BEFORE = rf"(?i)(?:{_NAMES}[\x22'\w-]{{0,12}}\s*(?:={{1,3}}|:=?|=>|is)?\s*[\x22'`]?|://[^\s:/@]*:)$"
HARMLESS = r"(?i)(?:example|sample|dummy|commit|revision|sha-?\d*|md5|digest|checksum|hash|uuid|guid|etag|version|path|file|url|src|href)[\x22'\w-]{0,12}\s*[:=]?\s*[\x22'`]?$"


_CANDIDATE = "|".join(KINDS.values())
_UNNAMED = "|".join(x for k, x in KINDS.items() if k not in ("quoted", "assigned"))
_WORDS = "|".join(sorted(COMMON, key=lambda w: (-len(w), w)))

#: What a text has, in lower case, if it names a secret.
NAME_PARTS = ("token", "secret", "passw", "passphrase", "pwd", "key", "credential", "auth", "bearer")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, evaluated once. A column would be put in wherever it is named, even once a candidate."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: SQL over ``t``, the text: whether an assigned value can be in it, and whether a candidate of another kind can.
_HAS_NAMED = "(contains(t, ':') or contains(t, '=')) and (" + _let("lower(t)", "l", " or ".join(f"contains(l, '{x}')" for x in NAME_PARTS)) + f") and t rlike r\"{_NAMES}[\\x22'\\w-]{{0,12}}\\s{{0,8}}[:=]\""
_HAS_OTHER = "t rlike '(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{16}' or (contains(t, '://') and contains(t, '@')) or contains(t, '-----BEGIN') or contains(t, 'xox')"


def _share(pattern: str) -> str:
    """SQL: the share of the candidate's characters that are left when the pattern is taken out."""
    return f"double(length(regexp_replace(«v», r\"{pattern}\", ''))) / length(«v»)"


#: Feature names and SQL over ``«v»`` (the candidate), ``«b»`` (up to 40 characters before it) and ``«a»`` (up to 40 after it).
FEATURES = {
    "length": "double(length(«v»))",
    "transitions": "double(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(«v», '[a-z]+', '\u0001'), '[A-Z]+', '\u0002'), '[0-9]+', '\u0003'), '[^\u0001\u0002\u0003]+', '\u0004'))) / length(«v»)",
    "digits": _share("[^0-9]"),
    "upper": _share("[^A-Z]"),
    "hex": _share("[^0-9a-fA-F]"),
    "marks": _share("[A-Za-z0-9]"),
    "distinct": "double(size(array_distinct(split(«v», '')))) / least(length(«v»), 40)",
    "vowels": _share("[^aeiouyAEIOUY]"),
    "dictionary": "1 - " + _share(f"(?i){_WORDS}"),
    "path": r"""double(regexp_count(«v», r'[/]|\.[A-Za-z]{2,4}\b')) / length(«v»)""",
    "known": "case when «v» rlike r\"^(?:" + "|".join(x for k, x in KINDS.items() if k not in BY_PLACE) + ")\" then 1D else 0D end",
    "named": f"case when «b» rlike r\"{BEFORE}\" then 1D else 0D end",
    "harmless": f"case when «b» rlike r\"{HARMLESS}\" then 1D else 0D end",
    "closed": "case when right(«b», 1) in ('\"', '\\'', '`') and left(«a», 1) = right(«b», 1) then 1D else 0D end",
    "continued": "case when «a» rlike r'^\\s[a-z]+\\s[a-z]+' then 1D else 0D end",
}


def feature_sql(v: str = "v", b: str = "b", a: str = "a") -> list[str]:
    """SQL of all features over the given expressions, named."""
    return [f"{sql.replace('«v»', v).replace('«b»', b).replace('«a»', a)} as {k}" for k, sql in FEATURES.items()]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(v, b, a, label): ``n`` findings made by rule, half of them secrets; the default training set."""
    rows = spark.range(0, n, 1, 1).select("id", F.md5(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("m"), F.sha1(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("s"), F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256).alias("x"))
    word = lambda k: f"element_at(array({', '.join(repr(w) for w in COMMON)}), cast(conv(substr(x, {k}, 4), 16, 10) as int) % {len(COMMON)} + 1)"
    mixed = "translate(base64(unhex(x)), '=', '')"
    letters = "translate(concat(m, s), '0123456789abcdef', 'aeioustrnlhdmcpg')"
    number = "cast(conv(substr(m, 1, 4), 16, 10) as int)"
    names = "element_at(array('token', 'secret', 'password', 'api_key', 'access_key', 'auth_token', 'apiKey', 'credential', 'AWS_SECRET_ACCESS_KEY', 'github_access_token', 'production_db_password'), 1 + " + number + " % 11)"
    named = f"concat('then ', {names}, element_at(array(' = \"', '=\"', ': ', ' is '), 1 + int(conv(substr(m, 5, 2), 16, 10)) % 4))"
    plain = f"concat({word(9)}, ' ', {word(13)}, ', ')"
    harmless = "concat('see ', element_at(array('commit ', 'sha1: ', 'md5 ', 'digest = ', 'uuid ', 'checksum ', 'example '), 1 + " + number + " % 7))"
    cases = (
        ("s", named, 1), ("upper(s)", f"upper({named})", 1), ("m", named, 1), (f"substr({mixed}, 1, 24 + {number} % 16)", named, 1), (f"concat('AKIA', upper(substr({letters}, 1, 10)), '234567')", plain, 1),
        (f"concat('ghp_', substr(translate({mixed}, '+/', 'aB'), 1, 36))", plain, 1), (f"concat('sk_live_', substr(translate({mixed}, '+/', 'aB'), 1, 24))", named, 1), (f"substr({mixed}, 1, 40)", plain, 1),
        (f"concat({word(1)}, substr({number}, 1, 1 + {number} % 3), '-', {word(5)})", named, 1), (f"concat(substr({mixed}, 1, 4 + {number} % 9), element_at(array('!', '&', '$', '#', '%'), 1 + {number} % 5), substr({mixed}, 20, 1 + {number} % 4))", named, 1), (f"concat(substr({letters}, 1, 1 + {number} % 6), substr({number}, 1, 2), substr(s, 1, 3))", "concat('postgres://', " + word(9) + ", ':')", 1),
        (word(1), named, 0), (f"concat({word(1)}, element_at(array('.', '_', ' '), 1 + {number} % 3), {word(5)})", named, 0), ("element_at(array('None', 'null', 'true', 'required', 'string', '********', 'str', 'optional', '...', '1', '0', '-'), 1 + " + number + " % 12)", named, 0),
        ("s", harmless, 0), ("m", f"concat({harmless}, '')", 0), ("s", plain, 0), ("concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-4', substr(m, 13, 3), '-a', substr(m, 16, 3), '-', substr(s, 1, 12))", plain, 0),
        (f"concat({word(1)}, {word(5)}, {word(17)}, {word(21)}, {word(25)})", plain, 0), (f"substr({letters}, 1, 16 + {number} % 12)", plain, 0), (f"concat('/', {word(1)}, '/', {word(5)}, '/', {word(17)}, '.py')", plain, 0),
        (f"concat({word(1)}, '_', {word(5)}, '_', {word(17)}, '_', {word(21)})", named, 0), (f"concat('www.', {word(1)}, '.', {word(5)}, '.example.com/', {word(17)})", plain, 0), (f"substr(upper({letters}), 1, 16 + {number} % 12)", f"upper({plain})", 0),
        (f"concat({word(1)}, '-', {word(5)}, '-', {word(17)}, '-2024-01-', substr({number}, 1, 2))", plain, 0), (f"repeat(substr(m, 1, 1), 16 + {number} % 24)", named, 0),
    )
    secret = [c for c in cases if c[2]]
    other = [c for c in cases if not c[2]]
    pick = lambda k: "case " + " ".join(f"when id % 2 = {1 - label} and (id div 2) % {len(group)} = {i} then {c[k]}" for label, group in ((1, secret), (0, other)) for i, c in enumerate(group)) + " end"
    after = f"element_at(array(concat(' ', {word(9)}, ' ', {word(21)}, ' '), concat(', ', {word(9)}), '\n', ''), 1 + int(conv(substr(s, 1, 2), 16, 10)) % 4)"
    found = rows.select(F.expr(pick(0)).alias("v"), F.expr(f"right({pick(1)}, 40)").alias("b"), F.expr("1 - id % 2").cast("double").alias("label"), F.expr(after).alias("after"))
    closed = "case when right(b, 1) in ('\"', '`') then right(b, 1) when b like '%://%:' then '@' else '' end"
    return found.select("v", "b", F.expr(f"left(concat({closed}, after), 40)").alias("a"), "label")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[str]:
    """SQL expressions over the features, one per tree: 1 for a secret, 0 for a false positive."""
    rows = findings.selectExpr("label", *feature_sql())
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    names = list(FEATURES)

    def sql(lines: list[str]) -> str:
        line = lines.pop(0)
        if m := re.match(r"If \(feature (\d+) <= (\S+)\)", line):
            yes = sql(lines)
            lines.pop(0)  # Else
            return f"case when f.{names[int(m[1])]} <= {float(m[2])!r}D then {yes} else {sql(lines)} end"
        return str(int(float(line.removeprefix("Predict: "))))

    parts = re.split(r"Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]
    return [sql([x.strip() for x in part.strip().split("\n")]) for part in parts]


def _judged(text: str, forest: list[str]) -> str:
    """SQL: of a text a struct of ``judged``, an array of (gap, v, p) from left to right, and ``rest``, the text after the last; null without candidates."""
    split = f"case when n then split(t, r\"{_CANDIDATE}\", -1) else split(t, r\"{_UNNAMED}\", -1) end"
    found = f"case when n then regexp_extract_all(t, r\"({_CANDIDATE})\", 1) when {_HAS_OTHER} then regexp_extract_all(t, r\"({_UNNAMED})\", 1) end"
    # what stands before a candidate and after it, across other candidates
    pieces = "transform(found, (v, i) -> struct(v as v, get(gaps, i) as gap, get(gaps, i + 1) as next, right(concat(get(gaps, i), v), 40) as tail, left(concat(v, get(gaps, i + 1)), 40) as head))"
    before = "right(concat(array_join(transform(slice(p, greatest(i - 38, 1), least(i, 39)), y -> y.tail), ''), x.gap), 40)"
    after = "left(concat(x.next, array_join(transform(slice(p, i + 2, 39), y -> y.head), '')), 40)"
    placed = f"transform(p, (x, i) -> struct(x.v as v, x.gap as gap, {before} as b, {after} as a))"
    measured = f"transform({placed}, x -> struct(x.v as v, x.gap as gap, {', '.join(feature_sql('x.v', 'x.b', 'x.a'))}))"
    votes = " + ".join(f"({tree})" for tree in forest)
    judged = f"transform({measured}, f -> struct(f.gap as gap, f.v as v, ({votes}) / {len(forest)}D as p))"
    with_gaps = _let(split, "gaps", _let(pieces, "p", f"struct({judged} as judged, element_at(gaps, -1) as rest)"))
    return _let(text, "t", _let(f"coalesce({_HAS_NAMED}, false)", "n", _let(found, "found", f"case when size(found) > 0 then {with_gaps} end")))


def _kind(v: Column) -> Column:
    out = F.lit("generic")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] not in BY_PLACE]):
        out = F.when(v.rlike(f"^(?:{pattern})"), kind).otherwise(out)
    return out


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per secret that the forest keeps: doc_id, start (characters before it), length, kind, value, probability."""
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    step = f"struct(acc.at + length(f.gap) + length(f.v) as at, case when f.p >= {threshold}D then concat(acc.out, array(struct(acc.at + length(f.gap) as start, f.v as value, f.p as p))) else acc.out end as out)"
    empty = "struct(0 as at, cast(array() as array<struct<start:int,value:string,p:double>>) as out)"
    places = _let(_judged("text", forest), "s", f"aggregate(s.judged, {empty}, (acc, f) -> {step}).out")
    found = rows.select("doc_id", F.explode(F.expr(places)).alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.length("s.value").cast("long").alias("length"), _kind(F.col("s.value")).alias("kind"), F.col("s.value").alias("value"), F.col("s.p").alias("probability"))


def redacted(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``."""
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    clean = f"concat(array_join(flatten(transform(s.judged, f -> array(f.gap, case when f.p >= {threshold}D then '{mark}' else f.v end))), ''), s.rest)"
    column = f"row.`{text_col}`"
    text = F.expr(_let(_judged(column, forest), "s", f"case when exists(s.judged, f -> f.p >= {threshold}D) then {clean} else {column} end"))
    return of_rows(as_rows(docs).select(F.col("row").withField(f"`{text_col}`", text).alias("row")), docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; secrets are given by place and digest, not in the clear."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), "probability")
