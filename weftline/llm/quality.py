"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` lists (name, metric, lower bound, upper bound, least words): a document
fails a rule if the metric lies outside the bounds and the document has at least
that many words.  ``judgement`` compiles the table into one expression over the text:
words and lines are split once, every metric is a built-in function of those two arrays
or of the text, and the failed rules are an array.  Nothing leaves the JVM, there is no
user function, no generator and no shuffle, so the cost is one scan whatever the size.

No rule depends on length but for the least words: the number of distinct words is held
against the square root of that of all words, which natural text exceeds many times over
at any length, as its vocabulary grows faster.

Defined results: null or word-less text has zero words and fails ``min_words``;
ratios over nothing are 0; very long texts are measured whole, and none is too long;
repeated rows are judged alike, each by itself; other columns, whatever their names, pass
through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import flattened, picked

#: Function words of the corpus' languages (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to in is that it for on with as are be by this was at from or an not have "
    "le la les de des du et un une que est en au aux pas pour dans qui sur ce il "
    "der die das und den von zu mit dem ist ein eine im auf nicht für sich "
    "el los las del y por con una su para lo como no"
).split()

#: (rule, metric, lower bound, upper bound, words a document must have for the rule to apply)
RULES = (
    ("min_words", "n_words", 1, None, 0),
    ("mean_word_length", "mean_word_chars", 1.5, 15.0, 20),
    ("symbol_ratio", "symbol_ratio", None, 0.05, 5),
    ("stop_word_ratio", "stop_word_ratio", 0.01, 0.9, 100),
    ("distinct_words", "distinct_root_ratio", 1.0, None, 50),
    ("repeated_word_ratio", "repeated_word_ratio", None, 0.2, 20),
    ("duplicate_line_ratio", "duplicate_line_ratio", None, 0.4, 20),
    ("bullet_line_ratio", "bullet_line_ratio", None, 0.9, 20),
    ("ellipsis_line_ratio", "ellipsis_line_ratio", None, 0.3, 20),
)

_SYMBOLS = r"#$%&*|!~^_=<>{}\\@+"
_MARKS = ".,;:!?"
_BULLETS = ("-", "*", "•")
_DOTS = ("...", "…")
METRICS = ("n_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "distinct_root_ratio", "repeated_word_ratio", "duplicate_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def _parts(text: Column) -> Column:
    """The text with its words (runs without blanks, tabs and line ends) and lines."""
    plain = text
    for c in "\n\t\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.struct(text.alias("t"), F.array_remove(F.split(plain, " "), "").alias("words"), F.split(text, "\n").alias("lines"))


def _any(c: Column, tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t(c)
    return out


def _counts(p: Column) -> Column:
    t, words, lines = p["t"], p["words"], p["lines"]
    stops = F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(_MARKS)).isin(*STOP_WORDS))
    again = F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))
    bullets = F.filter(lines, lambda x: _any(F.ltrim(x, F.lit(" \t")), [lambda c, b=b: c.startswith(b) for b in _BULLETS]))
    dots = F.filter(lines, lambda x: _any(F.rtrim(x, F.lit(" \t")), [lambda c, b=b: c.endswith(b) for b in _DOTS]))
    return F.struct(
        F.size(words).alias("n"),
        F.length(F.array_join(words, "")).alias("letters"),
        F.length(t).alias("chars"),
        F.regexp_count(t, F.lit(f"[{_SYMBOLS}]")).alias("symbols"),
        F.size(stops).alias("stops"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.size(again).alias("again"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("distinct_lines"),
        F.size(bullets).alias("bullets"),
        F.size(dots).alias("dots"),
    )


def _metrics(q: Column) -> Column:
    n = q["n"].cast("bigint")
    return F.struct(
        n.alias("n_words"),
        _ratio(q["letters"], n).alias("mean_word_chars"),
        _ratio(q["symbols"], q["chars"]).alias("symbol_ratio"),
        _ratio(q["stops"], n).alias("stop_word_ratio"),
        _ratio(q["distinct"], F.sqrt(n)).alias("distinct_root_ratio"),
        _ratio(q["again"], n).alias("repeated_word_ratio"),
        _ratio(q["lines"] - q["distinct_lines"], q["lines"]).alias("duplicate_line_ratio"),
        _ratio(q["bullets"], q["lines"]).alias("bullet_line_ratio"),
        _ratio(q["dots"], q["lines"]).alias("ellipsis_line_ratio"),
    )


def compiled(metric: Column, rules=RULES) -> Column:
    """The threshold table as one expression: the array of failed rules."""
    failed = []
    for name, key, low, high, least in rules:
        outside = F.lit(False)
        if low is not None:
            outside = outside | (metric[key] < F.lit(low))
        if high is not None:
            outside = outside | (metric[key] > F.lit(high))
        failed.append(F.when(outside & (metric["n_words"] >= least), F.lit(name)))
    return F.array_compact(F.array(*failed))


def judgement(text: Column, rules=RULES) -> Column:
    """A struct of the metrics and ``failed``, the array of failed rules."""
    whole = lambda m: F.struct(*[m[k].alias(k) for k in METRICS], compiled(m, rules).alias("failed"))
    return _let(_parts(F.coalesce(text, F.lit(""))), lambda p: _let(_counts(p), lambda q: _let(_metrics(q), whole)))


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each document: doc_id, its metrics, the failed rules, kept or not."""
    judged = picked(docs, "doc_id", "text").select("doc_id", judgement(F.col("text"), rules).alias("q"))
    return judged.select("doc_id", *[f"q.{k}" for k in METRICS], F.array_join("q.failed", ",").alias("failed"), (F.size("q.failed") == 0).alias("kept"))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that fail no rule, with their own columns only."""
    text = F.col(f"c{docs.columns.index('text')}")
    return flattened(docs).where(F.size(judgement(text, rules)["failed"]) == 0).toDF(*docs.columns)


def oracle(table: str = "documents") -> str:
    """The report as DuckDB SQL."""
    failed = []
    for name, key, low, high, least in RULES:
        outside = " OR ".join([*([f"{key} < {low}"] if low is not None else []), *([f"{key} > {high}"] if high is not None else [])])
        failed.append(f"CASE WHEN ({outside}) AND n_words >= {least} THEN '{name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""WITH parts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \n\t\r]+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
measured AS (SELECT doc_id, len(words)::BIGINT AS n_words,
  CASE WHEN len(words) > 0 THEN round(length(array_to_string(words, '')) / len(words)::DOUBLE, 6) ELSE 0.0 END AS mean_word_chars,
  CASE WHEN length(t) > 0 THEN round(len(regexp_extract_all(t, '[{_SYMBOLS}]')) / length(t)::DOUBLE, 6) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda w: regexp_replace(lower(w), '[{_MARKS}]+$', '') IN ({stops}))) / len(words)::DOUBLE, 6) ELSE 0.0 END AS stop_word_ratio,
  CASE WHEN len(words) > 0 THEN round(len(list_distinct(words)) / sqrt(len(words)), 6) ELSE 0.0 END AS distinct_root_ratio,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(list_zip(words[2:], words[:-2]), lambda x: x[1] = x[2])) / len(words)::DOUBLE, 6) ELSE 0.0 END AS repeated_word_ratio,
  round((len(lines) - len(list_distinct(lines))) / len(lines)::DOUBLE, 6) AS duplicate_line_ratio,
  round(len(regexp_extract_all(t, '(^|\n)[ \t]*[-*•]')) / len(lines)::DOUBLE, 6) AS bullet_line_ratio,
  round(len(regexp_extract_all(t, '(\.\.\.|…)[ \t]*(\n|$)')) / len(lines)::DOUBLE, 6) AS ellipsis_line_ratio
  FROM parts),
judged AS (SELECT *, concat_ws(',', {", ".join(failed)}) AS failed FROM measured)
SELECT doc_id, {", ".join(METRICS)}, failed, failed = '' AS kept FROM judged"""
