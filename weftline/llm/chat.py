r"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``<|im_start|>role\nbody<|im_end|>\n``.  The
parser is deterministic: it splits at ``<|im_end|>\n``, takes what follows
``<|im_start|>`` up to the first line end as the role and the rest as the body, and
undoes escapes (a backslash makes the next character literal).  Every turn is rendered
as it is, reparsed as a whole conversation of one turn and compared with its source.  A turn
that comes back different is escaped further, and reparsed again, until it is identical:
first a backslash before ``|`` after ``<``, before every backslash, and before a line end
in a role; then a backslash before every character that is no letter, digit or space; then
before every character.  A turn that no step makes identical is an error, and so is a
conversation that doesn't parse back to its turns.  All of it is JVM expressions and one
shuffle by conversation.  The patterns have possessive runs only, which Java's matcher
walks without recursion, so no length of a role or text exhausts a stack.

Defined results: null roles and texts are empty strings; turns are in the order of turn,
role, text, nulls first, and repeated rows are repeated turns; rows without a
conversation id form one conversation with null id; very long roles and texts are
rendered whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import picked

START, END = "<|im_start|>", "<|im_end|>"
_START_RE, _END_RE = r"<\|im_start\|>", r"<\|im_end\|>"


def _delimiters(c: Column, role: bool) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("\\\n")) if role else c


def _marks(c: Column, role: bool) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{N} ])", r"\\$1")


def _everything(c: Column, role: bool) -> Column:
    return F.regexp_replace(c, r"(?s)(.)", r"\\$1")


#: Escapes in the order in which they are tried.
STEPS = (_delimiters, _marks, _everything)


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    parts = F.filter(F.split(rendered, _END_RE + "\n"), lambda x: x != "")
    head = rf"(?s)^{_START_RE}([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*+)$"
    return F.transform(parts, lambda p: F.struct(_plain(F.regexp_extract(p, head, 1)).alias("role"), _plain(F.regexp_extract(p, head, 2)).alias("text")))


def until_identical(role: Column, text: Column, steps=STEPS) -> Column:
    """The turn, escaped by the first step that makes it come back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    out = None
    for step in steps:
        tried = render(step(role, True), step(text, False))
        same = parse(tried) == source
        out = F.when(same, tried) if out is None else out.when(same, tried)
    return out.otherwise(F.raise_error(F.lit("a turn that no escape brings back")).cast("string"))


def formatted(turns: DataFrame, steps=STEPS) -> DataFrame:
    """conv_id, n_turns, n_escaped, rendered and identical (the whole parses back to the source)."""
    t = picked(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = render(F.col("role"), F.col("text"))
    t = t.withColumn("conflict", parse(raw) != F.array(F.struct("role", "text")))
    t = t.withColumn("out", F.when(F.col("conflict"), until_identical(F.col("role"), F.col("text"), steps)).otherwise(raw))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "out", "conflict"))).alias("turns"))
    g = g.select("conv_id", "turns", F.array_join(F.transform("turns", lambda x: x["out"]), "").alias("rendered"))
    same = parse(F.col("rendered")) == F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    failed = F.raise_error(F.lit("a conversation that doesn't come back")).cast("boolean")
    return g.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.size(F.filter("turns", lambda x: x["conflict"])).cast("bigint").alias("n_escaped"), "rendered", F.when(same, True).otherwise(failed).alias("identical"))


#: In SQL the rule is direct: a turn conflicts if it holds a delimiter where the grammar would see one, or a backslash with a character after it.
#: The rendered text is reparsed there as well, by RE2.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, contains(text, '<|im_end|>' || chr(10)) OR contains(role || chr(10), '<|im_end|>' || chr(10)) OR contains(role, chr(10)) OR regexp_matches(role || chr(10) || text, '(?s)\\.')
  AS conflict FROM t),
o AS (SELECT *, CASE WHEN conflict
    THEN '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10)
    ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END AS out FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE conflict) AS n_escaped, string_agg(out, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  list([role, text] ORDER BY turn NULLS FIRST, role, text) AS source FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, n_escaped, rendered,
  list_transform(list_filter(string_split(rendered, '<|im_end|>' || chr(10)), lambda p: p <> ''), lambda p: list_transform(
    [regexp_extract(p, '(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$', 1), regexp_extract(p, '(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$', 2)],
    lambda x: regexp_replace(x, '(?s)\\(.)', '\1', 'g'))) = source AS identical
FROM g"""
