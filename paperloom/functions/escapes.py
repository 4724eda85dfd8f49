"""Backslashes of LaTeX commands inside JSON strings: detection, repair, count and commands, by token patterns; questions of the repaired text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that are listed by name when they are repaired.
COMMANDS = [
    "triangle", "frac", "sqrt", "sin", "cos", "tan", "overline", "begin", "end", "left", "right", "angle", "Delta", "theta", "alpha", "beta", "gamma", "pi",
    "circ", "cdot", "times", "le", "ge", "neq", "parallel", "perp", "vec", "overrightarrow", "ln", "log", "lim", "text", "mathrm", "mathbf", "mathbb", "cases",
]
#: A JSON string, closed or not, or what lies between strings.
_PIECES = '"(?:[^"\\\\]++|\\\\[\\s\\S]?)*+"?|[^"]+'
#: Inside a string: a code escape, a run of letters behind a backslash, a plain escape, a lone backslash, anything else.
_TOKENS = '\\\\u[0-9a-fA-F]{4}|\\\\[A-Za-z]+|\\\\[\\\\"/]|\\\\|[^\\\\]+'
_KEPT = '^\\\\(?:u[0-9a-fA-F]{4}|[bfnrt]|[\\\\"/])$'


def _strings(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda p: p.startswith('"'))


def _broken(tokens: Column, keep: str) -> Column:
    return F.filter(tokens, lambda t: t.startswith("\\") & ~t.rlike(keep))


def has_bare_backslash(text: str | Column) -> Column:
    """Whether a JSON string in the text holds a backslash that is no plain escape; one of a code escape counts as bare."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tokens = F.regexp_extract_all(F.array_join(_strings(value), ""), F.lit('\\\\[A-Za-z]+|\\\\[\\\\"/]|\\\\|[^\\\\]+'), F.lit(0))
    return F.size(_broken(tokens, '^\\\\(?:[bfnrt]|[\\\\"/])$')) > 0


def repair_backslashes(text: str | Column) -> Column:
    """struct(text, changed, repairs, commands): bare backslashes of JSON strings doubled; a backslash that ends the text stays."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    doubled = lambda t: F.when(t.startswith("\\") & ~t.rlike(_KEPT), F.concat(F.lit("\\"), t)).otherwise(t)
    tokens_of = lambda piece: F.regexp_extract_all(piece, F.lit(_TOKENS), F.lit(0))

    def repaired(piece: Column) -> Column:
        return F.when(piece.startswith('"'), F.array_join(F.transform(tokens_of(piece), doubled), "")).otherwise(piece)

    # a backslash at the very end is set aside: it escapes nothing
    open_end = value.rlike('^(?:[^"]|"(?:[^"\\\\]++|\\\\[\\s\\S])*+")*+"(?:[^"\\\\]++|\\\\[\\s\\S])*+\\\\$')
    body = F.when(open_end, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    fixed = F.concat(F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0)), repaired), ""), F.when(open_end, "\\").otherwise(""))
    broken = _broken(F.flatten(F.transform(_strings(body), tokens_of)), _KEPT)
    commands = F.array_intersect(F.transform(broken, lambda t: F.substring(t, F.lit(2), F.length(t))), F.array(*map(F.lit, COMMANDS)))
    return F.struct(fixed.alias("text"), (fixed != value).alias("changed"), F.size(broken).alias("repairs"), commands.alias("commands"))


def parse_questions(text: str | Column, path: str = "$.questions") -> Column:
    """struct(ok, method, reason, questions, repairs, commands): the questions of a JSON text, each as JSON with its keys in order.

    The root is an array of questions or an object that holds one at `path`. A text with bare backslashes is parsed after
    their repair, also where it would parse as it is: its commands would turn into control characters. Null, empty and
    broken texts fail with parse-failed, texts without a question with no-questions.
    """
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    fixed = repair_backslashes(value)

    def parsed(r: Column) -> Column:
        root = F.try_parse_json(r["text"])
        found = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), F.try_variant_get(root, path, "array<variant>"))
        questions = F.coalesce(F.transform(found, lambda q: F.to_json(q)), F.expr("cast(array() as array<string>)"))
        ok = F.size(questions) > 0
        return F.struct(
            ok.alias("ok"),
            F.when(ok & r["changed"], "json-latex-backslash-repair").when(ok, "json").alias("method"),
            F.when(root.isNull(), "parse-failed").when(~ok, "no-questions").alias("reason"),
            questions.alias("questions"), r["repairs"].alias("repairs"), r["commands"].alias("commands"),
        )

    # the array of one makes the repair a variable, which is computed once
    return F.get(F.transform(F.array(fixed), parsed), F.lit(0))
