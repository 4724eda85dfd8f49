"""Column functions on answers: quality of an extracted answer, option labels, usable solutions, final choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import _BLANKS, SPACE, _col, once, trimmed

# LaTeX commands, label shapes and shapes of broken answers.
SAFE_COMMANDS = ["text", "mathrm", "mathbf", "mathit", "mathsf", "texttt", "textrm", "textsf", "textup", "textnormal", "textbf", "textit", "emph"]
UNSAFE_COMMANDS = ["frac", "sqrt", "sin", "cos", "tan", "log", "ln", "sum", "int", "lim", "overline", "underline", "vec", "bar", "hat", "dot", "angle", "triangle", "cdot", "times"]
CLEAN_LABELS = [r"[A-Fa-f]", r"[（(]\s*[A-Fa-f]\s*[)）]", r"\{\s*[A-Fa-f]\s*\}", r"(?:答案|答|选)\s*[:：]?\s*[A-Fa-f]", r"[A-Fa-f][.。]\s*"]
DIRTY_SHELLS = [
    r"^[A-Za-z]_\s*[A-Za-z0-9\\]", r"^[}_]\s*[A-Za-z]?\s*_\s*\\", r"\\frac", r"\\sqrt", r"\\boxed", r"\\angle\s*[A-Za-z]", r"\\(?:sin|cos|tan)\s*[A-Za-z{]",
    r"[A-Za-z]\s*[+\-=]\s*[A-Za-z0-9]", r"^[A-Za-z]{2,}$",
]
NO_SOLUTION = ["未填写", "无", "暂无", "none", "null"]
#: Reasons of S20 with the codes that a rejected answer gets.
REJECTION_CODES = {
    "option-value-not-matched": "rejection-option-value-not-matched",
    "ambiguous-option-value": "rejection-ambiguous-option-value",
    "options-missing": "rejection-options-missing",
    "unsafe-math-command": "rejection-unsafe-math-command",
    "invalid-option-label": "rejection-invalid-option-label",
    "invalid-structural-option-label": "rejection-invalid-structural-label",
    "not-structural-label-shell": "rejection-not-structural-shell",
    "multiple-option-value-rejected": "rejection-multi-option-value-rejected",
    "multiple-option-value-not-matched": "rejection-multi-value-not-matched",
    "ambiguous-multiple-option-value": "rejection-ambiguous-multi-value",
}
_WRAPPER = rf"^\\(?:[A-Za-z]|(?i:{'|'.join(SAFE_COMMANDS)}))\s*\{{\s*([A-Fa-f])\s*\}}\s*$"


def math_key(c: str | Column) -> Column:
    """What two option values must share to count as equal."""
    return _shell_key(unwrapped_math(c))


def _shell_key(shell: Column) -> Column:
    """`math_key` of a text without its dollars and math brackets."""
    bare = lambda t: F.when(t.contains("{") | t.contains("}"), F.regexp_replace(t, r"^\{|\}$", "")).otherwise(t)
    return F.lower(once(F.translate(shell, "−－（），。；：、" + _BLANKS, "--()"), bare))


def unwrapped_math(c: str | Column) -> Column:
    """The text without the dollars or math brackets around it."""

    def bare(t: Column) -> Column:
        out = t
        for pattern in (r"^\$+|\$+$", r"^\\\(|\\\)$", r"^\\\[|\\\]$"):
            out = F.regexp_replace(out, pattern, "")
        # most texts have none of these signs and need no pattern
        return F.when(t.contains("$") | t.contains("\\"), trimmed(out)).otherwise(t)

    return once(trimmed(c), bare)


def answer_quality(answer: str | Column, allowed: Column | None = None, max_length: int = 40) -> Column:
    """struct(status, candidate, reason) of a raw answer; candidate is a label or null.

    Status is empty, rejected, clean-label, safe-wrapper-candidate or dirty-structural-shell. A wrapped label must be one
    of `allowed`, if that has any.
    """
    t = trimmed(answer)
    label = F.upper(F.regexp_extract(t, "[A-Fa-f]", 0))
    inner = F.upper(F.regexp_extract(t, _WRAPPER, 1))
    fits = F.lit(True) if allowed is None else (F.size(allowed) <= 0) | F.array_contains(F.transform(allowed, F.upper), inner)
    compact = F.regexp_replace(F.translate(t, "−－", "--"), f"[{SPACE}]+", "")
    out = lambda status, reason, candidate=None: F.struct(F.lit(status).alias("status"), (F.lit(None).cast("string") if candidate is None else candidate).alias("candidate"), F.lit(reason).alias("reason"))
    return (
        F.when(t == "", out("empty", "empty"))
        .when(F.length(t) > max_length, out("rejected", "too-long"))
        .when(t.rlike(f"^(?:{'|'.join(CLEAN_LABELS)})$"), out("clean-label", "clean-label-pattern", label))
        .when((inner != "") & fits, out("safe-wrapper-candidate", "safe-latex-wrapper", inner))
        .when(inner != "", out("rejected", "wrapper-label-invalid"))
        .when(F.length(t) > 40, out("dirty-structural-shell", "too-long-likely-mixed-content"))
        .when(t.rlike("|".join(f"(?:{p})" for p in DIRTY_SHELLS)), out("dirty-structural-shell", "dirty-structural-shell"))
        .when(compact.rlike(r"[+\-=×÷<>]"), out("dirty-structural-shell", "math-expression"))
        .otherwise(out("rejected", "unknown-format"))
    )


def is_objective(kind: str | Column) -> Column:
    return F.coalesce(_col(kind), F.lit("")).rlike("(?i)单选|多选|choice|single|multiple")


def is_multiple(kind: str | Column) -> Column:
    return F.coalesce(_col(kind), F.lit("")).rlike("(?i)多选|multiple")


def labelled_options(options: str | Column) -> Column:
    """array<struct<label,text>> of option texts: a leading letter A-F with a mark, else the letter of the place."""
    pattern = r"(?is)^([A-F])[.、)]\s*(.*)$"

    def one(x: Column, i: Column) -> Column:
        def told(t: Column) -> Column:
            own = F.struct(F.upper(F.regexp_extract(t, pattern, 1)).alias("label"), trimmed(F.regexp_extract(t, pattern, 2)).alias("text"))
            return F.when(t.rlike(pattern), own).otherwise(F.struct(F.chr(i + 65).alias("label"), t.alias("text")))

        return once(trimmed(x), told)

    return F.coalesce(F.transform(_col(options), one), F.expr("cast(array() as array<struct<label:string,text:string>>)"))


def option_labels(answer: str | Column, kind: str | Column, options: Column) -> Column:
    """struct(ok, answer, reason): an objective answer as option labels; options has (label, text).

    Labels stay, labels in a broken LaTeX shell are taken out, and values are replaced by the label of the one option they
    equal. A multiple choice needs at least two values, each equal to one option, none twice.
    """
    first = F.struct(unwrapped_math(answer).alias("raw"), F.transform(options, lambda o: o["label"]).alias("labels"))
    return once(first, lambda x: _by_label(x, options, is_multiple(kind)))


def _out(ok: bool, reason: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(ok).alias("ok"), (F.lit("") if value is None else value).alias("answer"), F.lit(reason).alias("reason"))


def _by_label(x: Column, options: Column, multiple_choice: Column) -> Column:
    """The rules of option_labels on the bare answer and the options' labels; values are compared only where no label decides."""
    raw, labels = x["raw"], x["labels"]
    known = lambda text: F.size(F.array_except(F.regexp_extract_all(text, F.lit("[A-F]"), F.lit(0)), labels)) == 0

    def in_shell(payload: Column) -> Column:
        unsafe = F.arrays_overlap(F.transform(F.regexp_extract_all(raw, F.lit(r"\\([A-Za-z]+)"), F.lit(1)), F.lower), F.array(*map(F.lit, UNSAFE_COMMANDS)))
        return (
            F.when(unsafe, _out(False, "unsafe-math-command"))
            .when(payload.rlike("^[A-F]+$") & known(payload), _out(True, "structural-option-label-normalized", payload))
            .when(payload.rlike("^[A-F]+$"), _out(False, "invalid-structural-option-label"))
        )

    payload = F.upper(F.regexp_replace(F.regexp_replace(raw, r"\\[A-Za-z]+\s*", ""), f"[{{}}\\[\\]().,，、;；:_{SPACE}]", ""))
    # a shell has a brace or an underscore
    shell = (raw.contains("_") | raw.contains("}")) & raw.rlike(r"^\s*\}|_") & ~raw.rlike(r"[0-9+\-=^]")
    value = once(F.transform(options, lambda o: F.struct(o["label"].alias("label"), math_key(o["text"]).alias("key"))), lambda keyed: _by_value(raw, labels, keyed, multiple_choice))

    def told(plain: Column) -> Column:
        label = F.when(known(plain), _out(True, "already-option-label", plain)).otherwise(_out(False, "invalid-option-label"))
        return F.when(plain.rlike("^[A-F]+$"), label).otherwise(F.coalesce(F.when(shell, once(payload, in_shell)), F.when(F.size(labels) <= 0, _out(False, "options-missing")), value))

    return once(F.upper(F.translate(raw, _BLANKS, "")), told)


def _by_value(raw: Column, labels: Column, keyed: Column, multiple_choice: Column) -> Column:
    """The rules of option_labels on values; keyed options have (label, key)."""
    equal = lambda key: F.transform(F.filter(keyed, lambda o: o["key"] == key), lambda o: o["label"])

    def several(hits: Column) -> Column:
        bad = F.get(F.filter(F.transform(hits, F.size), lambda n: n != 1), F.lit(0))
        found = F.transform(hits, lambda h: F.get(h, F.lit(0)))
        in_order = F.array_join(F.filter(labels, lambda x: F.array_contains(found, x)), "")
        return (
            F.when((F.size(hits) >= 2) & (bad > 1), _out(False, "ambiguous-multiple-option-value"))
            .when((F.size(hits) >= 2) & (bad == 0), _out(False, "multiple-option-value-not-matched"))
            .when((F.size(hits) >= 2) & (F.size(F.array_distinct(found)) == F.size(found)), _out(True, "multiple-option-values-converted", in_order))
            .otherwise(_out(False, "multiple-option-value-rejected"))
        )

    def single(hit: Column) -> Column:
        return (
            F.when(F.size(hit) == 1, _out(True, "option-value-converted", F.get(hit, F.lit(0))))
            .when(F.size(hit) > 1, _out(False, "ambiguous-option-value"))
            .otherwise(_out(False, "option-value-not-matched"))
        )

    values = F.filter(F.transform(F.split(raw, "[，,、;；]+"), trimmed), lambda v: v != "")
    hits = F.transform(F.transform(values, math_key), equal)
    return F.when(multiple_choice, once(hits, several)).otherwise(once(once(_shell_key(raw), equal), single))


def rejection_code(reason: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REJECTION_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(_col(reason), F.lit(""))), F.lit("unknown-objective-answer-rejection"))


def usable_solution(c: str | Column) -> Column:
    """At least two characters and no word for "none"."""
    t = trimmed(c)
    return (F.length(t) >= 2) & ~F.lower(t).isin(NO_SOLUTION)


def final_choice(c: str | Column) -> Column:
    """The letters A-D a text ends up choosing: the whole text, after a phrase that says so, or its tail; else empty."""
    raw = F.upper(F.translate(trimmed(c), "ＡＢＣＤ", "ABCD"))
    compact = F.regexp_replace(F.regexp_replace(raw, r"\\[A-Z]+", ""), f"[.、，。:：；;()（）【】\\[\\]{{}}{SPACE}]", "")
    said = F.regexp_extract(raw, f"(?:答案|故选|选|应选|正确答案|为|是)[{SPACE}]*[:：]?[{SPACE}]*([A-D]{{1,4}})(?![A-Z])", 1)
    tail = F.regexp_extract(raw, f"([A-D]{{1,4}})[{SPACE}]*$", 1)
    return F.when(compact.rlike("^[A-D]{1,4}$"), compact).when(said != "", said).otherwise(tail)
