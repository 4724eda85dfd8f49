"""Column functions that take questions apart: options, answers and solutions in a text, and what a draft still lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.latex import MEDIA, has_media, saved_option
from paperloom.functions.text import SPACE, _col, has_text, once, trimmed

# Option labels, section heads, figure words and messages of services that stay out of order.
LETTERS = ["A", "B", "C", "D"]
CHOICE_TYPES = ["单选题", "多选题"]
SPLIT_LABEL = f"(^|[{SPACE}（(])(([A-D])[{SPACE}]*(?:[.．、:：)）]|(?=[{SPACE}]*[$\\\\\\u4e00-\\u9fa5A-Za-z0-9（(])))"
BLOCK_LABEL = f"(^|\\n|[{SPACE}]+)(([A-DＡ-Ｄ])[{SPACE}]*[.．、:：)）][{SPACE}]*)"
SOLUTION_HEAD = f"【(?:解析|详解|解答|分析)】|(?:解析|详解|解答|分析|解)[{SPACE}]*[:：]"
ANSWER_HEAD = f"(?:【答案】|参考答案[:：]|答案[:：])[{SPACE}]*"
BLOCK_ANSWER = f"(?:答案|参考答案|答)[:：][{SPACE}]*"
BLOCK_SOLUTION = f"(?:解析|详解|解答|说明)[:：][{SPACE}]*"
SECTION_HEAD = f"(?:^|\\n)[{SPACE}]*(?:参考)?(?:解析|详解|解答过程|解答|分析)[{SPACE}]*[:：]?[{SPACE}]*"
FIGURE_WORDS = "图|折扇|圆弧|扇形"
SERVICE_DOWN = [
    "qwen 视觉识别接口不可用", "dashscope 鉴权失败", "余额不足", "额度耗尽", "api key 无效", "权限不足", "限流", "http 429", "quota", "balance", "billing", "unauthorized", "forbidden", "rate limit",
]
#: Non-characters before a label, after it, and after its marker.
_START, _NAMED, _MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def _marked(text: Column, pattern: str) -> Column:
    """array<struct<label,raw,content>> of the text's pieces from one label to the next; the first has no label."""
    pieces = F.split(F.regexp_replace(text, pattern, f"$1{_START}$3{_NAMED}$2{_MARK}"), _START)

    def piece(named: Column) -> Column:
        label = F.when(F.size(named) > 1, F.translate(F.get(named, F.lit(0)), "ＡＢＣＤ", "ABCD"))
        return once(F.split(F.element_at(named, -1), _MARK), lambda rest: F.struct(label.alias("label"), F.array_join(rest, "").alias("raw"), F.element_at(rest, -1).alias("content")))

    return F.transform(pieces, lambda x: once(F.split(x, _NAMED), piece))


def _four(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get(values, i), F.lit("")))


def split_options(text: str | Column) -> Column:
    """struct(stem, options): a text cut at its first A and the B, C and D that follow it in order; null if there are fewer than two.

    Labels out of order stay in the option they stand in. The stem must not be empty, and two options must say more than a label.
    """
    folded = F.translate(F.coalesce(_col(text), F.lit("")), "ＡＢＣＤ\r", "ABCD\n")
    letters = F.array(*map(F.lit, LETTERS))

    def take(found: Column, p: Column) -> Column:
        wanted = F.get(letters, F.size(found)) == p["label"]
        longer = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.concat(F.element_at(found, -1), p["raw"])))
        return F.when(F.coalesce(wanted, F.lit(False)), F.concat(found, F.array(p["content"]))).otherwise(longer)

    bare = lambda v: trimmed(F.regexp_replace(v, f"(?i)^[{SPACE}]*[A-D][{SPACE}]*[.．、:：)）]?[{SPACE}]*", ""))
    says = lambda v: ~F.regexp_replace(v, f"[.{SPACE}、，。:：；;()（）]", "").rlike("(?i)^[A-D]?$")

    # each step is computed once: within array functions Spark would repeat it wherever it is named
    def cut(pieces: Column) -> Column:
        def split(first: Column) -> Column:
            stem = trimmed(F.array_join(F.transform(F.slice(pieces, F.lit(1), F.greatest(first - 1, F.lit(0))), lambda p: p["raw"]), ""))
            after = F.slice(pieces, first + 1, F.greatest(F.size(pieces) - first, F.lit(0)))
            values = F.transform(F.aggregate(after, F.array(F.get(pieces, first - 1)["content"]), take), bare)
            fit = lambda x: F.when((F.size(x["v"]) >= 2) & (x["stem"] != "") & (F.size(F.filter(x["v"], says)) >= 2), F.struct(x["stem"].alias("stem"), _four(x["v"]).alias("options")))
            return F.when(first > 0, once(F.struct(stem.alias("stem"), values.alias("v")), fit))

        return once(F.array_position(F.transform(pieces, lambda p: F.coalesce(p["label"], F.lit(""))), "A").cast("int"), split)

    return once(_marked(F.regexp_replace(folded, f"([A-D])[{SPACE}]*[．.、:：][{SPACE}]*", "$1. "), SPLIT_LABEL), cut)


def option_says(value: Column) -> Column:
    """Whether an option holds an image or more than its label."""
    bare = F.regexp_replace(F.regexp_replace(value, f"(?i)^[{SPACE}]*[（(]?[{SPACE}]*[A-DＡ-Ｄ][{SPACE}]*[.．、:：)）]?[{SPACE}]*", ""), f"[.{SPACE}、，。:：；;()（）]", "")
    return has_media(value) | ~bare.rlike("(?i)^[A-D]?$")


def block_options(text: str | Column) -> Column:
    """struct(stem, options, n): a block cut at every label that a mark follows; of a repeated label the last counts. n options say something."""
    source = trimmed(text)
    pieces = _marked(source, BLOCK_LABEL)
    labelled = F.filter(pieces, lambda p: p["label"].isNotNull())
    last = lambda letter: F.try_element_at(F.filter(labelled, lambda p: p["label"] == letter), F.lit(-1))["content"]
    options = F.array(*[F.coalesce(trimmed(last(x)), F.lit("")) for x in LETTERS])
    made = F.struct(trimmed(F.get(pieces, F.lit(0))["raw"]).alias("stem"), options.alias("options"), F.size(F.filter(options, option_says)).alias("n"))
    return F.when(F.size(labelled) >= 2, made).otherwise(F.struct(source.alias("stem"), F.array(*[F.lit("")] * 4).alias("options"), F.lit(0).alias("n")))


def with_options(stem: str | Column, options: str | Column, kind: str | Column) -> Column:
    """The stem of a choice question with its options below, unless it has them already."""
    text = F.regexp_replace(F.coalesce(_col(stem), F.lit("")), f"[{SPACE}]+$", "")
    named = F.transform(_col(options), lambda o, i: F.when(has_text(o), F.concat(F.chr(i + 65), F.lit(". "), trimmed(o))))
    below = F.array_join(F.array_compact(named), "\n")
    plain = ~F.coalesce(_col(kind).isin(CHOICE_TYPES), F.lit(False)) | (F.coalesce(below, F.lit("")) == "") | split_options(text).isNotNull()
    return F.when(plain, text).when(text == "", below).otherwise(F.concat(text, F.lit("\n\n"), below))


def stored_question(stem: str | Column, kind: str | Column, fallback: str | Column) -> Column:
    """struct(stem, options, kind): options in the stem make it a choice question; else a choice question keeps the fallback's."""
    cut, choice = split_options(stem), F.coalesce(_col(kind).isin(CHOICE_TYPES), F.lit(False))
    whole = F.struct(F.coalesce(_col(stem), F.lit("")).alias("stem"), F.when(choice, _col(fallback)).otherwise(F.array(*[F.lit("")] * 4)).alias("options"), _col(kind).alias("kind"))
    return F.when(cut.isNull(), whole).otherwise(F.struct(cut["stem"].alias("stem"), cut["options"].alias("options"), F.when(choice, _col(kind)).otherwise("单选题").alias("kind")))


def _before_after(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text before the first match (all of it, if there is none) and after it (null)."""
    marked = F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{_START}$2")
    parts = F.split(marked, _START)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def strip_answer(text: str | Column) -> Column:
    """struct(stem, answer, solution): the solution is what follows its head; the answer the first line, of 80 characters at most, after its own."""
    body, solution = _before_after(F.coalesce(_col(text), F.lit("")), SOLUTION_HEAD)
    body = F.when(solution.isNull(), body).otherwise(trimmed(body))
    # an answer's head counts only if something follows it
    stem, tail = _before_after(body, f"{ANSWER_HEAD}(?=.)")
    letters = F.regexp_extract(tail, "^[A-DＡ-Ｄ]+", 0)
    answer = F.when(letters != "", letters).otherwise(trimmed(F.get(F.split(F.substring(tail, 1, 80), "\n"), F.lit(0))))
    return F.struct(F.when(tail.isNull(), body).otherwise(trimmed(stem)).alias("stem"), F.coalesce(answer, F.lit("")).alias("answer"), F.coalesce(trimmed(solution), F.lit("")).alias("solution"))


def strip_block_answer(text: str | Column) -> Column:
    """struct(stem, answer, solution) of a block: the stem ends at the first head; an answer before the solution ends there."""
    source = trimmed(text)
    before_answer, after_answer = _before_after(source, BLOCK_ANSWER)
    before_solution, after_solution = _before_after(source, BLOCK_SOLUTION)
    first = F.when(F.length(before_answer) <= F.length(before_solution), before_answer).otherwise(before_solution)
    either = after_answer.isNotNull() | after_solution.isNotNull()
    upto, _ = _before_after(after_answer, BLOCK_SOLUTION)
    answer = F.when(after_solution.isNotNull() & (F.length(before_solution) > F.length(before_answer)), upto).otherwise(after_answer)
    return F.struct(F.when(either, trimmed(first)).otherwise(source).alias("stem"), trimmed(answer).alias("answer"), trimmed(after_solution).alias("solution"))


def answer_sections(cleaned: str | Column) -> Column:
    """struct(answer_part, solution_part) of a cleaned text: cut at its first solution head; without one both are the text."""
    blanks = F.regexp_replace(F.translate(F.coalesce(_col(cleaned), F.lit("")), "\r\u3000", "\n "), "[ \\t]+", " ")
    source = trimmed(F.regexp_replace(blanks, "\\n{3,}", "\n\n"))
    before, after = _before_after(source, SECTION_HEAD)
    return F.struct(F.when(after.isNull(), source).otherwise(trimmed(before)).alias("answer_part"), F.when(after.isNull(), source).otherwise(trimmed(after)).alias("solution_part"))


def figure_cue(stem: str | Column, options: str | Column) -> Column:
    """Whether a question speaks of a figure."""
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(_col(stem), F.lit("")).rlike(FIGURE_WORDS) | F.exists(F.coalesce(_col(options), none), lambda o: F.coalesce(o, F.lit("")).rlike(FIGURE_WORDS))


def needs_option_repair(cleaned_options: str | Column, page_image: str | Column) -> Column:
    """Whether a draft has an image of its page and fewer than two of its first four options are left once they are saved."""
    kept = F.filter(F.transform(F.slice(_col(cleaned_options), 1, 4), saved_option), lambda o: o != "")
    return has_text(page_image) & (F.coalesce(F.size(kept), F.lit(0)) < 2)


def fatal_service_error(message: str | Column) -> Column:
    """Whether a message means that further calls of the service are of no use."""
    t = F.lower(F.coalesce(_col(message), F.lit("")))
    found = F.lit(False)
    for words in SERVICE_DOWN:
        found = found | F.contains(t, F.lit(words))
    return found


def media_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(MEDIA), F.lit(0))
