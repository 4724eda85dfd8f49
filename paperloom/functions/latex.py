"""Column functions on recognized texts with formulas: segments, cleaning, tokens, placeholders, wrappers."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from paperloom.functions.text import SPACE, _col, once, trimmed

# Words, names and patterns that the results depend on.
BARE_COMMANDS = ["triangle", "angle", "vec", "frac", "sqrt", "overline", "cdot", "parallel", "perp"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'", "&#39;": "'"}
STOP_WORDS = [
    "因为", "所以", "则", "若", "已知", "求", "下列", "正确", "错误", "答案", "选项", "其中", "关于", "可以", "得到", "可得", "故选", "一个", "存在", "满足", "分别", "如下", "如图", "设为", "的是",
    "三角", "角A", "角B", "角C", "正弦", "余弦", "定理",
]
COMMON_TOKENS = ["ABC", "A", "B", "C", "D", "\\sin", "\\cos", "\\tan", "\\angle", "\\triangle", "sin", "cos", "tan", "alpha", "beta"]
DISPLAY_COMMANDS = ["frac", "dfrac", "sqrt", "angle", "sin", "cos", "tan", "log", "ln", "pi", "theta", "alpha", "beta", "gamma", "Delta", "overline", "vec", "overrightarrow"]
MEDIA = r"\[\[(?:IMAGE|FORMULA_IMAGE):[^\]]+\]\]|\\includegraphics(?:\[[^\]]*\])?\{[^}]+\}"
PLACEHOLDERS = [
    r"\[IMAGE:[^\]]+\]", r"\[公式图片(?::[^\]]+)?\]", r"\[公式图片待识别\]", r"\[公式图片识别\]", f"\\[公?式图片[{SPACE}]*待识别\\]", r"\[图片选项待转换[^\]]*\]", r"\[公式图片选项待转换[^\]]*\]",
    r"\[公式图片选项暂不支持预览[^\]]*\]",
]
UNCONVERTED = r"(?i)公式图片选项待转换|图片选项待转换|待转换[:：]?(?:wmf|emf|ole|bin)|\[object Object\]|\bundefined\b|\bnull\b"
WRAPPERS = ["description", "enumerate", "itemize"]
PAYLOAD_FIELDS = [r'"questions"\s*:\s*\[', r'"questionNumber"\s*:', r'"options"\s*:\s*\{', r'"stem"\s*:\s*"', r'"answer"\s*:\s*"', r'"analysis"\s*:\s*"', r'"correctAnswer"\s*:', r'"type"\s*:\s*"']
PAYLOAD_NOTICE = "【结构化输出解析失败，需人工复核】"
FIGURE_BREAK = "[，。；：,.]"

#: Non-characters around the number of something that is put back later.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
_SEGMENT = ArrayType(
    StructType().add("kind", "string").add("raw", "string").add("expression", "string").add("display", "boolean").add("start", "integer").add("end", "integer")
)
_DELIMITER = re.compile(r"\\*\$+|\\+[\[\]()]")


_CLOSE = {"$$": "$$", "$": "$", "\\[": "\\]", "\\(": "\\)"}


def _signs(text: str):
    """(place, sign, closes) of every sign that can open or close a formula; escaped ones are none."""
    for m in _DELIMITER.finditer(text):
        slashes = len(m.group()) - len(m.group().lstrip("\\"))
        if m.group()[-1] == "$":
            first, last = m.start() + slashes + slashes % 2, m.end() - 1
            yield from ((i, "$$", True) for i in range(first, last))
            if first <= last:
                yield last, "$", m.end() - m.start() - slashes == 1
        elif m.group()[-1] in "[(" or slashes % 2:
            yield m.end() - 2, m.group()[-2:], True


def find_segments(text: str) -> list[tuple]:
    """(kind, raw, expression, display, start, end) of the pieces of a text, in order; kind is text, math or unclosed.

    An unclosed piece is empty and marks a sign that nothing closes; the text around it holds that sign. One pass over the
    signs: the closing ones are taken off their queues once they lie behind.
    """
    signs = list(_signs(text))
    closing = {sign: deque(at for at, other, closes in signs if other == sign and closes) for sign in _CLOSE.values()}
    found, start, cursor = [], 0, 0
    for at, sign, _ in signs:
        if at < cursor or sign not in _CLOSE:
            continue
        inner, display, queue = at + len(sign), sign in ("$$", "\\["), closing[_CLOSE[sign]]
        while queue and queue[0] < inner:
            queue.popleft()
        cursor = inner
        if not queue:
            found.append(("unclosed", "", sign, display, at, at))
            continue
        cursor = queue[0] + len(_CLOSE[sign])
        if at > start:
            found.append(("text", text[start:at], None, None, start, at))
        found.append(("math", text[at:cursor], text[inner : queue[0]], display, at, cursor))
        start = cursor
    if len(text) > start:
        found.append(("text", text[start:], None, None, start, len(text)))
    return found


def _segments(c: Column) -> Column:
    fields = ("kind", "raw", "expression", "display", "start", "end")
    # rules use the result in lambdas, where no Python function may end up by inlining; the optimizer leaves this one where it stands
    scan = F.pandas_udf(lambda texts: texts.map(lambda t: [dict(zip(fields, s)) for s in find_segments(t)] if t else []), _SEGMENT)
    return scan.asNondeterministic()(c)


def _lines(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), "\\r\\n?", "\n")


def with_segments(df: DataFrame, text: str | Column, name: str = "segments") -> DataFrame:
    """df with array<struct<kind,raw,expression,display,start,end>>: formulas between $, $$, \\( \\) or \\[ \\], and the texts between them.

    Places count code points from 0. Signs that nothing closes are listed as `unclosed`; their text stays in the text around them.
    """
    return df.withColumn(name, _segments(_lines(text)))


def _hidden(parts: Column) -> Column:
    """The segments' text with numbered marks in the place of formulas."""
    shown = F.filter(parts, lambda s: s["kind"] != "unclosed")
    return F.array_join(F.transform(shown, lambda s, i: F.when(s["kind"] == "math", F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_SHUT))).otherwise(s["raw"])), "")


def _shown(text: Column, parts: Column) -> Column:
    """The text with the formulas back at the marks that are left."""
    raws = F.transform(F.filter(parts, lambda s: s["kind"] != "unclosed"), lambda s: s["raw"])
    return _put_back(text, raws)


def _put_back(text: Column, raws: Column) -> Column:
    def one(piece: Column, i: Column, raws: Column) -> Column:
        halves = F.split(piece, _SHUT)
        return F.when(i == 0, piece).otherwise(F.concat(F.coalesce(F.get(raws, F.get(halves, F.lit(0)).try_cast("int")), F.lit("")), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))))

    # the list is made once, not once more for each piece
    return once(raws, lambda r: F.array_join(F.transform(F.split(text, _OPEN), lambda piece, i: one(piece, i, r)), ""))


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


_WORD = "A-Za-z0-9_"
_MARKUP = [(r"<w:br\s*/?>|</w:p>|</w:tr>", "\n"), (r"<[^>]+>", "")]
_BLANKS = [("\\u00A0", " "), ("[ \\t]+\\n", "\n"), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n")]
_LAST = [
    (f"(?<![\\\\{_WORD}])({'|'.join(BARE_COMMANDS)})(?=[{SPACE}{{])", "\\\\$1"),
    (f"(?i)(?<![{_WORD}])(?:false|true)(?![{_WORD}])", ""),
    (f"[{SPACE}]+({FIGURE_BREAK})", "$1"),
]


def clean_text(parts: str | Column) -> Column:
    """A recognized text, given by its segments, without markup, entities, surplus blanks and the words true and false.

    Formulas keep their inner blanks and signs; bare command words get their backslash. Null gives an empty text.
    """
    parts = _col(parts)
    text = _chain(_hidden(parts), _MARKUP)
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return trimmed(_chain(_shown(trimmed(_chain(text, _BLANKS)), parts), _LAST))


def clean_texts(df: DataFrame, *columns: str) -> DataFrame:
    """df with the text columns cleaned."""
    for c in columns:
        df = with_segments(df, c, f"_segments_{c}")
    return df.withColumns({c: clean_text(f"_segments_{c}") for c in columns}).drop(*[f"_segments_{c}" for c in columns])


def clean_question(questions: DataFrame) -> DataFrame:
    """Questions with stem, options, answer and solution as they are saved; there are four options, of images only or not."""
    option = lambda i: F.get("options", F.lit(i))
    spread = questions.withColumns({f"_o{i}": option(i) for i in range(4)})
    clean = clean_texts(spread, "stem", "answer", "solution", *[f"_o{i}" for i in range(4)])
    saved = {c: saved_text(c) for c in ("stem", "answer", "solution")} | {"options": F.array(*[saved_option(f"_o{i}") for i in range(4)])}
    return clean.withColumns(saved).drop(*[f"_o{i}" for i in range(4)])


def relevance_tokens(cleaned: str | Column) -> Column:
    """Distinct tokens of a cleaned text: commands, single variables, upper-case names, pairs of CJK characters and short phrases."""
    t = F.coalesce(_col(cleaned), F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    variables = F.transform(F.filter(every("(?<![A-Za-z])[A-Za-z](?![A-Za-z])"), lambda x: ~x.rlike("^[A-Da-d]$")), F.lower)
    names = F.filter(every("[A-Z][A-Z_0-9]{0,3}"), lambda x: ~x.rlike("^[A-D]$"))
    pairs = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2)))
    phrases = F.flatten(F.transform(every("[\\u4e00-\\u9fa5]{2,}"), lambda p: F.concat(F.when(F.length(p) <= 6, F.array(p)).otherwise(F.slice(F.array(p), 1, 0)), pairs(p))))
    known = F.array(*map(F.lit, STOP_WORDS + COMMON_TOKENS))
    kept = lambda x: ~F.array_contains(known, x) & ((F.length(x) >= 2) | x.rlike("^[XYZMNKPQRSTxyzmnkpqrst]$"))
    return F.array_distinct(F.filter(F.concat(every("\\\\[a-zA-Z]+"), variables, names, phrases), kept))


def formula_text(cleaned: str | Column) -> Column:
    """A cleaned formula between single dollars; empty if nothing in it looks like a formula."""
    bare = trimmed(_chain(F.coalesce(_col(cleaned), F.lit("")), [("(?i)^```(?:latex)?", ""), ("```$", ""), (r"^\$\$|\$\$$", ""), (r"^\$|\$$", "")]))
    return F.when(bare.rlike(r"[\\_^{}=+\-*/]"), F.concat(F.lit("$"), bare, F.lit("$"))).otherwise("")


def has_media(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(MEDIA)


def has_placeholder(c: str | Column) -> Column:
    """Whether a text holds an image, be it a media token or a placeholder of one."""
    return F.coalesce(_col(c), F.lit("")).rlike("|".join([*PLACEHOLDERS, MEDIA]))


def unconverted(c: str | Column) -> Column:
    """Whether a text, media tokens left out, still speaks of an image that was not converted."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), MEDIA, _OPEN).rlike(UNCONVERTED)


def strip_placeholders(c: str | Column) -> Column:
    """A text without placeholders of images; media tokens stay."""
    t = F.coalesce(_col(c), F.lit(""))
    tokens = F.regexp_extract_all(t, F.lit(MEDIA), F.lit(0))
    # the n-th piece between tokens gets the mark of the n-th token before it
    pieces = F.transform(F.split(t, MEDIA), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_SHUT), p)))
    bare = _chain(F.array_join(pieces, ""), [("|".join(PLACEHOLDERS), ""), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n"), (f"[{SPACE}]+([，。；：,.、])", "$1")])
    return trimmed(_put_back(trimmed(bare), tokens))


def leaked_payload(c: str | Column) -> Column:
    """Whether a text is structured output that was never parsed: braces, and at least three of its known fields."""
    t = F.coalesce(_col(c), F.lit(""))
    fields = sum((t.rlike(p).cast("int") for p in PAYLOAD_FIELDS), F.lit(0))
    return t.rlike(r"[{}]") & t.rlike(r"[\"\[\]:,]") & (fields >= 3)


def _cut_braces(text: Column, brace: str, most: Column) -> Column:
    """The text without its leading and then its trailing braces, `most` at most."""
    count = lambda c: F.regexp_count(c, F.lit(f"\\{brace}"))
    head = once(F.regexp_extract(text, f"^(?:\\{brace}[{SPACE}]*)*", 0), lambda h: F.struct(h.alias("h"), F.least(count(h), most).alias("n")))

    def front(x: Column) -> Column:
        blanks = F.split(x["h"], f"\\{brace}")
        kept = F.array_join(F.transform(F.slice(blanks, x["n"] + 2, F.size(blanks)), lambda b: F.concat(F.lit(brace), b)), "")
        rest = F.substring(text, F.length(x["h"]) + 1, F.length(text))
        return F.when(x["n"] > 0, F.concat(kept, rest)).otherwise(text)

    def back(t: Column, left: Column) -> Column:
        tail = F.regexp_extract(t, f"(?:[{SPACE}]*\\{brace})+$", 0)
        kept = lambda e: F.array_join(F.transform(F.slice(F.split(e, f"\\{brace}"), F.lit(1), F.greatest(count(e) - left, F.lit(0))), lambda b: F.concat(b, F.lit(brace))), "")
        return once(tail, lambda e: F.when((left > 0) & (e != ""), F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(e)), kept(e))).otherwise(t))

    return once(head, lambda x: once(front(x), lambda t: back(t, most - x["n"])))


def _without_loose_braces(t: Column) -> Column:
    """Braces that nothing pairs go from the start and the end of a text, as many as there are too many; blanks between them too."""
    surplus = F.regexp_count(t, F.lit(r"(?<!\\)\{")) - F.regexp_count(t, F.lit(r"(?<!\\)\}"))
    return once(surplus, lambda n: F.when(n < 0, _cut_braces(t, "}", -n)).when(n > 0, _cut_braces(t, "{", n)).otherwise(t))


def strip_wrappers(c: str | Column) -> Column:
    """A text without code fences, list environments and loose braces; equations become display formulas, leaked payloads a notice."""
    names = "|".join(WRAPPERS)
    steps = [
        (f"(?m)^```[a-z]*[{SPACE}]*$", ""), (r"\\begin\{equation\*?\}", r"\\["), (r"\\end\{equation\*?\}", r"\\]"), (f"(?m)^\\\\(?:begin|end)\\{{(?:{names})\\}}[{SPACE}]*$", ""),
        (f"\\\\(?:begin|end)\\{{(?:{names})\\}}", ""), (f"(?m)^\\\\item(?:\\[[^\\]]*\\])?[{SPACE}]*", ""),
    ]
    bare = once(_chain(F.coalesce(_col(c), F.lit("")), steps), _without_loose_braces)
    t = trimmed(F.regexp_replace(bare, "\\n{3,}", "\n\n"))
    return once(t, lambda t: F.when(t.rlike(f"^[{SPACE}{{}}]*$"), "").when(leaked_payload(t), PAYLOAD_NOTICE).otherwise(t))


def saved_text(cleaned: str | Column) -> Column:
    """A cleaned text as it is saved: without placeholders and wrappers."""
    return strip_wrappers(strip_placeholders(cleaned))


def saved_option(cleaned: str | Column) -> Column:
    """saved_text of an option; an option of nothing but images keeps its media tokens."""
    t = F.coalesce(_col(cleaned), F.lit(""))
    return once(saved_text(t), lambda s: F.when(s == "", F.array_join(F.regexp_extract_all(t, F.lit(MEDIA), F.lit(0)), " ")).otherwise(s))


_DISPLAY = f"\\\\(?:{'|'.join(DISPLAY_COMMANDS)})(?![{_WORD}])|√[{SPACE}]*2|π"
_RUN = r"[A-Za-z0-9\\{}()\[\]^_+\-*/=.,:;|<>!~ \t√π]+"


_LABEL = f"^[{SPACE}]*[A-FＡ-Ｆ][.．、:：][{SPACE}]*"


def display_formulas(df: DataFrame, line: str, name: str = "display") -> DataFrame:
    """df with a line whose runs of formula characters that hold a command stand between dollars; π and √2 become commands.

    Formulas between signs stay as they are; an option's label is narrow and has a blank after it.
    """
    t = F.coalesce(F.col(line), F.lit(""))
    label = F.regexp_extract(t, _LABEL, 0)
    cut = with_segments(df.withColumn("_label", label), F.substring(t, F.length(label) + 1, F.length(t)), "_parts")
    cut, hidden = cut.withColumn("_hidden", _hidden(F.col("_parts"))), F.col("_hidden")
    # every other piece is a formula or a run of formula characters
    marked = F.regexp_replace(hidden, f"{_OPEN}[0-9]+{_SHUT}|{_RUN}", "\ufdd2$0\ufdd2")

    def run(piece: Column) -> Column:
        core = trimmed(_chain(piece, [(f"√[{SPACE}]*2", r"\\sqrt{2}"), ("π", r"\\pi")]))
        lead, trail = F.regexp_extract(piece, f"^[{SPACE}]*", 0), F.regexp_extract(piece, f"[{SPACE}]*$", 0)
        bare = ~piece.rlike(f"{_OPEN}|{_SHUT}") & piece.rlike(_DISPLAY) & ~core.rlike(r"(?s)^(?:\\\(.*\\\)|\\\[.*\\\])$")
        return F.when(bare, F.concat(lead, F.lit("$"), core, F.lit("$"), trail)).otherwise(piece)

    made = F.array_join(F.transform(F.split(marked, "\ufdd2"), run), "")
    body = _shown(F.when(hidden.rlike(_DISPLAY), made).otherwise(hidden), F.col("_parts"))
    narrow = F.translate("_label", "ＡＢＣＤＥＦ", "ABCDEF")
    head = F.when((body != "") & narrow.rlike("[.．、:：]$"), F.concat(narrow, F.lit(" "))).otherwise(narrow)
    return cut.withColumn(name, F.concat(head, body)).drop("_label", "_parts", "_hidden")
