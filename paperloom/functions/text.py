"""Column functions on texts, question numbers, page ranges and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming removes, as a character class body.
SPACE = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Punctuation that comparisons ignore.
IGNORED = "，。；：、,.．"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: str | Column) -> Column:
    """Null becomes empty; white space goes at both ends."""
    return F.btrim(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(_BLANKS))


def has_text(c: str | Column) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("")).rlike(f"[^{SPACE}]")


def compare_text(c: str | Column) -> Column:
    """What two texts must share to count as loosely equal: no blanks, sizing commands or punctuation, narrow brackets and A-D, lower case."""
    plain = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), "\\\\left|\\\\right", "")
    return F.lower(F.translate(plain, "（）ＡＢＣＤ" + _BLANKS + IGNORED, "()ABCD"))


def same_text(a: str | Column, b: str | Column) -> Column:
    return compare_text(a) == compare_text(b)


def stem_fingerprint(stem: str | Column) -> Column:
    return compare_text(stem)


def core_fingerprint(stem: str | Column, options: str | Column) -> Column:
    """Compared stem and compared options; a question without either has the empty key "__"."""
    parts = F.transform(F.coalesce(_col(options), F.expr("cast(array() as array<string>)")), compare_text)
    return F.concat(compare_text(stem), F.lit("__"), F.array_join(parts, "|", ""))


def question_number(c: str | Column) -> Column:
    """First run of up to three digits, full-width ones folded, as a plain number; empty if there is none above 0."""
    folded = F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), "０１２３４５６７８９", "0123456789")
    number = F.regexp_replace(F.regexp_extract(folded, "[0-9]{1,3}", 0), "^0+", "")
    return number


def valid_page_range(c: str | Column) -> Column:
    """Empty, or pages and rising ranges above 0 between commas."""
    text = trimmed(c)
    parts = F.split(text, ",")
    bounds = lambda p: F.split(p, "-")
    good = lambda p: p.rlike("^[0-9]+(-[0-9]+)?$") & (F.expr("0") < bounds(p)[0].try_cast("long")) & (bounds(p)[0].try_cast("long") <= F.element_at(bounds(p), -1).try_cast("long"))
    return (text == "") | F.coalesce(F.forall(parts, good), F.lit(False))


def expand_page_range(c: str | Column, max_page: str | Column) -> Column:
    """Sorted distinct pages up to max_page; all of them for an empty text. Parts that are no page add nothing."""
    text, most = trimmed(c), _col(max_page).cast("long")
    none = F.expr("cast(array() as array<bigint>)")

    def pages(part: Column) -> Column:
        low, high = F.split(part, "-")[0].try_cast("long"), F.least(F.element_at(F.split(part, "-"), -1).try_cast("long"), most)
        shaped = part.rlike("^[0-9]+-[0-9]+$") | part.rlike("^[ ]*[0-9]+[ ]*$")
        return F.when(shaped & (F.greatest(low, F.lit(1)) <= high), F.sequence(F.greatest(low, F.lit(1)), high)).otherwise(none)

    every = F.when(most >= 1, F.sequence(F.lit(1).cast("long"), most)).otherwise(none)
    return F.when(text == "", every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), pages)))))


def normal_box(box: str | Column) -> Column:
    """[x1, y1, x2, y2] with the smaller corner first; empty if it isn't four finite numbers or has no area."""
    b = _col(box)
    none = F.expr("cast(array() as array<double>)")
    fit = (F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    at = lambda i: F.get(b, F.lit(i))
    made = F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3)))
    return F.when(fit & (at(0) != at(2)) & (at(1) != at(3)), made).otherwise(none)


def box_overlap(left: str | Column, right: str | Column) -> Column:
    """Area that two boxes share; 0 if either is empty."""
    a, b = normal_box(left), normal_box(right)
    g = lambda x, i: F.get(x, F.lit(i))
    w = F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0))
    h = F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1))
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
