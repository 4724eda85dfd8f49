"""Page jobs: page texts, question blocks, text signals, the choice between two texts of a page, figure bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.answers import final_choice
from paperloom.functions.latex import clean_texts
from paperloom.functions.text import SPACE, _col, normal_box, once, trimmed

# Question markers, signs of broken glyphs, LaTeX and choices.
QUESTION_MARK = f"(?:^|\\n)[{SPACE}]*(?:第[{SPACE}]*([0-9０-９]{{1,3}})[{SPACE}]*题|[（(][{SPACE}]*([0-9０-９]{{1,3}})[{SPACE}]*[)）]|([0-9０-９]{{1,3}})[{SPACE}]*[.．、:：)）])[{SPACE}]*"
# Of each pattern the part that most characters fail comes first: usual characters, the sign of a command, the label's letter.
BAD_GLYPH = "[[^\\u0020-\\u24FF\\u3000-\\u9FFF\\t\\n\\r]&&[\\uFFFD□▯■▪▫◼◻\\uE000-\\uF8FF\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F]]"
LATEX_SIGNAL = r"\\(?:frac|sqrt|sin|cos|tan|angle|triangle|vec|overrightarrow|overline|subset|subseteq|in|cap|cup|pi|theta)|\$[^$\n]+\$"
CHOICE_SIGNAL = f"[A-DＡ-Ｄ](?<=(?:^|[{SPACE}])[A-DＡ-Ｄ])[{SPACE}]*[.．、:：)）]"
MATH_SIGNALS = [r"\\(?:frac|sqrt|vec|overrightarrow|angle|triangle|sin|cos|tan|theta|alpha|beta|lambda)", r"\$", "[_^=]", "[≤≥≠∈⊂⊆∪∩√π]"]
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"
#: Non-characters, which no text holds: start of a block, end of its number, end of its marker.
_START, _NUMBER, _MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def page_texts(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, file_id, page_index, source_order, text) of the pages that have text.

    pages has (doc, file_id, ordinal, page_index, source_order, text, raw_text, content): the first text that isn't blank
    counts, a missing index or order is the ordinal, and of a repeated (file, page) the first stays.
    """
    best = F.lit("")
    for c in ("content", "raw_text", "text"):
        clean = trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"))
        best = F.when(clean != "", clean).otherwise(best)
    rows = pages.select(doc, F.coalesce("file_id", F.lit("")).alias("file_id"), "ordinal", F.coalesce("page_index", "ordinal").alias("page_index"), F.coalesce("source_order", "ordinal").alias("source_order"), best.alias("text"))
    key = [doc, "file_id", "page_index"]
    first = rows.where("text != ''").groupBy(*key).agg(F.min(F.struct("ordinal", "source_order", "text")).alias("_r"))
    return first.select(*key, F.col("_r")["source_order"].alias("source_order"), F.col("_r")["text"].alias("text"))


def distinct_texts(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages with a text of their document that no earlier one has."""
    return pages.withColumn("_r", F.row_number().over(Window.partitionBy(doc, F.xxhash64("text"), "text").orderBy("source_order", "page_index"))).where("_r = 1").drop("_r")


def question_blocks(text: str | Column) -> Column:
    """array<struct<number,raw,body>>: a text cut at its question markers; without markers it is block 1, empty texts have none.

    Blank space after a marker belongs to it, so a marker on the line after an empty question starts no block.
    """
    clean = trimmed(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\\r\\n?", "\n"))

    def parted(head: Column) -> Column:
        number = F.translate(F.get(head, F.lit(0)), _WIDE, _NARROW)
        return once(F.split(F.get(head, F.lit(1)), _MARK), lambda p: F.struct(number.alias("number"), trimmed(F.concat(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("raw"), trimmed(F.get(p, F.lit(1))).alias("body")))

    def blocks(pieces: Column) -> Column:
        cut = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: once(F.split(x, _NUMBER), parted))
        # the text before the first marker is dropped; without one it is all of the text
        all_ = F.get(pieces, F.lit(0))
        whole = F.array(F.struct(F.lit("1").alias("number"), all_.alias("raw"), all_.alias("body")))
        return F.when(F.size(pieces) > 1, cut).when(all_ == "", F.slice(whole, 1, 0)).otherwise(whole)

    return once(F.split(F.regexp_replace(clean, QUESTION_MARK, f"{_START}$1$2$3{_NUMBER}$0{_MARK}"), _START), blocks)


def text_signals(text: str | Column) -> Column:
    """struct(length, bad_glyphs, latex, choices, blocks) of a page text; the length counts code points."""
    t = F.coalesce(_col(text), F.lit(""))
    marks = F.regexp_count(trimmed(F.regexp_replace(t, "\\r\\n?", "\n")), F.lit(QUESTION_MARK))
    return F.struct(
        F.length(t).alias("length"),
        F.regexp_count(t, F.lit(BAD_GLYPH)).alias("bad_glyphs"),
        F.regexp_count(t, F.lit(LATEX_SIGNAL)).alias("latex"),
        F.regexp_count(t, F.lit(CHOICE_SIGNAL)).alias("choices"),
        F.when(trimmed(t) == "", 0).otherwise(F.greatest(marks, F.lit(1))).alias("blocks"),
    )


def math_signals(text: str | Column) -> Column:
    """How many commands, dollars, script marks and mathematical signs a text has."""
    t = F.coalesce(_col(text), F.lit(""))
    return sum((F.regexp_count(t, F.lit(p)) for p in MATH_SIGNALS), F.lit(0))


def cleaned_signals(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `signals` (see `math_signals`) and `choice` (see `final_choice`) of their cleaned text; the text itself stays as it is."""
    cleaned = clean_texts(rows.withColumn("_clean", F.col(text)), "_clean")
    return cleaned.withColumns({"signals": math_signals("_clean"), "choice": final_choice("_clean")}).drop("_clean")


def useful_text_layer(text: str | Column) -> Column:
    """At least 80 characters, two question markers and the choices A and B."""
    t = F.translate(F.coalesce(_col(text), F.lit("")), _WIDE + "ＡＢＣＤ", _NARROW + "ABCD")
    marks = F.regexp_count(t, F.lit(f"(?:^|\\n|[{SPACE}])(?:第[{SPACE}]*)?[0-9]{{1,3}}[{SPACE}]*(?:题)?[.．、:：)）]"))
    choice = lambda letter: t.rlike(f"(?:^|\\n|[{SPACE}]){letter}[{SPACE}]*[.．、:：)）]")
    return (F.length(t) >= 80) & (marks >= 2) & choice("A") & choice("B")


def choose_text(pages: DataFrame, layer: str = "text_layer", recognized: str = "recognized") -> DataFrame:
    """pages with `source_kind` (textLayer, recognized or empty) and `reason`.

    The recognized text wins only where the layer is broken or has fewer formulas, and it keeps blocks and choices.
    """
    a, b = F.col("_a"), F.col("_b")
    found = pages.withColumn("_a", text_signals(layer)).withColumn("_b", text_signals(recognized))
    broken = (a["bad_glyphs"] >= 3) | ((a["length"] >= 100) & (a["latex"] == 0) & (a["bad_glyphs"] >= 1))
    keeps = (b["blocks"] >= F.greatest(F.lit(1), a["blocks"] - 1)) & (b["choices"] >= a["choices"] - 4)
    cleaner = (b["bad_glyphs"] <= F.floor(a["bad_glyphs"] * 0.25)) & (b["latex"] > a["latex"])
    scores = (b["bad_glyphs"] < a["bad_glyphs"]) & (b["latex"] >= a["latex"] + 5)
    blank = lambda c: trimmed(c) == ""
    reason = (
        F.when(blank(layer) & blank(recognized), "both-empty").when(blank(recognized), "recognized-empty").when(blank(layer), "text-layer-empty")
        .when(broken & keeps & cleaner, "text-layer-broken").when(keeps & scores, "recognized-by-score").otherwise("keep-text-layer")
    )
    kind = F.when(F.col("reason") == "both-empty", "empty").when(F.col("reason").isin("recognized-empty", "keep-text-layer"), "textLayer").otherwise("recognized")
    return found.withColumn("reason", reason).withColumn("source_kind", kind).drop("_a", "_b")


def figure_bands(lines: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, question, box) for every question marker of a page: the band between its last long stem line and its options.

    lines has (doc, page, text, nx1, ny1, nx2, ny2) on a page of 1000 by 1000; box is empty where there are no options,
    no long stem line above them, or less than 35 between them. A page's lines are gathered into one array.
    """
    t = trimmed("text")
    number = F.regexp_replace(F.regexp_extract(t, f"^([0-9]{{1,3}})[{SPACE}]*[.．、:：)）]", 1), "^0+(?=.)", "")
    mark = f"[{SPACE}]*[.．、:：)）]"
    option = t.rlike(f"^A{mark}") | t.rlike(f"(^|[{SPACE}])A{mark}.{{0,80}}(^|[{SPACE}])B{mark}")
    long_ = ~option & ~t.rlike("^[甲乙丙丁]$") & ~t.rlike(f"^[A-D]{mark}") & (F.length(t) >= 8)
    marked = lines.withColumn("_l", F.struct("ny1", "ny2", "nx1", "nx2", F.when(number != "", number.cast("int")).alias("q"), option.alias("option"), long_.alias("long")))
    whole = marked.groupBy(doc, page).agg(F.array_sort(F.collect_list("_l")).alias("_all"))
    heads = whole.withColumn("_h", F.explode(F.filter("_all", lambda x: x["q"].isNotNull())))
    firsts = heads.withColumn("_r", F.row_number().over(Window.partitionBy(doc, page, F.col("_h")["q"]).orderBy(F.col("_h")["ny1"]))).where("_r = 1")
    top = F.col("_h")["ny1"]
    after = F.filter("_all", lambda x: (x["q"] > F.col("_h")["q"]) & (x["ny1"] > top))
    own = firsts.withColumn("_next", F.coalesce(F.array_min(F.transform(after, lambda x: x["ny1"])), F.lit(1000.0)))
    own = own.withColumn("_own", F.filter("_all", lambda x: (x["ny1"] >= top - 2) & (x["ny1"] < F.col("_next") - 2)))
    own = own.withColumn("_opt", F.get(F.filter("_own", lambda x: x["option"]), F.lit(0)))
    own = own.withColumn("_stem", F.try_element_at(F.filter("_own", lambda x: x["long"] & (x["ny2"] < F.col("_opt")["ny1"])), F.lit(-1)))
    inside = F.filter("_own", lambda x: x["ny1"] >= top)
    x1 = F.greatest(F.lit(0.0), F.array_min(F.transform(inside, lambda x: x["nx1"])) - 35)
    x2 = F.least(F.lit(1000.0), F.array_max(F.transform(inside, lambda x: x["nx2"])) + 35)
    y1, y2 = F.least(F.lit(1000.0), F.col("_stem")["ny2"] + 10), F.greatest(F.lit(0.0), F.col("_opt")["ny1"] - 10)
    wide = F.coalesce(x2 - x1 >= 100, F.lit(False))
    box = F.array(F.when(wide, x1).otherwise(70.0), y1, F.when(wide, x2).otherwise(930.0), y2)
    return own.select(doc, page, F.col("_h")["q"].alias("question"), F.when(y2 - y1 >= 35, normal_box(box)).otherwise(F.expr("cast(array() as array<double>)")).alias("box"))
