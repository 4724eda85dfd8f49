"""Drafts from a document's text, mended by what was recognized on its pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.latex import clean_text, with_segments
from paperloom.functions.text import question_number, trimmed
from paperloom.operators.support import pick
from paperloom.tables import spread

# What stands for a formula not converted, tokens of images, commands that count as signs of a formula.
OPEN_FORMULA = "\\[(?:公式图片(?:选项)?待转换|图片选项待转换)[^\\]]*\\]"
TOKEN = "\\[\\[(?:IMAGE|FORMULA_IMAGE):[^\\]]+\\]\\]"
COMMANDS = "frac sqrt sin cos tan log ln angle triangle vec overrightarrow overline overset subset subseteq in cap cup pi theta"
SIGNS = "|".join(f"\\\\{c}" for c in COMMANDS.split())
OPTIONS = 4
#: Signs that a recognized text must have more than the other.
LEAD = 2


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))


def _carried(text: Column, other: Column) -> Column:
    """The text with the image tokens of another that it lacks, a line each."""
    more = F.array_except(_tokens(other), _tokens(text))
    return trimmed(F.concat_ws("\n", F.nullif(trimmed(text), F.lit("")), F.nullif(F.array_join(more, "\n"), F.lit(""))))


def merge_visual_drafts(drafts: DataFrame, visual: DataFrame, batch: str = "batch_id", id_col: str = "draft_id") -> DataFrame:
    """drafts with stem and four options chosen from the text or the picture, and `merged`.

    drafts has (id, batch, question_number, stem, options), ids distinct, visual (batch, ordinal, question_number, stem,
    options). Rows meet by the number's first digits; of several visual drafts the first by ordinal counts, and a draft without number or partner
    keeps its texts, with merged false. Texts are cleaned first. An option with an image and no open formula stays. Where the text has
    an open formula and the picture none, or the picture has two signs of formulas more and not more open ones, the picture's text is taken
    and the image tokens it lacks are put below. Missing options are empty, those behind the fourth left out.
    """
    keyed = drafts.withColumn("_q", question_number("question_number"))
    first = pick(visual.withColumn("_q", question_number("question_number")).where("_q != ''"), [batch, "_q"], "ordinal")
    joined = keyed.join(first.select(batch, "_q", F.col("stem").alias("_stem"), F.col("options").alias("_options")), [batch, "_q"], "left").withColumn("_met", F.col("_options").isNotNull() | F.col("_stem").isNotNull())
    at = lambda stem, options, i: F.coalesce(F.col(stem) if i < 0 else F.get(options, F.lit(i)), F.lit(""))
    pairs = [F.struct(F.lit(i).alias("i"), at("stem", "options", i).alias("x"), at("_stem", "_options", i).alias("v")) for i in range(-1, OPTIONS)]
    texts = spread(joined.where("_met"), id_col).select(id_col, F.explode(F.array(*pairs)).alias("_p")).select(id_col, "_p.*")
    for c in ("x", "v"):
        texts = with_segments(texts, c, f"_s{c}").withColumn(c, clean_text(f"_s{c}")).drop(f"_s{c}")
        texts = with_segments(texts, c, f"_s{c}")
    x, v = F.col("x"), F.col("v")
    open_ = lambda c: F.regexp_count(c, F.lit(OPEN_FORMULA))
    signs = lambda c, s: F.regexp_count(c, F.lit(SIGNS)) + F.size(F.filter(s, lambda p: p["kind"] == "math"))
    whole = (open_(x) > 0) & (open_(v) == 0)
    better = (v != "") & ((whole & (F.length(v) >= 2)) | ((signs(v, "_sv") >= signs(x, "_sx") + LEAD) & (open_(v) <= open_(x))))
    option = F.col("i") >= 0
    stays = option & (F.size(_tokens(x)) > 0) & (open_(x) == 0)
    chosen = F.when(stays, x).when((option & whole & (v != "")) | better, _carried(v, x)).otherwise(x)
    lists = texts.select(id_col, "i", chosen.alias("t")).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda p: p["t"]).alias("_l"))
    told = joined.join(lists, id_col, "left")
    stem = F.when(F.col("_met"), F.get("_l", F.lit(0))).otherwise(F.col("stem"))
    options = F.when(F.col("_met"), F.slice("_l", 2, OPTIONS)).otherwise(F.col("options"))
    return told.withColumns({"stem": stem, "options": options, "merged": F.col("_met")}).select(*drafts.columns, "merged")
