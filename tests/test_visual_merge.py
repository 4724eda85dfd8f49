"""Drafts mended by what was recognized on pictures."""

from paperloom.operators.visual_merge import merge_visual_drafts

DRAFTS = "draft_id int, batch_id string, question_number string, stem string, options array<string>"
VISUAL = "batch_id string, ordinal int, question_number string, stem string, options array<string>"


def merged(spark, drafts, visual):
    got = merge_visual_drafts(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(visual, VISUAL)).collect()
    return {r["draft_id"]: (r["stem"], r["options"], r["merged"]) for r in got}


def test_first_visual_draft_of_a_number_counts(spark):
    got = merged(spark, [(1, "b", "第１题", "s", ["a"]), (2, "b", None, "t", None), (3, "c", "1", "u", ["x", "y"])], [("b", 2, "1", "$x$ $y$ two", []), ("b", 1, "1.", "$x$ $y$ one", None), ("b", 3, "", "none", [])])
    assert got == {1: ("$x$ $y$ one", ["a", "", "", ""], True), 2: ("t", None, False), 3: ("u", ["x", "y"], False)}


def test_options_are_chosen_one_by_one(spark):
    open_, image = "[公式图片选项待转换:wmf]", "[[IMAGE:i]]"
    text = [f"{open_} {image}", f"{image} old", "x", "$a$ [图片选项待转换]", "fifth"]
    seen = ["$\\frac{1}{2}$", "$\\frac{1}{2}$ \\sin \\cos", "\\sin", "$a$ $b$ $c$ [图片选项待转换] [图片选项待转换]"]
    got = merged(spark, [(1, "b", "1", "", text)], [("b", 1, "1", "", seen)])
    # one sign more is not enough, and neither is a text with more open formulas
    assert got[1] == ("", [f"$\\frac{{1}}{{2}}$\n{image}", f"{image} old", "x", "$a$ [图片选项待转换]"], True)


def test_tokens_are_carried_once_and_blank_pictures_lose(spark):
    got = merged(spark, [(1, "b", "7", "[公式图片待转换] [[IMAGE:a]] [[IMAGE:b]]", ["[公式图片待转换]", "[公式图片待转换]"])], [("b", 1, "7", "$x$ [[IMAGE:b]]", ["", "y"])])
    assert got[1] == ("$x$ [[IMAGE:b]]\n[[IMAGE:a]]", ["[公式图片待转换]", "y", "", ""], True)


def test_no_visual_drafts(spark):
    assert merged(spark, [(1, "b", "1", " s ", [])], []) == {1: (" s ", [], False)}
