"""Formula texts, options and sections on small rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import options as O


def many(spark, column, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r["y"] for r in sorted(spark.createDataFrame(rows, f"i int, x {kind}").select("i", column("x").alias("y")).collect())]


def scan(text):
    """Formulas by the rules read literally: place by place, closing signs looked up anew."""

    def escaped(i):
        return (i - len(text[:i].rstrip("\\"))) % 2 == 1

    def closes(sign, at):
        for i in range(at, len(text)):
            if text.startswith(sign, i) and not escaped(i) and not (sign == "$" and (text.startswith("$$", i) or text[i - 1] == "$")):
                return i
        return -1

    found, i = [], 0
    while i < len(text):
        sign = next((s for s in ("$$", "\\[", "\\(", "$") if text.startswith(s, i) and not ("$" in s and escaped(i))), None)
        if sign is None:
            i += 1
            continue
        end = closes({"\\[": "\\]", "\\(": "\\)"}.get(sign, sign), i + len(sign))
        if end < 0:
            i += len(sign)
        else:
            found.append((i, end + len(sign)))
            i = end + len(sign)
    return found


def test_segments_match_a_literal_scan():
    import itertools

    signs = ["$", "\\", "[", "]", "(", ")", "a"]
    for n in range(1, 6):
        for parts in itertools.product(signs, repeat=n):
            t = "".join(parts)
            got = L.find_segments(t)
            assert [(s[4], s[5]) for s in got if s[0] == "math"] == scan(t), t
            assert "".join(s[1] for s in got) == t


def test_clean_text(spark):
    cases = {
        None: "", "a<w:br/>b</w:p>c": "a\nb\nc", "x &lt; 1 &amp;amp; y": "x < 1 &amp; y", "$a  <b> c$  <b>d</b>": "$a  <b> c$ d", "frac {1}": "\\frac {1}", "it is TRUE , ok": "it is, ok", "angle ABC": "\\angle ABC", "triangles": "triangles",
        "a\n\n\n\nb  c": "a\n\nb c", "$x < y$ and z > w": "$x < y$ and z > w", "a < $x$ > b": "a b",
    }
    df = L.clean_texts(spark.createDataFrame(list(enumerate(cases)), "i int, x string"), "x")
    assert [r["x"] for r in sorted(df.collect())] == list(cases.values())


def test_tokens_and_formulas(spark):
    got = many(spark, L.relevance_tokens, ["已知圆心坐标 \\frac x AB P", None, "A B sin"])
    assert got[0] == ["\\frac", "x", "p", "AB", "P", "已知圆心坐标", "知圆", "圆心", "心坐", "坐标"]
    assert got[1:] == [[], []]
    assert many(spark, L.formula_text, ["```latex\nx^2```", "$$a=b$$", "word", None]) == ["$x^2$", "$a=b$", "", ""]


def test_placeholders(spark):
    assert many(spark, L.strip_placeholders, ["[[IMAGE:a]] x [公式图片:3] ，y", "[IMAGE:1]", None, "\\includegraphics[w]{f}  z"]) == ["[[IMAGE:a]] x，y", "", "", "\\includegraphics[w]{f} z"]
    assert many(spark, L.has_placeholder, ["[[IMAGE:a]]", "[图片选项待转换x]", "a", None]) == [True, True, False, False]
    assert many(spark, L.unconverted, ["[[IMAGE:null]]", "a null b", "nullable", "待转换:WMF"]) == [False, True, False, True]


WRAPPED = {
    "```latex\nx\n```": "x", "\\begin{equation*}a\\end{equation*}": "\\[a\\]", "\\begin{enumerate}\n\\item[1] a\n\\end{enumerate}": "a", "} a }": "a", "{{ a}": "{ a}", "a {": "a", "{}": "", "\\{ a": "\\{ a", "}}{a": "}{a", None: "",
    '{"stem": "a", "answer": "b", "type": "c"}': L.PAYLOAD_NOTICE,
}


def test_wrappers(spark):
    assert many(spark, L.strip_wrappers, list(WRAPPED)) == list(WRAPPED.values())
    assert many(spark, L.saved_option, ["[[IMAGE:a]]", "[IMAGE:b]", "a "]) == ["[[IMAGE:a]]", "", "a"]


def test_clean_question(spark):
    df = spark.createDataFrame([(1, "a<b>c</b> [IMAGE:1]", ["[[IMAGE:x]]", None, "true 1"], None, "```\nx\n```")], "id int, stem string, options array<string>, answer string, solution string")
    got = L.clean_question(df).first()
    assert (got["stem"], got["options"], got["answer"], got["solution"]) == ("ac", ["[[IMAGE:x]]", "", "1", ""], "", "x")


def test_display(spark):
    lines = ["角 \\frac{1}{2} 的", "$\\sin x$ 和 \\cos y", "Ａ.\\pi", "plain text", None, "π的"]
    df = L.display_formulas(spark.createDataFrame(list(enumerate(lines)), "i int, x string"), "x")
    got = [r["display"] for r in sorted(df.collect())]
    assert got == ["角 $\\frac{1}{2}$ 的", "$\\sin x$ 和 $\\cos y$", "A. $\\pi$", "plain text", "", "$\\pi$的"]


def test_split_options(spark):
    cases = ["求值 A. 1 B. 2 C. 3 D. 4", "求值\nＡ．甲\nＢ．乙", "A. 1 B. 2", "求值 A. 1", "求 A. x C. y B. z", None, "问 A. A B. B"]
    got = many(spark, O.split_options, cases)
    assert [g and (g["stem"], g["options"]) for g in got] == [("求值", ["1", "2", "3", "4"]), ("求值", ["甲", "乙", "", ""]), None, None, ("求", ["x C. y", "z", "", ""]), None, None]
    block = many(spark, O.block_options, ["q A. 1\nB、 2 B) 3", "q A. 1", None])
    assert [(b["stem"], b["options"], b["n"]) for b in block] == [("q", ["1", "3", "", ""], 2), ("q A. 1", [""] * 4, 0), ("", [""] * 4, 0)]


def test_stored_and_merged(spark):
    df = spark.createDataFrame([("q ", ["a", " ", "c"], "单选题"), ("q A. 1 B. 2", ["x", "y"], "解答题"), (None, None, None)], "s string, o array<string>, k string")
    got = df.select(O.with_options("s", "o", "k").alias("m"), O.stored_question("s", "k", "o").alias("t")).collect()
    assert [g["m"] for g in got] == ["q\n\nA. a\nC. c", "q A. 1 B. 2", ""]
    assert [(g["t"]["stem"], g["t"]["options"], g["t"]["kind"]) for g in got] == [("q ", ["a", " ", "c"], "单选题"), ("q", ["1", "2", "", ""], "单选题"), ("", [""] * 4, None)]


@pytest.mark.parametrize("function, text, want", [
    (O.strip_answer, "题 答案: AB 余 解析：因为", ("题", "AB", "因为")), (O.strip_answer, "题【答案】x=1\ny【详解】z", ("题", "x=1", "z")), (O.strip_answer, None, ("", "", "")), (O.strip_answer, "题 答案：", ("题 答案：", "", "")),
    (O.strip_block_answer, "题 答：1 解析：2", ("题", "1", "2")), (O.strip_block_answer, "题 解析：2 答案：1", ("题", "1", "2 答案：1")), (O.strip_block_answer, "题", ("题", None, None)),
])
def test_strip_answer(spark, function, text, want):
    got = many(spark, function, [text])[0]
    assert (got["stem"], got["answer"] or None, got["solution"] or None) == tuple(w if i == 0 else w or None for i, w in enumerate(want))


def test_small_rules(spark):
    assert many(spark, O.fatal_service_error, ["HTTP 429", "Billing off", "timeout", None]) == [True, True, False, False]
    df = spark.createDataFrame([("如图", None, "p"), ("a", ["扇形", "[[IMAGE:x]]"], "p"), (None, ["a"], "")], "s string, o array<string>, p string")
    got = df.select(O.figure_cue("s", "o").alias("f"), O.needs_option_repair("o", "p").alias("r")).collect()
    assert [(g["f"], g["r"]) for g in got] == [(True, True), (True, False), (False, False)]
    parts = many(spark, O.answer_sections, ["B\n参考解析： 因为", "B"])
    assert [(p["answer_part"], p["solution_part"]) for p in parts] == [("B", "因为"), ("B", "B")]
    assert many(spark, lambda c: F.size(O.media_tokens(c)), ["[[IMAGE:a]] [[FORMULA_IMAGE:b]]", None]) == [2, 0]


def test_formulas_are_listed_once_a_text(spark):
    rows = spark.createDataFrame([("a ﷐1﷑ b ﷐0﷑", ["x", "y"])], "t string, r array<string>").select(L._put_back(F.col("t"), F.reverse("r")).alias("t"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert rows.first()["t"] == "a x b y" and plan.index("reverse(") < plan.index("split(")  # outside the loop over the pieces
