import hashlib

import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import chat  # noqa: E402

SAID = "</s>[INST] ok [/INST]"


def test_escape_is_reversible_and_hides_control_strings():
    for text in ["", SAID, "\\", "\\\\</s>", "<s", "<<s>>", "[[INST]]", "a\\[/INST]\n", "<\\s>", "[INST" + "]" * 3]:
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_round_trip_and_loss_mask(spark):
    rows = [
        (2, 1, "assistant", "b\n<s>"), (2, 0, "user", SAID), (2, 2, "assistant", None), (2, 3, None, "x"), (3, 0, "sys[INST]\ntem", ""),
        (None, 0, "assistant", "\\none"), (4, None, "user", "last"), (4, 1, "user", "same"), (4, 1, "user", "same"), (-1, 0, "user", SAID), (-1, 1, "assistant", SAID),
    ]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "conv_id long, turn long, role string, text string, formatted double")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    whole = {r["conv_id"]: r for r in formatted.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2] is None, t[2] or "", t[3] or ""))
        said = [(t[2] or "", t[3] or "") for t in turns]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        masked = "".join(b for a, b in said if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        text = whole[conv]["formatted"]
        assert r["formatted_chars"] == len(text) and text == chat.marked_template(said)
        assert "".join(text[s["start"] : s["end"]] for s in whole[conv]["turns"]) == text and not whole[conv]["rewrites"]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_template_that_rewrites_history_is_found():
    def forgetful(messages):
        return "".join(f"<{r}>{t if k == len(messages) - 1 or r == 'user' else t.split('|')[-1]}" for k, (r, t) in enumerate(messages))

    talk = [("user", "hi"), ("assistant", "think|yes"), ("user", "more"), ("assistant", "hm|no")]
    out, _, texts, rewrites = chat.locate(talk, forgetful)
    assert rewrites and out == "<user>hi<assistant>yes<user>more<assistant>hm|no"
    assert [out[a:b] for a, b in texts] == ["hi", "yes", "more", "hm|no"]
    out, turns, texts, rewrites = chat.locate(talk, lambda m: "BOS" + "".join(f"[{r}]{t};" for r, t in m))
    assert not rewrites and [out[a:b] for a, b in texts] == [t for _, t in talk]
    assert [out[a:b] for a, b in turns][1] == "[assistant]think|yes;"
    assert chat.locate(talk, lambda m: "".join(t for r, t in m if r == "user"))[2][1] is None
