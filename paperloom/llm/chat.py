"""Chat formatting with a template that is only ever called, never looked into.

A conversation's successive turn prefixes are rendered and consecutive outputs compared: what a prefix adds is the span
of its last turn. The place of the turn's text is found by rendering the prefix once more with a stand-in text. If a
longer prefix does not begin with the shorter one's output, the template rewrites history: this is reported, and every
text is then located in the full rendering instead.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT = "conv_id long, formatted string, turns array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewrites boolean"


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_template(messages: list[Message]) -> str:
    """Each turn is <s>[INST]role[/INST]text</s>; roles are percent-encoded, texts escaped."""
    return "".join(f"<s>[INST]{quote(role)}[/INST]{escape(text)}</s>" for role, text in messages)


def read_turns(formatted: str) -> Iterator[Message]:
    """The turns of what marked_template made."""
    for m in _TURN.finditer(formatted):
        yield unquote(m[1]), unescape(m[2])


def _stand_in(messages: list[Message]) -> str:
    used = set().union(*(set(t) | set(r) for r, t in messages))
    return next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in used)


def locate(messages: list[Message], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int] | None], bool]:
    """(full output, span of each turn, span of each turn's text, whether history was rewritten).

    Spans count code points of the full output. A text that the template leaves out has span None.
    """
    mark = _stand_in(messages) if messages else ""
    out, turns, texts, rewrites = template([]) if not messages else "", [], [], False
    for k, (role, _) in enumerate(messages):
        last, out = out, template(messages[: k + 1])
        start = len(last)
        if not out.startswith(last):
            rewrites, start = True, len(os.path.commonprefix([last, out]))
        turns.append((start, len(out)))
        texts.append(_text_span(messages[:k], role, [], mark, out, template))
    if rewrites:
        texts = [_text_span(messages[:k], role, messages[k + 1 :], mark, out, template) for k, (role, _) in enumerate(messages)]
        edges = [len(out) if s is None else s[0] for s in texts]
        turns = [(0 if k == 0 else min(edges[k], len(out)), edges[k + 1] if k + 1 < len(edges) else len(out)) for k in range(len(edges))]
    return out, turns, texts, rewrites


def _text_span(before: list[Message], role: str, after: list[Message], mark: str, out: str, template: Template) -> tuple[int, int] | None:
    probe = template([*before, (role, mark), *after])
    at = probe.find(mark)
    return None if at < 0 else (at, len(out) - (len(probe) - at - len(mark)))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Message]]]:
    """Rows come sorted by conversation and turn; a conversation may go over several batches."""
    held, messages = object(), []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != held:
                if messages:
                    yield held, messages
                held, messages = conv, []
            messages.append((role or "", text or ""))
    if messages:
        yield held, messages


def _format_batches(batches: Iterator[pa.RecordBatch], template: Template, roles: set[str]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for conv, messages in _conversations(batches):
        out, turns, texts, rewrites = locate(messages, template)
        loss = [s for s, (role, _) in zip(texts, messages, strict=True) if role in roles and s is not None]
        rows.append((conv, out, turns, loss, rewrites))
        size += len(out)
        if size > 1 << 22 or len(rows) >= 1000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    spans = lambda i: pa.array([[{"start": a, "end": b} for a, b in r[i]] for r in rows], pa.list_(_SPAN))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), spans(2), spans(3), pa.array([r[4] for r in rows], pa.bool_())],
        ["conv_id", "formatted", "turns", "loss", "rewrites"],
    )


def format_conversations(conversations: DataFrame, template: Template = marked_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, turns, loss, rewrites) per conversation of (conv_id, turn, role, text) rows.

    Turns are in the order of turn, then role, then text, nulls last; a null role or text is empty; rows without conv_id
    make one conversation; repeated rows are turns of their own. One conversation is rendered in one task, as its
    prefixes build on each other; conversations are spread by conv_id.
    """
    dealt = (
        conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    )
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda it: _format_batches(it, template, set(loss_roles)), _OUT)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns, masked, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in read_turns(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for s in loss:
                text = unescape(formatted[s["start"] : s["end"]])
                chars += len(text)
                masked.update(text.encode())
            rows.append((conv, n, turns.hexdigest(), chars, masked.hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations (made with marked_template) hold, read from the output alone."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
