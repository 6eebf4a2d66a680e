"""Chat formatting with loss masks, for any template, by rendering prefixes.

A template is a black box: a function from messages to a string.  Where a turn lies in
its output is found by rendering the first 0, 1, 2, ... turns and comparing each output
with the one before:

* if it begins with the one before, the new turn's span is what has come on;
* if not, the template rewrites history (it drops or moves something of former turns).
  The output before is then closed as a training sample of its own, and a new sample
  begins, in which only the turns from here on are trained, so each text that is to be
  learned stands under the mask once.

Within the span, the text itself is found by rendering two more prefixes whose last text
is a single character, once one and once another: what they share at either end is
the template's.

Texts are escaped once, before rendering, so that no control string of the template
stands in them, and the escape can be undone: a control string gets a backslash after
its first character, one that has backslashes there already gets one more.

A conversation is rendered by one task, as its result is one row; rows come sorted, so a
task holds one conversation at a time.  Rendering all prefixes takes time in the square
of a conversation's turns (copying of memory: 0.1 s for 400 turns of 500 characters).

Defined results: a null role or text is empty, rows without a conv_id are left out, turns
go by number (null first), then role, then text; repeated rows are turns of their own;
a role that a template doesn't know is carried by name; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

Message = tuple[str, str]  # role, text


@dataclass(frozen=True)
class Template:
    """``render`` makes a string of messages whose texts and roles are escaped, ``read``
    gives the escaped messages of such a string back.  ``controls`` are its control
    strings; none may begin within another."""

    name: str
    controls: tuple[str, ...]
    render: Callable[[list[Message]], str]
    read: Callable[[str], list[Message]]

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        one = "|".join(f"{re.escape(c[0])}\\\\*(?={re.escape(c[1:])})" for c in self.controls)
        more = "|".join(f"{re.escape(c[0])}\\\\+(?={re.escape(c[1:])})" for c in self.controls)
        return re.compile(one), re.compile(more)

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._patterns[1].sub(lambda m: m[0][:-1], text)


def _render_inst(messages: list[Message]) -> str:
    parts = []
    for role, text in messages:
        if role == "user":
            parts += ["<s>[INST] ", text, " [/INST]"]
        elif role == "assistant":
            parts += [" ", text, " </s>"]
        else:
            parts += ["<s><<SYS>>", role, "<</SYS>>", text, "</s>"]
    return "".join(parts)


def _read_inst(text: str) -> list[Message]:
    out, at = [], 0
    while at < len(text):
        if text.startswith("<s>[INST] ", at):
            end = text.index("[/INST]", at)
            out.append(("user", text[at + 10 : end - 1]))
            at = end + 7
        elif text.startswith("<s><<SYS>>", at):
            mid = text.index("<</SYS>>", at)
            end = text.index("</s>", mid + 8)
            out.append((text[at + 10 : mid], text[mid + 8 : end]))
            at = end + 4
        else:
            end = text.index("</s>", at)
            out.append(("assistant", text[at + 1 : end - 1]))
            at = end + 4
    return out


INST = Template("inst", ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"), _render_inst, _read_inst)


def _render_marked(messages: list[Message]) -> str:
    return "".join(f"<|im_start|>{role}<|im_sep|>{text}<|im_end|>\n" for role, text in messages)


def _read_marked(text: str) -> list[Message]:
    return [tuple(x.removeprefix("<|im_start|>").split("<|im_sep|>", 1)) for x in text.split("<|im_end|>\n")[:-1]]


MARKED = Template("marked", ("<|im_start|>", "<|im_sep|>", "<|im_end|>"), _render_marked, _read_marked)


def shared_start(a: str, b: str, known: int = 0) -> int:
    """How many characters both begin with, at least ``known``."""
    low, high = known, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_end(a: str, b: str, most: int) -> int:
    low, high = 0, min(len(a), len(b), most)
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Sample:
    text: str
    turns: list[tuple[int, str, int, int]]  # number, role, begin, end of the turn's span
    loss: list[tuple[int, int]]


def _content(render: Callable[[list[Message]], str], before: list[Message], role: str, now: str, span: tuple[int, int]) -> tuple[int, int]:
    """Where the last text is in ``now``: what two other last texts leave in common."""
    one, other = render([*before, (role, "0")]), render([*before, (role, "1")])
    start = shared_start(one, other, span[0] if one[: span[0]] == other[: span[0]] else 0)
    end = shared_end(one, other, min(len(one), len(other)) - start)
    whole = now[:start] == one[:start] and now[len(now) - end :] == one[len(one) - end :] and start + end <= len(now)
    return (start, len(now) - end) if whole else span


def render_samples(render: Callable[[list[Message]], str], messages: list[Message], trained: frozenset[str]) -> list[Sample]:
    """The training samples of a conversation: one, and one more each time that the
    template rewrites history."""
    now = render([])
    out = [Sample(now, [], [])]
    for k, (role, _) in enumerate(messages):
        last, now = now, render(messages[: k + 1])
        start = len(last)
        if not now.startswith(last):
            start = shared_start(last, now)
            if out[-1].loss:
                out.append(Sample(now, [], []))
            else:
                out[-1].turns.clear()
        out[-1].text = now
        out[-1].turns.append((k, role, start, len(now)))
        if role in trained:
            out[-1].loss.append(_content(render, messages[:k], role, now, (start, len(now))))
    return out


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("sample", pa.int32()), ("n_samples", pa.int32()), ("text", pa.large_string()), ("turns", pa.list_(_TURN)), ("loss", pa.list_(_SPAN))])
FORMATTED = "conv_id long, sample int, n_samples int, text string, turns array<struct<turn: long, role: string, begin: long, end: long>>, loss array<struct<begin: long, end: long>>"

#: Characters of formatted texts that leave a task together.
OUT_CHARS = 1 << 22


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Message]]]:
    last, messages = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != last:
                if last is not None:
                    yield last, messages
                last, messages = conv, []
            messages.append((role, text))
    if last is not None:
        yield last, messages


def _format(batches: Iterator[pa.RecordBatch], template: Template, trained: frozenset[str]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for conv, messages in _conversations(batches):
        samples = render_samples(template.render, [(template.escape(r), template.escape(t)) for r, t in messages], trained)
        for i, s in enumerate(samples):
            turns = [{"turn": k, "role": messages[k][0], "begin": a, "end": b} for k, _, a, b in s.turns]
            rows.append({"conv_id": conv, "sample": i, "n_samples": len(samples), "text": s.text, "turns": turns, "loss": [{"begin": a, "end": b} for a, b in s.loss]})
            size += len(s.text)
        if size > OUT_CHARS or len(rows) > 512:
            yield pa.RecordBatch.from_pylist(rows, _FORMATTED)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _FORMATTED)


def format_conversations(convs: DataFrame, template: Template = INST, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, sample, n_samples, text, turns, loss`` of a table (conv_id, turn, role,
    text): spans in code points of ``text``, ends exclusive.  ``n_samples`` above 1 says
    that the template rewrites the history of this conversation."""
    prepare(convs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = convs.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    roles = frozenset(trained)
    return rows.mapInArrow(lambda b: _format(b, template, roles), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
            turns, learned, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, words in template.read(text):
                turns.update(f"{template.unescape(role)}\n{template.unescape(words)}\n".encode())
                n += 1
            for span in loss:
                own = template.unescape(text[span["begin"] : span["end"]])
                learned.update(own.encode())
                chars += len(own)
            out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Digests of what formatted samples say, a row for each."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "text", "loss").mapInArrow(lambda b: _read_back(b, template), schema)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(convs.unionByName(probe)))


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|<\\*</?SYS>>|\[\\*/?INST\]'))
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 22 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|<\\*</?SYS>>|\[\\*/?INST\]')) END AS chars
    FROM turns),
grouped AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM grouped
"""
