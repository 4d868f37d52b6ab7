r"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are context
and only its text lies under the loss mask. Turns after the last assistant turn (or a
conversation without one) make one more example without a mask, so no turn is lost.

Template: ``[INST] user[/INST]``, ``<<SYS>> system<</SYS>>``, `` assistant</s>`` and
``[ROLE name] other[/ROLE]``, after a leading ``<s>``. In texts and role names every
backslash, ``[``, ``]`` and ``<`` gets a backslash before it, so no control string can come
from a text, and removing those backslashes gives the text back.

Defined results: rows of one conv_id are ordered by (turn, role, text), nulls first;
repeated rows stay; a null text or role is empty; a null conv_id is a conversation of
its own; an empty table gives an empty table. The rows of one conversation are held
together, as each example contains all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLE = "conv_id long, example int, text string, mask_start long, mask_end long"
#: Text rows are flushed to Spark when they reach about this many characters.
FLUSH = 4 << 20

_MARKS = {"user": ("[INST] ", "[/INST]"), "system": ("<<SYS>> ", "<</SYS>>"), "assistant": (" ", "</s>")}
_RUN = r"((?:[^\\\[<]++|\\.)*+)"
_TURN = re.compile(rf"\[INST\] {_RUN}\[/INST\]|<<SYS>> {_RUN}<</SYS>>| {_RUN}</s>|\[ROLE ((?:[^\\\[<\]]++|\\.)*+)\] {_RUN}\[/ROLE\]", re.S)


def escape(text: str) -> str:
    return re.sub(r"([\\\[<\]])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, str, str]:
    """Opening mark, escaped text, closing mark."""
    opening, closing = _MARKS.get(role) or (f"[ROLE {escape(role)}] ", "[/ROLE]")
    return opening, escape(text), closing


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int | None, int | None]]:
    """(formatted text, mask start, mask end) of each example, in order of the target turns."""
    context, used = "<s>", 0
    for at, (role, text) in enumerate(turns):
        opening, body, closing = render(role, text)
        if role == "assistant":
            start = len(context) + len(opening)
            yield context + opening + body + closing, start, start + len(body)
            used = at + 1
        context += opening + body + closing
    if used < len(turns):
        yield context, None, None


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    if not text.startswith("<s>"):
        raise ValueError("not a formatted example")
    at, turns = 3, []
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, system, assistant, role, other = m.groups()
        turns.append(("user", user) if user is not None else ("system", system) if system is not None else ("assistant", assistant) if assistant is not None else (unescape(role), other))
        at = m.end()
    return [(role, unescape(body)) for role, body in turns]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, conv in enumerate(ids):
            turns = [(x["role"] or "", x["text"] or "") for x in batch.column(1)[i].as_py()]
            for n, (text, start, end) in enumerate(expand(turns)):
                rows.append((conv, n, text, start, end))
                held += len(text)
                if held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, mask_start, mask_end (code points; null without a mask). Examples of a conversation follow each other."""
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.mapInArrow(_examples, EXAMPLE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])

    def finished() -> tuple:
        turns = parse(last)
        everything = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "surrogatepass"))
        return conv, len(turns), everything.hexdigest(), loss_chars, loss.hexdigest(), chars, count

    conv = last = loss = None
    loss_chars = chars = count = 0
    for batch in batches:
        rows = []
        for c, n, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if n == 0:
                if last is not None:
                    rows.append(finished())
                conv, loss, loss_chars, chars, count = c, hashlib.sha256(), 0, 0, 0
            last = text  # the last example holds all turns
            chars, count = chars + len(text), count + 1
            if start is not None:
                target = unescape(text[start:end])
                loss.update(target.encode("utf-8", "surrogatepass"))
                loss_chars += len(target)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(finished(), schema, strict=True)], schema=schema)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted examples alone, in the partitions they were made in."""
    return examples.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


#: The conversation that the contract adds to the table.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))
