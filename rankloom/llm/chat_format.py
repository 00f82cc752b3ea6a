"""Chat formatting with a compiled template.

Turns are sorted within their conversation and rendered in parts of
``PART_TURNS`` turn numbers, so that a very long conversation is the work of
many tasks. The template (`template`) marks what the assistant writes; the
spans of those marks are the loss mask.

Control strings inside texts are escaped with backslashes: a run of
backslashes before a control string, or at the end of a text, is doubled, and
a control string gets one more. Reading back: an odd run means a quoted
control string, an even run a real one.

Defined results: null texts and roles are empty; turns of equal number are
ordered by role, then text (null first); null conversation ids are one
conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.template import compile_template

PART_TURNS = 256
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]")
TEMPLATE = """
{%- if start %}{{ '<s>' }}{% endif %}
{%- for m in messages %}
{%- if m.role == 'user' %}{{ '[INST]' + ' ' }}{{ m.text | escape }}{{ ' [/INST]' }}
{%- elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- elif m.role == 'system' %}{{ '[SYS] ' }}{{ m.text | escape }}{{ ' [/SYS]' }}
{%- else %}{{ '[ROLE]' }}{{ m.role | escape }}{{ '[TEXT]' }}{{ m.text | escape }}{{ '[/ROLE]' }}
{%- endif %}
{%- endfor -%}
"""
_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_CONTROL}|\Z)")
_QUOTED = re.compile(rf"(\\+)({_CONTROL}|\Z)")
_MARK = re.compile(rf"(\\*)({_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    """Undo ``escape`` on one whole escaped text."""
    return _QUOTED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation or part."""
    out, role, start = [], None, 0
    for m in _MARK.finditer(text):
        if len(m[1]) % 2:
            continue
        mark, body = m[2], text[start:m.end(1)]
        if mark == "</s>":
            out.append(("assistant", unescape(body)))
        elif mark in ("[/INST]", "[/SYS]"):
            out.append(("user" if mark == "[/INST]" else "system", unescape(body[1:-1])))
        elif mark == "[TEXT]":
            role = unescape(body)
        elif mark == "[/ROLE]":
            out.append((role, unescape(body)))
        start = m.end()
    return out


def _render(template: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        key, messages, start = None, [], False
        rows: list = []

        def close():
            text, spans = render(messages=messages, start=start)
            rows.append((*key, text, [{"start": a, "end": b} for a, b in spans]))

        def batch():
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "text", "spans"])
        for b in batches:
            for conv, part, first, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "first", "role", "text"))):
                if key != (conv, part):
                    if key is not None:
                        close()
                    key, messages, start = (conv, part), [], part == first
                messages.append({"role": role or "", "text": text or ""})
            if rows:
                yield batch()
        if key is not None:
            close()
        if rows:
            yield batch()
    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, text, spans`` of all conversations (rows ``conv_id,
    turn, role, text``). Parts joined in order are the formatted conversation;
    spans are code points within the part."""
    common.prepare(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("part", F.floor(F.coalesce("turn", F.lit(-1)) / part_turns).cast("long"))
    first = t.groupBy("conv_id").agg(F.min("part").alias("first")).withColumnRenamed("conv_id", "_c")
    first = common.materialize(first, "first")
    both = t.join(first, t["conv_id"].eqNullSafe(F.col("_c")))
    return both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text") \
        .mapInArrow(_render(template), "conv_id long, part long, text string, spans array<struct<start:long,end:long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, state, rows, began = None, None, [], False

    def batch():
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        rows.clear()
        return out

    def close():
        n, turns, loss_n, loss, size = state
        rows.append((key, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
    for b in batches:
        for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "spans"))):
            if not began or conv != key:
                if began:
                    close()
                began, key, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_back(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s in spans:
                said = unescape(text[s["start"]:s["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if rows:
            yield batch()
    if began:
        close()
        yield batch()


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted
    and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    done = format_conversations(rows.unionByName(extra))
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
