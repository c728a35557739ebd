"""Chat formatting by columnar byte assembly.

Turns of a conversation become ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns the
lengths of all segments give cumulative offsets, the offsets give scatter indices, and headers and
contents are copied into one preallocated buffer that becomes the Arrow column.

Escaping is reversible: between ``<`` and ``|`` one backslash is added to however many stand there,
so no control string remains inside a text, and taking one away restores it. Roles are escaped
likewise, and their backslashes and line feeds as ``\\\\`` and ``\\n``.

Defined results: rows are ordered by turn (null first), then role, then text, so ties and repeated
rows are kept in a fixed order; null role or text is empty; rows with null conv_id form one
conversation; an empty table gives no row; other columns are ignored. A conversation is one value,
so it must fit a task's memory; batches of turns are otherwise streamed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidied
from .text import raw_bytes, string_column

START, END = "<|im_start|>", "<|im_end|>"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(roles, pattern="\\", replacement="\\\\")
    return escape(pc.replace_substring(roles, pattern="\n", replacement="\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``out`` from ``at[i]``, all segments at once."""
    size = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], size) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, each turn's offset (n + 1), and where its content starts and stops."""
    role, role_at = raw_bytes(escape_role(roles))
    text, text_at = raw_bytes(escape(texts))
    head, tail = np.frombuffer(START.encode(), np.uint8), np.frombuffer((END + "\n").encode(), np.uint8)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    offsets = np.concatenate(([0], np.cumsum(len(head) + n_role + 1 + n_text + len(tail))))
    out = np.empty(offsets[-1], dtype=np.uint8)
    at_role = offsets[:-1] + len(head)
    at_text = at_role + n_role + 1
    at_tail = at_text + n_text
    out[offsets[:-1, None] + np.arange(len(head))] = head
    _scatter(out, at_role, role, role_at)
    out[at_text - 1] = 10
    _scatter(out, at_text, text, text_at)
    out[at_tail[:, None] + np.arange(len(tail))] = tail
    return out, offsets, at_text, at_tail


def _format(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, rows in order, to one row each."""
    conv = table.column("conv_id").combine_chunks()
    roles, texts = (table.column(c).combine_chunks().fill_null("") for c in ("role", "text"))
    key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
    out, offsets, start, stop = assemble(roles, texts)
    bounds = np.append(new, len(key))
    formatted = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offsets[bounds].astype(np.int64)), pa.py_buffer(out))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
    asked = np.flatnonzero(np.asarray(pc.equal(roles, "assistant")))
    owner = np.searchsorted(new, asked, side="right") - 1
    base = points[offsets[bounds[:-1]]][owner]
    spans = pa.StructArray.from_arrays([pa.array(points[start[asked]] - base), pa.array(points[stop[asked]] - base)], names=["start", "stop"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(new) + 1)).astype(np.int32)), spans)
    if len(out) < 1 << 31:
        formatted = formatted.cast(pa.string())
    return pa.record_batch([conv.take(pa.array(new)), pa.array(np.diff(bounds)), formatted, lists], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, conversations out; the last conversation of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.record_batch([batch.column(0), string_column(batch, "role"), string_column(batch, "text")], names=["conv_id", "role", "text"])
        conv = batch.column(0)
        last = conv[len(conv) - 1]
        other = np.flatnonzero(~np.asarray(conv.is_null() if not last.is_valid else pc.fill_null(pc.equal(conv, last), False)))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and held[-1].column(0)[0] != last and held[-1].column(0)[0].as_py() != last.as_py()):
            ready = [*held, batch.slice(0, cut)] if cut else held
            yield _format(pa.Table.from_batches(ready))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _format(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans``; spans count code points of the formatted text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(format_batches, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, unescaped."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return out


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted output says: its turns, and the text under its loss mask."""

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = parse(text)
                own = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(own), hashlib.sha256(own.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return formatted.select("conv_id", "n_turns", "formatted", "loss_spans").mapInArrow(read, DIGEST)


def oracle_sql(hostile: str) -> str:
    """The digests told from the table itself; formatted lengths from the template and the number of escapes."""
    return rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{hostile}' union all select -1, 1, 'assistant', '{hostile}'),
t as (
  select *, length('{START}{END}') + 2 + length(text) + len(regexp_extract_all(text, '<\\*\|'))
            + length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\|')) as chars from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from t group by conv_id
"""
