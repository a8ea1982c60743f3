"""Chat formatting: whole conversations as one text each, assembled column-wise.

A turn is written as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a
line feed. Control strings inside roles and texts get one more backslash after their first
character than they had, which is undone exactly when reading back. A batch of turns becomes
five kinds of segments; their lengths give the offsets of every segment, and one pass of
index arithmetic copies them into one preallocated buffer, which is the data buffer of the
resulting Arrow text column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.text import table, utf8

START, LINE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
# Strings that chat templates give a meaning, by first character and rest.
_RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"
_CONTROL = rf"([<\[])(\\*)({_RESTS})"
_ESCAPED = re.compile(rf"([<\[]\\*)\\({_RESTS})".encode())
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
# Longer segments are copied as slices, since an index array takes eight bytes a byte.
_LONG = 1 << 16
# Bytes assembled at once; a longer conversation is assembled alone.
_BATCH_BYTES = 8_000_000


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=_CONTROL, replacement=r"\1\2\\\3")


def unescaped(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1\2", text) if b"\\" in text else text


def escaped_roles(roles: pa.Array) -> pa.Array:
    """Roles on one line: a backslash is doubled, a line feed becomes backslash n."""
    plain = pc.replace_substring(roles, pattern="\\", replacement="\\\\")
    return escaped(pc.replace_substring(plain, pattern="\n", replacement="\\n"))


def unescaped_role(role: bytes) -> bytes:
    return re.sub(rb"\\(\\|n)", lambda m: b"\n" if m[1] == b"n" else b"\\", unescaped(role))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts, from 0) and bytes of a text column without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn ends, and where its text begins and ends."""
    fixed = np.frombuffer(START + LINE + END, np.uint8)
    role_at, role_bytes = _bytes_of(roles)
    text_at, text_bytes = _bytes_of(texts)
    source = np.concatenate([fixed, role_bytes, text_bytes])
    n = len(role_at) - 1
    first = np.empty((n, 5), np.int64)
    length = np.empty((n, 5), np.int64)
    first[:, 0], length[:, 0] = 0, len(START)
    first[:, 1], length[:, 1] = len(fixed) + role_at[:-1], np.diff(role_at)
    first[:, 2], length[:, 2] = len(START), len(LINE)
    first[:, 3], length[:, 3] = len(fixed) + len(role_bytes) + text_at[:-1], np.diff(text_at)
    first[:, 4], length[:, 4] = len(START) + len(LINE), len(END)
    first, length = first.ravel(), length.ravel()
    stop = np.cumsum(length)
    begin = stop - length
    out = np.empty(int(stop[-1]) if n else 0, np.uint8)
    short = length <= _LONG
    for k in np.flatnonzero(~short):
        out[begin[k] : stop[k]] = source[first[k] : first[k] + length[k]]
    lengths = length[short]
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin[short], lengths) + within] = source[np.repeat(first[short], lengths) + within]
    return out, stop[4::5], begin[3::5], stop[3::5]


def _format(turns: pa.Table) -> pa.RecordBatch:
    """Whole conversations, turns in order, as one row each."""
    turns = turns.combine_chunks()
    ids = turns.column(0).combine_chunks() if turns.num_rows else pa.array([], turns.schema.types[0])
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    roles = pc.fill_null(turns.column(1).combine_chunks(), "")
    texts = pc.fill_null(turns.column(2).combine_chunks(), "")
    data, ends, text_begin, text_end = assemble(escaped_roles(roles), escaped(texts))
    tails = np.append(heads[1:], len(codes)) - 1
    offsets = np.concatenate([[0], ends[tails]])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a formatted conversation exceeds 2 GB")
    formatted = pa.Array.from_buffers(
        pa.string(), len(heads), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    )
    loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    conv = np.repeat(np.arange(len(heads)), tails - heads + 1)
    spans = pa.StructArray.from_arrays(
        [pa.array(text_begin[loss] - offsets[conv[loss]]), pa.array(text_end[loss] - offsets[conv[loss]])],
        ["start", "end"],
    )
    per_conv = np.concatenate([[0], np.cumsum(np.bincount(conv[loss], minlength=len(heads)))])
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(heads)),
            pa.array(tails - heads + 1, pa.int64()),
            formatted,
            pa.ListArray.from_arrays(pa.array(per_conv, pa.int32()), spans),
        ],
        ["conv_id", "n_turns", "formatted", "loss"],
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted turns regrouped so that no conversation is cut, about ``_BATCH_BYTES`` at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 1024)
            at += part.num_rows
            if held and size >= _BATCH_BYTES:
                # Close the batch at the first change of the conversation.
                last = held[-1].column(0)[-1].as_py()
                ids = part.column(0).to_pylist()
                cut = next((k for k, x in enumerate(ids) if x != last), len(ids))
                if cut:
                    held.append(part.slice(0, cut))
                if cut < len(ids):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    part = part.slice(cut)
                else:
                    size += part.nbytes
                    continue
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss``.

    Turns stand in order of ``turn`` (nulls first; ties by role, then text; repeated rows stay
    repeated). ``loss`` lists, as byte offsets ``[start, end)`` in ``formatted``, the text of
    each assistant turn; markers, roles and other turns carry no loss. A null role or text is
    empty; rows with a null ``conv_id`` form one conversation. Other columns are ignored; an
    empty table gives an empty result. A conversation is one value and so at most 2 GB.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = (
        conversations.select("conv_id", "role", "text", "turn")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .drop("turn")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turns in _whole(batches):
            yield _format(turns)

    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
    )


def parse_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn as they were before formatting."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what ``format_chat`` wrote, taken from its output alone."""
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column(2).to_pylist()
            for text, loss in zip(utf8(batch.column(1)), spans):
                turns, under = hashlib.sha256(), hashlib.sha256()
                parsed = parse_turns(text)
                for role, body in parsed:
                    turns.update(role + b"\n" + body + b"\n")
                chars = 0
                for span in loss:
                    body = unescaped(text[span["start"] : span["end"]])
                    under.update(body)
                    chars += len(body.decode())
                rows.append((len(parsed), turns.hexdigest(), chars, under.hexdigest(), len(text.decode())))
            cols = [list(c) for c in zip(*rows)] if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return chats.select("conv_id", "formatted", "loss").mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )


_PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    probe = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(-1).cast("bigint").alias("conv_id"),
                        F.lit(turn).cast("bigint").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(_PROBE).alias("text"),
                    )
                    for turn, role in enumerate(["user", "assistant"])
                ]
            )
        )
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(probe)))


_ESCAPE_SQL = (
    r"regexp_replace({0}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', "
    r"'\1\2\\\3', 'g')"
)
_ROLE_SQL = _ESCAPE_SQL.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START + LINE + END)} + length({_ROLE_SQL}) + length({_ESCAPE_SQL.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
