"""Chat formatting on token level.

A turn is ``### <role>:``, a new line, its text, a new line and ``</turn>``. The
markers are reserved ids behind the tokenizer's own and are spliced between the
separately encoded segments, so no text can produce one. In the rendered string
they read as above; control strings inside a role or text get one backslash more
in front, which reading back takes away. The loss mask comes from prefix sums of
the segments' lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rendered form of the reserved ids, in the order of their numbers.
MARKERS = ("### ", ":\n", "\n</turn>\n")
CONTROL = ("###", "</turn>")

_ESCAPE = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")
_UNESCAPE = re.compile(r"\\(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")


@dataclass(frozen=True)
class ChatParams:
    """``ranks`` is a tiktoken file, ``pattern`` its word pattern; ids from ``reserved`` on are free."""

    ranks: str
    pattern: str
    reserved: int = 50_300
    loss_role: str = "assistant"


def escape(text: str) -> str:
    """One backslash more before every control string, whatever stands before it."""
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def encoder(params: ChatParams):
    import tiktoken

    with open(params.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=params.pattern, mergeable_ranks=ranks,
                             special_tokens={})


def segments(role: str, text: str, encode, params: ChatParams) -> list[list[int]]:
    """The five segments of a turn; the fourth is the text."""
    mark = [[params.reserved + i] for i in range(len(MARKERS))]
    return [mark[0], encode(escape(role)), mark[1], encode(escape(text)), mark[2]]


def format_chats(rows: DataFrame, params: ChatParams) -> DataFrame:
    """One row per turn: conv_id, number (from 0), ids, loss_start, loss_end.

    Loss bounds are token places counted from the start of the conversation;
    they are equal where nothing is learnt. Rows go by turn, then role and text;
    repeated rows are turns of their own, null roles and texts are empty, a null
    conversation is one conversation. Conversations are read as a sorted stream,
    so a very long one needs no more memory than a short one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = (rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        encode = encoder(params).encode_ordinary
        conv, number, place = object(), 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                     batch.column(3).to_pylist()):
                if c != conv:
                    conv, number, place = c, 0, 0
                parts = segments(role or "", text or "", encode, params)
                ends = place + np.cumsum([len(x) for x in parts])
                learnt = (ends[2], ends[3]) if role == params.loss_role else (ends[2], ends[2])
                out.append((c, number, [i for x in parts for i in x], *map(int, learnt)))
                number, place = number + 1, int(ends[-1])
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.int64()),
                     pa.array(cols[4], pa.int64())],
                    names=["conv_id", "number", "ids", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, f"conv_id {kind}, number bigint, ids array<int>, "
                                   "loss_start bigint, loss_end bigint")


class Reader:
    """Reads one conversation back from its ids and loss bounds, turn by turn."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars, self.place = 0, 0, 0, 0

    def turn(self, ids: list[int], loss: tuple[int, int], decode, params: ChatParams) -> None:
        at = [k for k, i in enumerate(ids) if i >= params.reserved]
        if [ids[k] - params.reserved for k in at] != list(range(len(MARKERS))):
            raise ValueError("a turn does not have its markers")
        role, text = decode(ids[at[0] + 1:at[1]]), decode(ids[at[1] + 1:at[2]])
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.n += 1
        self.chars += len(role) + len(text) + sum(map(len, MARKERS))
        learnt = ids[loss[0] - self.place:loss[1] - self.place]
        if learnt:
            said = unescape(decode(learnt))
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.place += len(ids)

    def row(self, conv) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars)


def digest(turns: DataFrame, params: ChatParams) -> DataFrame:
    """Contract columns, read back from the output of :func:`format_chats`."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        table = encoder(params)

        def decode(ids):
            return table.decode_bytes(ids).decode()

        conv, reader, kind_arrow = object(), None, None

        def pack(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in done], t) for k, t in enumerate(
                    (kind_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=names)

        for batch in batches:
            done, kind_arrow = [], batch.schema.field(0).type
            for c, ids, a, b in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)]):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append(reader.row(conv))
                    conv, reader = c, Reader()
                reader.turn(ids, (a, b), decode, params)
            if done:
                yield pack(done)
        if reader is not None:
            yield pack([reader.row(conv)])

    return turns.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, "
                                 "loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def render(ids: list[int], decode, params: ChatParams) -> str:
    """The formatted string of some ids."""
    out, run = [], []
    for i in [*ids, params.reserved]:
        if i >= params.reserved:
            out.append(decode(run))
            out.append(MARKERS[i - params.reserved])
            run = []
        else:
            run.append(i)
    return "".join(out[:-1])
