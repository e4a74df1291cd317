r"""Event-sourced chat formatting: fold a log of messages' events, render turns, mask the assistant's text.

Template of a turn: `### <role>: <text> </turn>` and a line feed. Inside roles and texts a backslash is doubled and
`###`, `</turn>` and, in roles, `:` get a backslash before them, so control strings can't be forged and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow, slices

EVENTS = "conv_id long, turn long, message long, seq long, kind string, role string, text string"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and where its text stands in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or m[2][-1:] != " ":
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def fold(events: list[tuple[int, str, str | None, str | None]], cut: int | None) -> tuple[str, str] | None:
    """A message's role and final text from its events (seq, kind, role, text) in order, without those before cut.

    start sets the role, delta appends, edit replaces the text, regenerate empties it. None if nothing is left.
    """
    role, parts, alive = "", [], False
    for seq, kind, who, text in events:
        role = who if who is not None else role  # what is made anew keeps its role
        if cut is not None and seq < cut:
            continue
        alive = True
        if kind in ("edit", "regenerate"):
            parts = []
        if kind in ("delta", "edit") and text:
            parts.append(text)
    return (role, "".join(parts)) if alive else None


def format_events(events: DataFrame, chunk_chars: int = 1 << 16) -> DataFrame:
    """(conv_id, chunk, formatted, loss): each conversation's turns in order, cut between turns into chunks.

    loss holds (start, end) of the assistant's texts in the chunk. A regeneration of a turn also drops what later turns
    had before it. The log is dealt once by conversation and read as a stream: a task holds one message and one chunk,
    however long a conversation is. A conversation's chunks come one after another, in order, in one partition. Edge
    cases: events with null text add nothing, a null role is the empty role; null conv_ids are one conversation;
    messages of one turn keep the order of their numbers; other columns are ignored; no events, no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    order = ["conv_id", "turn", "message", "seq"]
    dealt = events.select(*order, "kind", "role", "text").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        conv, cut, chunk, parts, loss, size = None, None, 0, [], [], 0
        key, own, begun = None, [], False
        ready: list = []

        def flush():
            nonlocal chunk, parts, loss, size
            if parts:
                ready.append((conv, chunk, "".join(parts), loss))
                chunk, parts, loss, size = chunk + 1, [], [], 0

        def close():
            """Fold the message that has ended and render it."""
            nonlocal cut, size
            again = max((e[0] for e in own if e[1] == "regenerate"), default=None)
            if again is not None:
                cut = again if cut is None else max(cut, again)
            done = fold(own, cut)
            if done is not None:
                text, lo, hi = render(*done)
                if done[0] == "assistant":
                    loss.append({"start": size + lo, "end": size + hi})
                parts.append(text)
                size += len(text)
                if size >= chunk_chars:
                    flush()

        for b in slices(batches, "text", 2 << 20):
            for c, turn, message, *event in zip(*(b.column(k).to_pylist() for k in (*order[:3], "seq", "kind", "role", "text")), strict=True):
                if begun and (c, turn, message) != key:
                    close()
                    own = []
                    if c != conv:
                        flush()
                        conv, cut, chunk = c, None, 0
                if not begun:
                    conv, begun = c, True
                key = (c, turn, message)
                own.append(event)
            if ready:
                yield batch_of(schema, *zip(*ready, strict=True))
                ready = []
        if begun:
            close()
            flush()
        if ready:
            yield batch_of(schema, *zip(*ready, strict=True))

    return map_arrow(dealt, run, "conv_id long, chunk long, formatted string, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from format_events' rows alone, as a stream over their order; no shuffle."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        state = None
        out: list = []
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for b in slices(batches, "formatted", 2 << 20):
            for conv, chunk, text, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "chunk", "formatted", "loss")), strict=True):
                if chunk == 0:
                    if state:
                        out.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for span in loss:
                    own = unescape(text[span["start"] : span["end"]])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(text)
            if out:
                yield batch_of(schema, *zip(*out, strict=True))
                out = []
        if state:
            yield batch_of(schema, *zip(close(state), strict=False))

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """A log for finished turns (conv_id, turn, role, text): started, then streamed in two deltas; every third turn is a
    draft that is edited, every other third one that is regenerated."""
    seq = lambda k: (F.coalesce("turn", F.lit(0)) * 8 + k).alias("seq")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda k, kind, t=None: F.struct(seq(k), F.lit(kind).alias("kind"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), (F.lit(None).cast("string") if t is None else t).alias("text"))
    start, draft = event(0, "start"), event(1, "delta", F.lit("a draft"))
    deltas = [event(3, "delta", F.substring(text, F.lit(1), half)), event(4, "delta", F.substring(text, half + 1, F.length(text)))]
    kind = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    log = F.when(kind == 0, F.array(start, *deltas)).when(kind == 1, F.array(start, draft, event(2, "edit", text))).otherwise(F.array(start, draft, event(2, "regenerate"), *deltas))
    rows = conversations.withColumn("message", F.monotonically_increasing_id())
    return rows.select("conv_id", "turn", "message", F.explode(log).alias("e")).select("conv_id", "turn", "message", "e.*")
