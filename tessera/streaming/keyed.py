"""Ordered folds over keyed streams: the incremental forms of X3 - X6 and P12.

A fold takes a key's rows one at a time in order of a number that runs from 0, holds a small state between them, and gives out
rows as it goes; at the row marked as the key's last it may give out more, and its state is dropped.  Rows may arrive in any
order and in any micro-batch: those that come early wait in the state until the rows before them have come.  What is given out
depends on the rows alone, not on how they were cut into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import ADDED_TOKENS, ID_TO_BYTE
from tessera.streaming.text import CLOSE_TAG, outside_reasoning, tool_call_bodies, token_bytes

STATE = "next_seq long, held string, waiting array<struct<seq: long, cells: string, last: boolean>>"


class Fold:
    """``state`` (JSON values) is all that is kept between rows.  ``push`` takes a row's number and cells."""

    OUT = ""
    START: dict = {}

    def __init__(self, state: dict | None = None):
        self.state = dict(self.START) if state is None else state

    def push(self, seq: int, *cells) -> Iterator[tuple]:
        raise NotImplementedError

    def finish(self, seq: int) -> Iterator[tuple]:
        return iter(())


def fold_rows(fold: Fold, rows) -> list[tuple]:
    """All a fold gives out for a whole key, ``rows`` being (seq, *cells) in order."""
    out, seq = [], -1
    for seq, *cells in rows:
        out += fold.push(seq, *cells)
    return out + list(fold.finish(seq))


def fold_stream(rows: DataFrame, make: Callable[[dict | None], Fold], out: str, key: str, seq: str, cells: list[str], last: str) -> DataFrame:
    """(key, columns of ``out``) given out by a fold per ``key``; ``last`` marks the row that ends a key."""
    names = [key, *(c.split()[0] for c in out.split(", "))]
    kind = rows.schema[key].dataType.simpleString()

    def fn(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, held, waiting = tuple(state.get) if state.exists else (0, None, [])
        fold = make(json.loads(held) if held is not None else None)
        pending = {w[0]: (json.loads(w[1]), w[2]) for w in waiting}
        for frame in frames:
            for number, end, *values in zip(frame[seq].tolist(), frame[last].tolist(), *(frame[c].tolist() for c in cells)):
                if number >= following:
                    pending[number] = (values, end)
        given, ended = [], False
        while following in pending and not ended:
            values, ended = pending.pop(following)
            given += fold.push(following, *values)
            following += 1
        if ended:
            given += fold.finish(following - 1)
            state.remove()
        else:
            state.update((following, json.dumps(fold.state), [(n, json.dumps(v), e) for n, (v, e) in sorted(pending.items())]))
        if given:   # a frame by columns is made several times faster than one by rows
            yield pd.DataFrame(dict(zip(names, ([k[0]] * len(given), *map(list, zip(*given))))))

    return rows.select(key, F.col(seq).cast("long").alias(seq), *cells, last).groupBy(key).applyInPandasWithState(
        fn, f"{key} {kind}, {out}", STATE, "append", "NoTimeout")


#: Text of each token that is whole characters by itself.
WHOLE = {**dict(enumerate(ADDED_TOKENS)), **{i: chr(b) for i, b in ID_TO_BYTE.items() if b < 128}}


class Decode(Fold):
    """Bytes wait until they are whole characters; then they go out as text, with the places of their first and last token."""

    OUT = "piece_no int, first_pos long, last_pos long, text string"
    START = {"bytes": "", "first": None, "piece": 0}

    def push(self, seq: int, token: int) -> tuple:
        state = self.state
        if not state["bytes"] and token in WHOLE:   # the usual token: whole characters by itself
            state["piece"] += 1
            return (state["piece"] - 1, seq, seq, WHOLE[token]),
        raw = bytes.fromhex(state["bytes"]) + token_bytes(int(token))
        first = seq if state["first"] is None else state["first"]
        text = raw.decode("utf-8", errors="replace")
        if text and "�" not in text:
            self.state = {"bytes": "", "first": None, "piece": state["piece"] + 1}
            return (state["piece"], first, seq, text),
        self.state = {**state, "bytes": raw.hex(), "first": first}
        return ()


class SplitDelta(Fold):
    """Reasoning up to the close tag, then content.  ``seen`` is the text so far, ``sent`` how much of it went out; the tag may
    be spread over deltas, so it is looked for from just before the delta on."""

    OUT = "seq long, kind string, text string"
    START = {"seen": "", "sent": 0, "reasoning": True}

    def push(self, seq: int, delta: str) -> Iterator[tuple]:
        seen, sent = self.state["seen"] + delta, self.state["sent"]
        reasoning = self.state["reasoning"]
        tag = seen.find(CLOSE_TAG, max(0, len(seen) - len(delta) - len(CLOSE_TAG) + 1)) if reasoning else -1
        if tag >= 0:
            if sent < tag:
                yield seq, "reasoning", seen[sent:tag]
            reasoning, sent = False, tag + len(CLOSE_TAG)
            sent = len(seen) - len(seen[sent:].lstrip("\n"))
        if sent < len(seen):
            yield seq, "reasoning" if reasoning else "content", seen[sent:]
        self.state = {"seen": seen, "sent": len(seen), "reasoning": reasoning}

    def finish(self, seq: int) -> Iterator[tuple]:
        calls = tool_call_bodies(outside_reasoning(self.state["seen"]))
        yield from ((max(seq, 0), "tool_call", c) for c in calls)
        yield max(seq, 0), "finish", "tool_calls" if calls else "stop"


def overlapping(size: int, overlap: int) -> type[Fold]:
    """Every ``size`` frames go out with up to ``overlap`` frames before them (``trim``); the rest goes out at the end."""
    class Overlapping(Fold):
        OUT = "chunk_no int, start_seq long, end_seq long, trim int, frames array<string>"
        START = {"tail": [], "count": 0}

        def chunk(self, length: int) -> tuple:
            n, tail = self.state["count"], self.state["tail"]
            trim = min(overlap, n - length)
            return -(-n // size), n - length - trim, n - 1, trim, tail[len(tail) - length - trim:]

        def push(self, seq: int, frame: str) -> Iterator[tuple]:
            self.state = {"tail": [*self.state["tail"], frame][-(size + overlap):], "count": self.state["count"] + 1}
            if self.state["count"] % size == 0:
                yield self.chunk(size)

        def finish(self, seq: int) -> Iterator[tuple]:
            if self.state["count"] % size:
                yield self.chunk(self.state["count"] % size)

    return Overlapping


def history(n: int) -> type[Fold]:
    """Each message with the ``n`` messages before it; 0 keeps none."""
    class History(Fold):
        OUT = "turn long, role string, text string, history array<struct<role:string,text:string>>"
        START = {"kept": []}

        def push(self, seq: int, role: str, text: str) -> Iterator[tuple]:
            kept = self.state["kept"]
            yield seq, role, text, [tuple(m) for m in kept]
            self.state = {"kept": [*kept, [role, text]][-n:] if n else []}

    return History


def stream_of(rows: DataFrame, fold: type[Fold], key: str, seq: str, cells: list[str], last: str) -> DataFrame:
    return fold_stream(rows, fold, fold.OUT, key, seq, cells, last)
