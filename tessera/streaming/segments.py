"""Speech segments from per-window speech probabilities, per session.

Definition, in runs of windows that are all loud (probability above the threshold) or all quiet: a segment opens in the first
loud run of at least ``m`` windows since the last segment closed, and closes in the first later quiet run of at least
``s`` windows.  It starts at that loud run, or at the window before it if that is a quiet one without a segment, and ends
at the closing run's first window.  Windows that are missing from the table are passed over.  An interrupt is the first loud window of a segment, from its ``m``-th on, during a reply.

The batch form finds runs and segments with windows over the table (gaps and islands).  The streaming form keeps the current
run's length per session and reads what to do from a table of (state, window kind); windows that come early wait in the state.
With an event-time column, timers of the state pass over windows that stay away and end sessions that have gone quiet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 512

EVENT_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("seg_no", T.IntegerType()), T.StructField("start_seq", T.LongType()),
    T.StructField("end_seq", T.LongType()), T.StructField("n_windows", T.LongType()),
])


def windows_for(samples: int) -> int:
    """Windows that hold at least so many samples; one at least."""
    return max(1, -(-samples // WINDOW))


# ---- batch ------------------------------------------------------------------------------------------------------------


def speech_segments(chunks: DataFrame, thr: float = 0.5, min_speech: int = 2048, min_silence: int = 12800,
                    key: str = "session_id", seq: str = "seq", prob: str = "prob",
                    generating: str | None = None) -> DataFrame:
    """Events ``speech_end`` (first and last window of a closed segment) and ``interrupt``, natively."""
    m, s = windows_for(min_speech), windows_for(min_silence)
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = chunks.select(F.col(key).cast("long").alias("session_id"), F.col(seq).cast("long").alias("seq"), (F.col(prob) > thr).alias("loud"),
                         (F.col(generating) if generating else F.lit(False)).alias("reply"))
    rows = rows.withColumn("change", F.coalesce((F.lag("loud").over(order) != F.col("loud")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("place", F.row_number().over(order))  # of the same sort
    runs = rows.groupBy("session_id", "run").agg(F.first("loud").alias("loud"), F.min("seq").alias("first"), F.max("seq").alias("last"),
                                                 F.min("place").alias("place_1"), F.count("*").alias("n"))
    by_run = Window.partitionBy("session_id").orderBy("run")
    closing = ~F.col("loud") & (F.col("n") >= s)
    runs = (runs.withColumn("closing", closing)
            .withColumn("part", F.coalesce(F.sum(F.col("closing").cast("int")).over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("before_n", F.lag("n").over(by_run)).withColumn("before", F.lag("last").over(by_run)).withColumn("before_closing", F.lag("closing").over(by_run)))
    opening = F.col("loud") & (F.col("n") >= m)
    parts = runs.groupBy("session_id", "part").agg(
        F.min(F.when(opening, F.struct("first", "run", "before_n", "before", "before_closing"))).alias("open"),
        F.min(F.when(F.col("closing"), F.col("first"))).alias("end_seq"))
    by_part = Window.partitionBy("session_id").orderBy("part")
    parts = (parts.withColumn("closed_before", F.coalesce(F.lag(F.col("open").isNotNull()).over(by_part), F.lit(False)))
             .where(F.col("open").isNotNull()).withColumn("seg_no", (F.row_number().over(by_part) - 1).cast("int")))
    # the window before is spare unless there is none or the segment before closed on it
    spare = F.col("open.before_n").isNotNull() & ~(F.col("open.before_closing") & F.col("closed_before") & (F.col("open.before_n") <= s))
    parts = parts.withColumn("start_seq", F.when(spare, F.col("open.before")).otherwise(F.col("open.first")))
    ends = parts.where(F.col("end_seq").isNotNull()).select("session_id", F.lit("speech_end").alias("event"), "seg_no", "start_seq", "end_seq")
    out = ends
    if generating:
        loud = rows.where("loud and reply").join(runs.select("session_id", "run", "part", "place_1"), ["session_id", "run"])
        hits = (loud.join(parts.select("session_id", "part", "seg_no", F.col("open.run").alias("opened")), ["session_id", "part"])
                .where((F.col("run") > F.col("opened")) | ((F.col("run") == F.col("opened")) & (F.col("place") - F.col("place_1") + 1 >= m)))  # from the m-th on
                .groupBy("session_id", "seg_no").agg(F.min("seq").alias("at")))
        out = out.unionByName(hits.select("session_id", F.lit("interrupt").alias("event"), "seg_no", F.col("at").alias("start_seq"), F.col("at").alias("end_seq")))
    return out.withColumn("n_windows", F.col("end_seq") - F.col("start_seq") + 1)


# ---- stream -----------------------------------------------------------------------------------------------------------

# what a window does: (in a segment, loud) -> name of the rule
RULES = {(False, True): "grow", (False, False): "idle", (True, True): "speak", (True, False): "hush"}


class Segmenter:
    """One session: the current run's length and first window, the spare window and the open segment's start.  ``fields`` is all of it."""

    FIELDS = ("next_seq", "open", "loud_run", "quiet_run", "first", "spare", "start", "seg_no", "interrupted")

    def __init__(self, m: int, s: int, fields: tuple | None = None):
        self.m, self.s, self.events = m, s, []
        values = fields or (0, False, 0, 0, None, None, None, 0, False)
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    @property
    def fields(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def grow(self, seq: int) -> None:
        self.loud_run += 1
        if self.loud_run == 1:
            self.first = seq
        if self.loud_run == self.m:
            self.open, self.quiet_run, self.start = True, 0, self.first if self.spare is None else self.spare

    def idle(self, seq: int) -> None:
        self.loud_run, self.spare = 0, seq

    def speak(self, seq: int) -> None:
        self.quiet_run = 0

    def hush(self, seq: int) -> None:
        self.quiet_run += 1
        if self.quiet_run == 1:
            self.first = seq
        if self.quiet_run == self.s:
            self.events.append(("speech_end", self.seg_no, self.start, self.first))
            self.open, self.loud_run, self.spare, self.interrupted, self.seg_no = False, 0, None, False, self.seg_no + 1

    def push(self, seq: int, loud: bool, reply: bool) -> None:
        getattr(self, RULES[self.open, loud])(seq)
        if self.open and loud and reply and not self.interrupted:
            self.interrupted = True
            self.events.append(("interrupt", self.seg_no, seq, seq))
        self.next_seq = seq + 1

    def drain(self, pending: dict, skip_gap: bool = False) -> None:
        """Take waiting windows in order from ``next_seq``; ``skip_gap`` first jumps to the earliest of them (lost windows)."""
        if skip_gap and pending and self.next_seq not in pending:
            self.next_seq = min(pending)
        while self.next_seq in pending:
            self.push(self.next_seq, *pending.pop(self.next_seq)[:2])


STATE_SCHEMA = (
    "next_seq long, open boolean, loud_run long, quiet_run long, first long, spare long, start long, seg_no int, interrupted boolean, "
    "wait array<struct<seq: long, loud: boolean, reply: boolean, ms: long>>, last_ms long")


def _events(key, events: list) -> pd.DataFrame:
    rows = [(key, e, n, a, b, b - a + 1) for e, n, a, b in events]
    return pd.DataFrame(rows, columns=[f.name for f in EVENT_SCHEMA.fields])


def speech_segments_stream(chunks: DataFrame, thr: float = 0.5, min_speech: int = 2048, min_silence: int = 12800,
                           key: str = "session_id", seq: str = "seq", prob: str = "prob", generating: str | None = None,
                           at: str | None = None, patience_ms: int = 2_000, idle_ms: int = 30_000, late: str = "0 seconds") -> DataFrame:
    """Streaming form with keyed state; windows are taken in seq order from 0, later ones wait until the gap before them is filled.

    With ``at``, the windows' event time, a window waits for a gap until the watermark (``late`` behind the newest window) is
    ``patience_ms`` past it; then the missing windows count as lost and are passed over.  A session whose last window lies ``idle_ms``
    behind the watermark has ended, and its state is dropped.  Both run on the state's event-time timer, so they also
    fire for sessions that get no more windows, and after a restart.  Without ``at`` gaps are waited for without end.
    """
    m, s = windows_for(min_speech), windows_for(min_silence)
    n = len(Segmenter.FIELDS)
    clock = F.unix_millis(F.col(at)) if at else F.lit(0).cast("long")
    rows = (chunks.withWatermark(at, late) if at else chunks).select(
        key, F.col(seq).alias("seq"), (F.col(prob) > thr).alias("loud"), (F.col(generating) if generating else F.lit(False)).alias("reply"),
        clock.alias("ms"), *([at] if at else []))

    def fn(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        session = Segmenter(m, s, held[:n] if held else None)
        pending = {w[0]: (w[1], w[2], w[3]) for w in held[n]} if held else {}
        last = held[n + 1] if held else 0
        if not state.hasTimedOut:
            for frame in frames:
                for x, loud, reply, ms in zip(frame["seq"].tolist(), frame["loud"].tolist(), frame["reply"].tolist(), frame["ms"].tolist()):
                    if x >= session.next_seq:
                        pending[x] = (loud, reply, ms)
                    last = max(last, ms)
        session.drain(pending)
        mark = state.getCurrentWatermarkMs() if at else 0
        while at and pending and pending[min(pending)][2] + patience_ms <= mark:
            session.drain(pending, skip_gap=True)
        if at and not pending and last + idle_ms <= mark:
            state.remove()
        else:
            state.update(session.fields + ([(x, *pending[x]) for x in sorted(pending)], last))
            if at:
                state.setTimeoutTimestamp(max(mark + 1, pending[min(pending)][2] + patience_ms if pending else last + idle_ms))
        yield _events(int(k[0]), session.events)

    return rows.groupBy(key).applyInPandasWithState(fn, EVENT_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout" if at else "NoTimeout")
