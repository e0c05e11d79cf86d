"""K4 and K5 on event time: messages put in order, kept as list and map state, closed by timers.

Both operators are ``transformWithState`` processors keyed by conversation.  A
message waits in a list state until the watermark (the newest event time of
earlier micro-batches less ``lateness_seconds``) has reached it, so a message
late within the lateness takes its place in the order; one older than the
watermark is dropped by Spark and counted in the query's progress
(``numRowsDroppedByWatermark``).  A timer at the oldest waiting message wakes the
conversation; what the watermark has reached is then taken in the order of (event
time, turn, role, text).

* ``ordered_history`` (K4): a row for every user message with the ``n`` messages
  before it.  The last ``n`` messages are a list state; a conversation idle for
  ``idle_seconds`` is forgotten.
* ``live_summaries`` (K5): a row for every session when it goes idle: exchanges
  and topics as in ``session_insights``.  Words are a map state in the state
  store; none but the waiting messages and, when a session closes, one pass over
  its words go through a task's memory.
"""

from __future__ import annotations

import heapq
from contextlib import contextmanager
from typing import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexicons as L
from ..functions.text import words
from ..session import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "ts long, turn long, role string, text string, words array<string>"
HISTORY = "conv_id long, turn long, history_size int, history_text string"
SUMMARY = "conv_id long, session_start_us long, session_end_us long, total_exchanges long, common_topics string"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """List and map state need this state store; for queries that start and end inside, the session's setting comes back after."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STORE)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def _place(m: tuple) -> tuple:
    ts, turn, role, text = m[:4]
    return ts, turn is None, turn or 0, role or "", text or ""


class _InOrder(StatefulProcessor):
    """Messages of a key handed to ``take`` in order; ``idle`` is called once the watermark is ``idle_ms`` past the last."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.last = handle.getValueState("last", "ts long")  # microseconds of the last message taken
        self.more_state(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.appendValue((r["ts_us"], r["turn"], r["role"], r["text"], r["words"]))
            first = r["ts_us"] if first is None else min(first, r["ts_us"])
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for m in self.waiting.get():
            (ready if m[0] <= 1000 * now else later).append(tuple(m))
        ready.sort(key=_place)
        for m in ready:
            last = self.last.get()[0] if self.last.exists() else None
            if last is not None and m[0] - last >= 1000 * self.idle_ms:
                yield from self.idle(key)
            yield from self.take(key, m)
            self.last.update((m[0],))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(min(m[0] for m in later) // 1000, now + 1))
        else:
            self.waiting.clear()
        if self.last.exists():
            end = self.last.get()[0] // 1000 + self.idle_ms
            if end <= now:
                yield from self.idle(key)
                self.last.clear()
            else:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


class _History(_InOrder):
    def __init__(self, n: int, idle_ms: int):
        super().__init__(idle_ms)
        self.n = n

    def more_state(self, handle) -> None:
        self.kept = handle.getListState("kept", "role string, text string")

    def take(self, key, m) -> Iterator[Row]:
        kept = [tuple(x) for x in self.kept.get()]
        if m[2] == "user":
            yield Row(conv_id=key[0], turn=m[1], history_size=len(kept), history_text="\n".join(f"{r or ''}: {t or ''}" for r, t in kept))
        self.kept.put([*kept, (m[2], m[3])][-self.n:])

    def idle(self, key) -> Iterator[Row]:
        self.kept.clear()
        return iter(())


class _Summary(_InOrder):
    def __init__(self, idle_ms: int, terms: Sequence[str], top: int, keep: int):
        super().__init__(idle_ms)
        self.terms, self.top, self.keep = frozenset(terms), top, keep

    def more_state(self, handle) -> None:
        self.session = handle.getValueState("session", "start long, end long, messages long, words long")
        self.counts = handle.getMapState("counts", "word string", "n long, first long")

    def take(self, key, m) -> Iterator[Row]:
        start, _, n, seen = self.session.get() if self.session.exists() else (m[0], 0, 0, 0)
        if m[2] == "user":
            for w in m[4] or ():
                old = self.counts.getValue((w,)) if self.counts.containsKey((w,)) else None
                self.counts.updateValue((w,), (1, seen) if old is None else (old[0] + 1, old[1]))
                seen += 1
        self.session.update((start, m[0], n + (m[2] in ("user", "assistant")), seen))
        return iter(())

    def idle(self, key) -> Iterator[Row]:
        if not self.session.exists():
            return
        start, end, n, _ = self.session.get()
        best = heapq.nsmallest(self.top, ((-v[0], v[1], w[0]) for w, v in self.counts.iterator())) if self.counts.exists() else []
        topics = [w for _, _, w in best if w in self.terms or len(w) > 4][:self.keep]
        yield Row(conv_id=key[0], session_start_us=start, session_end_us=end, total_exchanges=n // 2, common_topics=", ".join(topics))
        self.session.clear()
        self.counts.clear()


def _timed(turns: DataFrame, time_col: str, lateness_seconds: int, own_words: Column) -> DataFrame:
    spark = turns.sparkSession
    ship_package(spark)
    if spark.conf.get(_PROVIDER, "") != STORE:
        raise RuntimeError(f"{_PROVIDER} must be {STORE} for list and map state (see state_store)")
    ts = F.col(time_col).cast("timestamp")
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), own_words.alias("words"))
    return t.withWatermark("ts", f"{lateness_seconds} seconds")


def ordered_history(turns: DataFrame, time_col: str, n: int = 6, lateness_seconds: int = 600, idle_seconds: int = 86_400) -> DataFrame:
    """K4: ``(conv_id, turn, history_size, history_text)`` for every user message, in event time order."""
    t = _timed(turns, time_col, lateness_seconds, F.lit(None).cast("array<string>"))
    return t.groupBy("conv_id").transformWithState(_History(n, 1000 * idle_seconds), HISTORY, "append", "EventTime")


def live_summaries(turns: DataFrame, time_col: str, idle_seconds: int = 1800, lateness_seconds: int = 600,
                   terms: Sequence[str] = L.TOPIC_TERMS, top: int = 5, keep: int = 3) -> DataFrame:
    """K5: a row per session (start, end, exchanges, topics) once it has been idle for ``idle_seconds``."""
    t = _timed(turns, time_col, lateness_seconds, words(F.lower(F.col("text"))))
    return t.groupBy("conv_id").transformWithState(_Summary(1000 * idle_seconds, terms, top, keep), SUMMARY, "append", "EventTime")
