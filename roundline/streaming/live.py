"""Live twins of the batch operators over unbounded readings, in event time.

Readings may come out of order by as much as ``late``.  A recording's readings wait until
the watermark has passed them, and timers then take them in order of time, so the micro-batches
in which they came make no difference: results are those of the batch operators over all
that the watermark has passed.  Readings that come behind the watermark are dropped by Spark.

State per recording is what waits, one packed table a micro-batch, and a few values (a tracker
keeps the readings of its window).  A recording that is silent for ``idle`` loses its state; a later reading begins
anew.  Streams have ``stem`` and ``t`` in seconds, and may have their own timestamp ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.islands import eliminated
from ..operators.tracker import EVENTS, Evidence, observe

_TRANSITIONS = "stem string, t_lo double, t_hi double, old long, new long, kind string"
_ENDS = "stem string, t double, eliminated string"
_RUNS = "stem string, start double, last double, n long"


#: how far readings may be out of order, and after how long a silent recording is forgotten
LATE, IDLE = "1 minute", "1 day"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Gives a recording's rows to ``step`` in order of time, once the watermark has passed them."""

    def __init__(self, rows: pa.Schema, state: str, out: list[str], step: Callable, idle: int):
        self._rows, self._state, self._out, self._step, self._idle = rows, state, out, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # rows are packed, as each element of a state is sent to the task by itself
        self._waiting = handle.getListState("waiting", "packed binary")
        self._held = handle.getValueState("held", self._state)
        self._last = handle.getValueState("last", "at long")
        self._names = self._rows.names

    def _packed(self, rows: pa.Table) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self._rows) as out:
            out.write_table(rows)
        return (sink.getvalue().to_pybytes(),)

    def _unpacked(self) -> pd.DataFrame:
        parts = [pa.ipc.open_stream(packed).read_all() for (packed,) in self._waiting.get()]
        return pa.concat_tables(parts).to_pandas() if parts else pd.DataFrame(columns=self._names)

    def _table(self, rows: pd.DataFrame) -> pa.Table:
        # pandas makes floats of nullable integers
        return pa.Table.from_pandas(rows[self._names], schema=self._rows, preserve_index=False)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self._waiting.appendValue(self._packed(self._table(new)))
        self._handle.registerTimer(int(new["at_ms"].min()) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = self._unpacked()
        ready = rows["at_ms"] < now
        due = rows[ready].sort_values(["t", *(n for n in self._names if n not in ("t", "at_ms"))], kind="stable") if ready.any() else rows[:0]
        if len(due):
            state = tuple(self._held.get()) if self._held.exists() else None
            at, out = due["at_ms"].to_numpy(), []
            before = self._last.get()[0] if state is not None else at[0]
            # silence forgets what came before it, whenever its end is seen
            cuts = [0, *(i for i in range(len(at)) if at[i] - (at[i - 1] if i else before) > self._idle), len(at)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a or not k:
                    state, found = self._step(None if k else state, due.iloc[a:b])
                    out += found
            self._held.update(tuple(state))
            self._last.update((int(due["at_ms"].iloc[-1]),))
            rest = rows[~ready]
            if len(rest):
                self._waiting.put([self._packed(self._table(rest))])
                self._handle.registerTimer(int(rest["at_ms"].min()) + 1)
            else:
                self._waiting.clear()
                self._handle.registerTimer(int(due["at_ms"].iloc[-1]) + self._idle)
            yield pd.DataFrame([(key[0], *x) for x in out], columns=self._out)
        elif not len(rows) and self._last.exists() and self._last.get()[0] + self._idle <= now:
            self._held.clear()
            self._last.clear()

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, schema: str, state: str, step: Callable, columns: list[str], late: str = LATE, idle: str = IDLE, by: str = "stem") -> DataFrame:
    """``step(state or None, rows in time order)`` gives (new state, output rows) of each
    recording; ``columns`` are what it reads of a row."""
    # times without a date count from the day after the epoch, where watermarks begin
    ts = F.col("ts") if "ts" in stream.columns else F.timestamp_micros(((F.col("t") + 86_400) * 1_000_000).cast("long"))
    timed = stream.withColumn("ts", ts).where(F.col("ts").isNotNull() & F.col("t").isNotNull())
    rows = timed.withWatermark("ts", late).select(by, "ts", F.unix_millis("ts").alias("at_ms"), *columns)
    kinds = to_arrow_schema(rows.select("at_ms", *columns).schema)
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    gap = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {idle})").first()[0]
    names = [c.split()[0] for c in schema.split(", ")]
    made = _InOrder(kinds, state, names, step, gap)
    return rows.groupBy(by).transformWithStateInPandas(made, StructType.fromDDL(schema), "Append", "EventTime")


def transitions(stream: DataFrame, value: str, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Confirmed changes of a value seen twice in a row, as soon as they are confirmed."""

    def step(state, rows):
        old, seen, last, n, first, at = state or (None, None, None, 0, None, None)
        out = []
        for t, v in zip(rows.t, rows[value], strict=True):
            if pd.isna(v):
                continue
            v = int(v)
            n, first = (n + 1, first) if v == last else (1, t)
            last = v
            if n >= 2 and v != old:
                if old is not None:
                    out.append((at, first, old, v, "win" if v > old else "reset"))
                old = v
            if v == old:
                at = t
        return (old, seen, last, n, first, at), out

    return _stateful(stream, _TRANSITIONS, "old long, seen long, last long, n long, first double, at double", step, ["t", value], late, idle)


def eliminations(stream: DataFrame, active: int = 3, ended: int = 3, gap: float = 3.0, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Ends of rounds from states (stem, t, state), thinned to one in ``gap`` seconds."""

    def step(state, rows):
        out = []
        for t, s in zip(rows.t, rows.state, strict=True):
            state, found = eliminated(state, t, s, active, ended, gap)
            out += found
        return state, out

    return _stateful(stream, _ENDS, "live long, gone long, kind string, since double, waiting boolean, kept double", step, ["t", "state"], late, idle)


def tracked(stream: DataFrame, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Events of the evidence tracker from readings (stem, t, k, conf); a kill that is
    taken back later is followed by an ``undo``."""

    def step(state, rows):
        held = Evidence()
        if state:
            value, ts, ks, cs, zeros, since, last = state
            held = Evidence(value, tuple((float(t), int(k), float(c)) for t, k, c in zip(ts, ks, cs, strict=True)), zeros, since, (last[0], int(last[1]), int(last[2])) if len(last) else None)
        out = []
        for x in rows.itertuples():
            if not pd.isna(x.k):
                held, events = observe(held, float(x.t), int(x.k), float(x.conf))
                out += events
        ts, ks, cs = ([r[i] for r in held.recent] for i in range(3))
        return (held.value, ts, ks, cs, held.zeros, held.zero_since, [float(x) for x in held.last or ()]), out

    return _stateful(stream, EVENTS, "value long, ts array<double>, ks array<long>, cs array<double>, zeros long, since double, last array<double>", step, ["t", "k", "conf"], late, idle)


def boundary_runs(stream: DataFrame, status: str, least: int, late: str = LATE, idle: str = IDLE) -> DataFrame:
    """Runs of one status, given out when another status ends them."""

    def step(state, rows):
        start, last, n = state or (None, None, 0)
        out = []
        for t, m in zip(rows.t, rows.method, strict=True):
            if m == status:
                start, last, n = (t if n == 0 else start), t, n + 1
            else:
                if n >= least:
                    out.append((start, last, n))
                n = 0
        return (start, last, n), out

    return _stateful(stream, _RUNS, "start double, last double, n long", step, ["t", "method"], late, idle)


def sessions(stream: DataFrame, gap: str = "5 seconds", late: str = "1 minute", least: float = 0.6) -> DataFrame:
    """Sessions of high-probability frames (stem, ts, prob), closed by the watermark."""
    s = stream.where(F.col("prob") >= least).withWatermark("ts", late).groupBy("stem", F.session_window("ts", gap))
    return s.agg(F.round(F.avg("prob"), 9).alias("mean_value"), F.count("*").alias("n")).select("stem", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "mean_value", "n")


def drained(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and gives its written result."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
