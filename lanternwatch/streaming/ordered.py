"""Ordered folds over streams: rows wait for the watermark, are released in time order, and state ends.

A fold (``operators.folds``) sees each key's rows in the order of time,
whatever batches, Arrow chunks or order they came in, so it equals the same
fold over a table. Rows behind the watermark are dropped by Spark, as late rows
are everywhere in Structured Streaming.

State of a key: the rows that wait (as many as arrive within the allowed
lateness; packed by columns, and unpacked a slice at a time when they are released),
and what the fold keeps, until a timer says that it is due.

A group of the stream is a key, or with ``lanes`` the keys of one hash: then
many keys with few rows each share the calls to the state store and the timers.

The state store has to be RocksDB; ``use_rocksdb`` sets it where the session has no choice of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanternwatch.operators.folds import Fold, advance, run

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT = "HDFSBackedStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, DEFAULT).endswith(DEFAULT):
        spark.conf.set(PROVIDER, ROCKSDB)


def _ms(us: int) -> int:
    """The first millisecond at which the moment is past."""
    return -(-us // 1000)


SLICE = 20_000


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


class _Ordered(StatefulProcessor):
    """Waiting rows in a list, state and end of the fold by key in a value; a timer at the earliest moment at which anything is due."""

    def __init__(self, fold: Fold, key_names: list[str], waiting: T.StructType, output_names: list[str]):
        self.fold, self.key_names, self.schema, self.output_names = fold, key_names, to_arrow_schema(waiting), output_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", "states string")

    def _wake(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            if t == at_ms:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pa.concat_tables([pa.Table.from_pandas(pdf[self.schema.names], schema=self.schema, preserve_index=False) for pdf in rows])
        self.waiting.appendValue(_packed(came))
        due = max(_ms(pc.min(came["us"]).as_py()), timerValues.getCurrentWatermarkInMs() + 1)
        timers = list(self.handle.listTimers())
        if not timers or due < min(timers):
            self._wake(due)
        yield pd.DataFrame()

    def _released(self, ready: pa.Table) -> Iterator[tuple[tuple, list[dict]]]:
        """Rows by key in the order of time, whole moments at a time."""
        width, names = len(self.key_names), self.schema.names[len(self.key_names) :]
        rows = (r for part in range(0, len(ready), SLICE) for r in zip(*(c.to_pylist() for c in ready.slice(part, SLICE).columns), strict=True))
        for moment, group in groupby(rows, key=lambda r: r[: width + 1]):
            yield moment[:width], [dict(zip(names, r[width:], strict=True)) for r in group]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        packed = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pa.concat_tables(packed) if packed else self.schema.empty_table()
        past = pc.less_equal(rows["us"], now)
        ready = rows.filter(past).sort_by([(n, "ascending") for n in [*self.key_names, "us", "request_id"]])
        later = rows.filter(pc.invert(past))
        held = self.state.get()
        states = {tuple(k): (s, last) for k, s, last in json.loads(held[0])} if held else {}
        out = []
        for k, moment in self._released(ready):
            state, last = states.get(k) or (self.fold.start(), None)
            state, last, made = run(self.fold, state, last, moment)
            states[k] = state, last
            out += [(*k, *o) for o in made]
            if len(out) >= SLICE:
                yield self._made(out)
                out = []
        due = [_ms(pc.min(later["us"]).as_py())] if len(later) else []
        kept = []
        for k, (state, last) in states.items():
            state, ended, gone = advance(self.fold, state, last, now + 1)  # every row to come is later than now
            out += [(*k, *o) for o in ended]
            if not gone and last is not None:
                kept.append((k, state, last))
                end = self.fold.due(state, last)
                due += [] if end is None else [end // 1000 + 1]
        if packed and len(later):
            self.waiting.put([_packed(later)])
        elif packed:
            self.waiting.clear()
        if kept:
            self.state.update((json.dumps(kept),))
        elif held:
            self.state.clear()
        if due:
            self._wake(max(min(due), now // 1000 + 1))
        yield self._made(out)

    def _made(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.key_names, *self.output_names])

    def close(self) -> None:
        pass


def ordered_fold(rows: DataFrame, key: list[str], fold: Fold, values: dict[str, Column], late: str = "10 minutes", ts: str = "ts", lanes: int | None = None) -> DataFrame:
    """``key, fold.output`` of each row of the stream, once the watermark has passed it.

    ``values`` are the fold's columns as expressions, computed by Spark before rows wait. ``lanes``: for many keys with few rows each,
    so many groups of keys by their hash in place of a group for each key; the states of a lane's keys are in memory together.
    """
    use_rocksdb(rows.sparkSession)
    lane = [F.pmod(F.hash(*key), F.lit(lanes)).alias("_lane")] if lanes else []
    ready = rows.withWatermark(ts, late).select(*lane, *key, ts, F.unix_micros(ts).alias("us"), "request_id", *[c.alias(n) for n, c in values.items()])
    fields = {f.name: f for f in ready.schema}
    waiting = T.StructType([T.StructField(n, fields[n].dataType) for n in [*key, "us", "request_id", *values]])
    made = T.StructType.fromDDL(fold.output)
    processor = _Ordered(fold, key, waiting, made.names)
    out = T.StructType([T.StructField(k, fields[k].dataType) for k in key] + list(made))
    return ready.groupBy(*(["_lane"] if lanes else key)).transformWithStateInPandas(processor, out, "append", "EventTime")
