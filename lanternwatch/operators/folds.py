"""Operators whose next row depends on all before it, as folds that run over tables and over streams alike.

A fold sees each key's rows in the order of ``us`` (microseconds) and
``request_id``. Over a table (``fold_table``) Spark sorts, and a task streams
through its sorted rows with one key's state; over a stream
(``streaming.ordered``) rows wait for the watermark and state lives in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fold:
    """``start`` is the state of a new key; states are plain JSON values.

    ``step`` takes all rows of one moment (dicts), in order, and gives the new
    state and rows of ``output``. ``due`` is the moment after which a state
    ends by itself: once time is past it, ``expire`` is called, which by default
    begins anew. A state without such a moment is kept.
    """

    output: str

    def start(self):
        return None

    def step(self, state, us: int, rows: list[dict]) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def due(self, state, us: int) -> int | None:
        """``us`` is the moment of the last row."""
        return None

    def expire(self, state) -> tuple[object, list[tuple]]:
        return self.start(), []


def advance(fold: Fold, state, last: int | None, us: int) -> tuple[object, list[tuple], bool]:
    """State, output and whether anything ended, when time gets to ``us``."""
    due = None if last is None else fold.due(state, last)
    if due is None or due >= us:
        return state, [], False
    state, out = fold.expire(state)
    return state, out, True


def run(fold: Fold, state, last: int | None, rows: Sequence[dict]) -> tuple[object, int | None, list[tuple]]:
    """Folds sorted rows of one key into a state whose last row came at ``last``."""
    out = []
    for us, moment in groupby(rows, key=lambda r: r["us"]):
        state, ended, _ = advance(fold, state, last, us)
        state, made = fold.step(state, us, list(moment))
        out += ended + made
        last = us
    return state, last, out


def fold_table(rows: DataFrame, key: Sequence[str], fold: Fold, values: dict[str, Column], ts: str = "ts", until: int | None = None) -> DataFrame:
    """``key, fold.output`` over a table. ``until``: states that are due before this moment end after the last row.

    Rows of one key and moment are in memory together, nothing else.
    """
    ready = rows.select(*key, F.unix_micros(ts).alias("us"), "request_id", *[c.alias(n) for n, c in values.items()])
    names, made = ["us", "request_id", *values], T.StructType.fromDDL(fold.output)
    width, titles = len(key), [*key, *made.names]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            yield from pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for k, group in groupby(stream(batches), key=lambda r: r[:width]):
            state, last = fold.start(), None
            for _, moment in groupby(group, key=lambda r: r[width]):
                state, last, more = run(fold, state, last, [dict(zip(names, r[width:], strict=True)) for r in moment])
                out += [(*k, *o) for o in more]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=titles)
                    out = []
            if until is not None:
                out += [(*k, *o) for o in advance(fold, state, last, until)[1]]
        yield pd.DataFrame(out, columns=titles)

    schema = T.StructType([T.StructField(k, ready.schema[k].dataType) for k in key] + list(made))
    return ready.repartition(*key).sortWithinPartitions(*key, "us", "request_id").mapInPandas(task, schema)


class Cache(Fold):
    """Hits of a cache whose entry lives ``ttl`` seconds from the miss that made it; a hit does not renew it."""

    output = "request_id string, cached boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def step(self, state, us, rows):
        out = []
        for r in rows:
            hit = state is not None and us <= state
            state = state if hit else us + self.ttl
            out.append((r["request_id"], hit))
        return state, out

    def due(self, state, us):
        return state


class Circuit(Fold):
    """A circuit breaker: CLOSED, OPEN after ``failures`` failures in a row, HALF_OPEN for the first call after ``cooldown`` seconds, which decides.

    Reads ``success``. A call that is not allowed does not count.
    """

    output = "request_id string, allowed boolean, state string, after string, failures long"

    def __init__(self, failures: int = 5, cooldown: int = 30):
        self.most, self.cooldown = failures, cooldown * 1_000_000

    def start(self):
        return ["CLOSED", 0, 0]

    def step(self, state, us, rows):
        out = []
        for r in rows:
            now, failed, opened = state
            if now == "OPEN" and us - opened >= self.cooldown:
                now = "HALF_OPEN"
            if now == "OPEN":
                out.append((r["request_id"], False, now, now, failed))
                continue
            if r["success"]:
                state = ["CLOSED", 0, 0]
            else:
                failed += 1
                state = ["OPEN", failed, us] if now == "HALF_OPEN" or failed >= self.most else ["CLOSED", failed, 0]
            out.append((r["request_id"], True, now, state[0], state[1]))
        return state, out

    def due(self, state, us):
        return us if state == self.start() else None  # as a new target


class Bucket(Fold):
    """A token bucket; reads ``cost``. A full bucket is as a new one, so its state ends."""

    output = "request_id string, allowed boolean, remaining double"

    def __init__(self, capacity: float = 60.0, per_second: float = 1.0):
        self.capacity, self.rate = capacity, per_second

    def step(self, state, us, rows):
        level, at = state if state is not None else (self.capacity, us)
        level = min(self.capacity, level + (us - at) / 1e6 * self.rate)
        out = []
        for r in rows:
            allowed = level >= r["cost"]
            level -= r["cost"] if allowed else 0
            out.append((r["request_id"], allowed, float(level)))
        return [level, us], out

    def due(self, state, us):
        return us + int((self.capacity - state[0]) / self.rate * 1e6) + 1_000_000


class Scrutiny(Fold):
    """Scrutiny windows; reads ``calls``, over 0 in the row of an accepted override, whose ``request_id`` is empty and so comes first."""

    output = "request_id string, under_scrutiny boolean, calls_left int"

    def __init__(self, ttl: int = 15 * 60):
        self.ttl = ttl * 1_000_000

    def start(self):
        return [0, 0]

    def step(self, state, us, rows):
        (left, until), out = state, []
        for r in rows:
            if left <= 0 or us >= until:
                left, until = 0, 0
            if r["calls"] > 0:
                left, until = max(left, int(r["calls"])), max(until, us + self.ttl)
            else:
                out.append((r["request_id"], left > 0, max(0, left - 1)))
                left = max(0, left - 1)
        return [left, until], out

    def due(self, state, us):
        return max(us, state[1] - 1) if state[0] > 0 else us


class Approval(Fold):
    """States of an approval, key ``approval_id``: each event's, and EXPIRED once time is past ``expires_us`` of one that still waits.

    Reads ``event`` and ``expires_us``; of events of one moment the last by name counts.
    """

    output = "status string, us long"

    def step(self, state, us, rows):
        last = max(rows, key=lambda r: r["event"])
        status = {"approve": "APPROVED", "reject": "REJECTED"}.get(last["event"], "PENDING")
        return [status, last["expires_us"]], [(status, us)]

    def due(self, state, us):
        # a decided approval is forgotten once it could not have expired any more
        return state[1] if state[0] == "PENDING" else max(us, state[1] or us)

    def expire(self, state):
        return None, [("EXPIRED", state[1])] if state[0] == "PENDING" else []


class Anomaly(Fold):
    """Trailing counts, exponential mean and variance of the hour's count, burst, first sight and spike; reads ``severe``.

    Calls of one moment count each other, as in a range frame. The state has
    the moments of the last hour with their counts, three numbers, and ends after
    ``forget`` days of silence (a tool is then seen for the first time again); None keeps it.
    """

    output = "request_id string, n_1m long, n_1h long, ewma double, ewma_var double, z double, kind string, score double"

    def __init__(self, alpha: float = 0.2, severe: int = 5, other: int = 20, z: float = 3.0, burst: str = "n_1m", forget: int | None = 30):
        self.alpha, self.severe, self.other, self.z, self.burst = alpha, severe, other, z, burst
        self.forget = None if forget is None else forget * 86_400_000_000

    def start(self):
        return [[], 0.0, 0.0, 0]

    def step(self, state, us, rows):
        moments, mean, var, total = state
        moments = [m for m in moments if us - m[0] <= 3_600_000_000] + [[us, len(rows)]]
        hour = sum(n for _, n in moments)
        minute = sum(n for at, n in moments if us - at <= 60_000_000)
        out = []
        for r in rows:
            before, total = mean, total + 1
            mean = (1 - self.alpha) * mean + self.alpha * hour
            var = (1 - self.alpha) * var + self.alpha * (hour - before) ** 2
            z = (minute * 60 - mean) / max(var**0.5, 1.0)
            count, most = (minute if self.burst == "n_1m" else hour), (self.severe if r["severe"] else self.other)
            if count >= most:
                kind, score = "burst", min(1.0, count / (2 * most))
            elif total == 1 and r["severe"]:
                kind, score = "first_seen", 0.55
            elif total > 10 and var > 0 and z >= self.z:
                kind, score = "spike", min(1.0, z / 10)
            else:
                kind, score = None, 0.0
            out.append((r["request_id"], minute, hour, mean, var, z, kind, score))
        return [moments, mean, var, total], out

    def due(self, state, us):
        return None if self.forget is None else us + self.forget


class Steps(Fold):
    """Chains of calls; reads the bit masks of ``sequence.chain_masks`` and ``flow``.

    The state holds the calls of the last ``window`` seconds, ``keep`` at most, and ends with the window.
    """

    output = "request_id string, chain_id string, severity double, all_chains array<string>, confidence double"

    def __init__(self, names: Sequence[str], severities: Sequence[float], two: int, window: int = 300, keep: int = 50):
        self.names, self.severities, self.two, self.window, self.keep = list(names), list(severities), two, window * 1_000_000, keep

    def start(self):
        return []

    def step(self, state, us, rows):
        out = []
        for r in rows:
            state = [c for c in state if us - c[0] <= self.window][-(self.keep - 1) :] if self.keep > 1 else []
            one = state[-1][1] if state else 0
            two = self.two | (state[-2][2] if len(state) > 1 else 0)
            hits = r["now"] & one & two
            state.append([us, r["one"], r["two"]])
            if hits:
                found = [i for i in range(len(self.names)) if hits >> i & 1]
                decay = min(1.0, max(0.5, 1 - ((us - state[0][0]) / 1e6 - 60) / (self.window / 1e6)))
                severity = self.severities[found[0]]
                out.append((r["request_id"], self.names[found[0]], severity, [self.names[i] for i in found], min(1.0, severity * decay * (1.0 if r["flow"] else 0.85))))
        return state, out

    def due(self, state, us):
        return us + self.window
