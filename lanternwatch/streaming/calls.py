"""Streaming variants over a stream of calls. Each equals its batch operator on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternwatch.operators import folds, policy, sequence
from lanternwatch.streaming.ordered import ordered_fold


def burst_counts(calls: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls by key in sliding windows."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "tenant_id", "agent_id", "tool_name").agg(F.count("*").alias("n"))


def session_activity(calls: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def minute_counters(decisions: DataFrame, late: str = "10 minutes") -> DataFrame:
    return decisions.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "action", "rule").agg(F.count("*").alias("n"))


def first_uses(uses: DataFrame, late: str = "1 hour") -> DataFrame:
    """Token uses without replays that arrive within the watermark."""
    return uses.withWatermark("ts", late).dropDuplicatesWithinWatermark(["jti"])


def taint_join(outputs: DataFrame, calls: DataFrame, args: str = "args", ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of outputs and later calls of the session whose arguments hold a piece of the output."""
    from lanternwatch.operators.flow import needles

    o = outputs.withWatermark("ts", late).select("session_id", F.col("request_id").alias("source_id"), F.col("ts").alias("out_ts"), F.explode(needles(F.col("output"))).alias("needle"))
    c = calls.withWatermark("ts", late).select(F.col("session_id").alias("s"), "request_id", "ts", args)
    near = (F.col("session_id") == F.col("s")) & (F.col("ts") > F.col("out_ts")) & (F.col("ts") <= F.col("out_ts") + F.expr(f"INTERVAL {ttl}"))
    return c.join(o, near & F.col(args).contains(F.col("needle"))).select("request_id", "source_id", "ts")


def risk_and_rules(calls: DataFrame) -> DataFrame:
    """Stateless: risk class and the rules that speak, for ``foreachBatch`` sinks."""
    return policy.apply_rules(calls)


def anomaly_state(calls: DataFrame, late: str = "10 minutes", fold: folds.Anomaly | None = None) -> DataFrame:
    """Counts, smoothed rate, burst, first sight and spike of each call by tenant, agent and tool, as the batch operators have them."""
    severe = policy.risk_class(F.col("tool_name")).isin("DESTRUCTIVE", "EXTERNAL_SIDE_EFFECT")
    return ordered_fold(calls, list(sequence.KEY), fold or folds.Anomaly(), {"severe": severe}, late)


def chain_state(calls: DataFrame, late: str = "10 minutes", window: int = 300, keep: int = 50, flow: Column | None = None, lanes: int | None = None) -> DataFrame:
    """Calls that complete a chain, by session, as ``sequence.detect_chains``. ``flow`` says whether a call's arguments hold earlier output."""
    chains = sequence.CHAINS
    two = sum(1 << i for i, c in enumerate(chains) if len(c.steps) == 2)
    fold = folds.Steps([c.name for c in chains], [c.severity for c in chains], two, window, keep)
    return ordered_fold(calls, ["session_id"], fold, {**sequence.chain_masks(), "flow": F.lit(False) if flow is None else flow}, late, lanes=lanes)


def bucket_state(requests: DataFrame, key: str, capacity: float = 60.0, per_second: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """``key, request_id, allowed, remaining`` of a token bucket by key, as ``sequence.token_bucket_flags``."""
    rows = requests.withColumnRenamed(key, "key")
    return ordered_fold(rows, ["key"], folds.Bucket(capacity, per_second), {"cost": F.lit(1.0)}, late)


def circuit_state(outcomes: DataFrame, failures: int = 5, cooldown: int = 30, late: str = "10 minutes") -> DataFrame:
    """``target, request_id, allowed, state, after, failures``, as ``sequence.outage_states``."""
    return ordered_fold(outcomes, ["target"], folds.Circuit(failures, cooldown), {"success": F.col("success")}, late)


def advice_state(requests: DataFrame, by: list[str], ttl: int = 60, late: str = "10 minutes") -> DataFrame:
    """``by, request_id, cached``, as ``sequence.cached_advice``."""
    return ordered_fold(requests, by, folds.Cache(ttl), {}, late)


def scrutiny_state(events: DataFrame, ttl: int = 15 * 60, late: str = "10 minutes") -> DataFrame:
    """``tenant_id, session_id, request_id, under_scrutiny, calls_left`` of decisions, in a stream of decisions and accepted overrides.

    ``scrutiny_calls`` is over 0 in the row of an override, which comes before decisions of its moment; as ``flow.scrutiny_windows``.
    """
    calls = F.coalesce("scrutiny_calls", F.lit(0))
    rows = events.withColumns({"request_id": F.when(calls > 0, "").otherwise(F.col("request_id"))})
    return ordered_fold(rows, ["tenant_id", "session_id"], folds.Scrutiny(ttl), {"calls": calls}, late)


def approval_states(events: DataFrame, late: str = "10 minutes", lanes: int | None = None) -> DataFrame:
    """``approval_id, status, us`` of each change of an approval; EXPIRED comes from an event-time timer once the watermark passes ``expires_at``.

    An approval's newest row is what ``sequence.approval_state`` says as of the watermark.
    """
    rows = events.withColumn("request_id", F.col("event"))
    return ordered_fold(rows, ["approval_id"], folds.Approval(), {"event": F.col("event"), "expires_us": F.unix_micros("expires_at")}, late, lanes=lanes)


def apply_pauses_to(decisions: DataFrame, pauses: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Decisions of a stream under the pauses known when their batch runs; each batch is joined as ``flow.apply_pauses`` does."""
    from lanternwatch.operators.flow import apply_pauses

    replay(decisions, lambda batch, number: sink(apply_pauses(batch, pauses()), number), checkpoint)


def replay(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what is there now and waits for its end."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table_sink(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of several tables, exactly once: each batch is written under its number.

    A batch that is repeated after a failure, even between two of its tables, replaces what it wrote before. ``folder/name``
    is read as one table with a ``batch`` column.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, make in tables.items():
                make(kept).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return write


def scan_live(calls: DataFrame, folder: str, checkpoint: str) -> None:
    """What all rules say of a stream's calls (``findings``), and the audit rows of the decisions on them (``audit``)."""
    from lanternwatch.operators.audit import call_log_to_audit

    tables = {"findings": policy.apply_rules, "audit": lambda batch: call_log_to_audit(policy.decide(batch))}
    replay(calls, table_sink(folder, tables), checkpoint)
