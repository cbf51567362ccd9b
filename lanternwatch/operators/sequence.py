"""Ordered operators over calls: rolling counts, anomalies, chains, state from logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lanternwatch.functions.regexes import Pattern
from lanternwatch.operators.folds import Cache, Circuit, fold_table
from lanternwatch.operators.policy import risk_class
from lanternwatch.streaming.shared import settled

KEY = ("tenant_id", "agent_id", "tool_name")
MINUTE, HOUR, DAY = 60, 3600, 86400
WINDOWS = {"n_1m": MINUTE, "n_5m": 5 * MINUTE, "n_1h": HOUR, "n_1d": DAY}
ALPHA = 0.2


def rolling_counts(calls: DataFrame, windows: dict[str, int] = WINDOWS, key: Sequence[str] = KEY, ts: str = "ts") -> DataFrame:
    """Trailing inclusive counts by key, one sort for all windows."""
    base = W.partitionBy(*key).orderBy(F.unix_micros(F.col(ts)))
    return calls.withColumns({n: F.count("*").over(base.rangeBetween(-s * 1_000_000, 0)) for n, s in windows.items()})


def detect_burst(counted: DataFrame, count: str = "n_1m", severe: int = 5, other: int = 20) -> DataFrame:
    threshold = F.when(risk_class(F.col("tool_name")).isin("DESTRUCTIVE", "EXTERNAL_SIDE_EFFECT"), severe).otherwise(other)
    return counted.withColumns({"burst": F.col(count) >= threshold, "burst_score": F.when(F.col(count) >= threshold, F.least(F.lit(1.0), F.col(count) / (2 * threshold))).otherwise(0.0)})


def detect_first_seen(calls: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """First call ever of a destructive or external tool by its key; score 0.55."""
    first = F.row_number().over(W.partitionBy(*key).orderBy("ts", "request_id")) == 1
    hit = first & risk_class(F.col("tool_name")).isin("DESTRUCTIVE", "EXTERNAL_SIDE_EFFECT")
    return calls.withColumns({"first_seen": hit, "first_seen_score": F.when(hit, 0.55).otherwise(0.0)})


def _ewma(alpha: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mean, var = None, 0.0, 0.0
        for pdf in batches:
            means, variances = [], []
            for k, x in zip(pdf["_key"], pdf["_x"], strict=True):
                if k != key:
                    key, mean, var = k, 0.0, 0.0
                previous = mean
                mean = (1 - alpha) * mean + alpha * x
                var = (1 - alpha) * var + alpha * (x - previous) ** 2
                means.append(mean)
                variances.append(var)
            yield pdf.drop(columns=["_x"]).assign(ewma=means, ewma_var=variances).drop(columns=["_key"])

    return run


def ewma(counted: DataFrame, x: str = "n_1h", key: Sequence[str] = KEY, alpha: float = ALPHA) -> DataFrame:
    """``request_id, ewma, ewma_var`` after each call, in time order by key, from 0.

    The sort is Spark's; a task streams over its sorted rows with two numbers
    of state, so a key of any length passes through bounded memory.
    """
    rows = counted.select(F.concat_ws("\x1f", *key).alias("_key"), "ts", "request_id", F.col(x).cast("double").alias("_x"))
    placed = rows.repartition("_key").sortWithinPartitions("_key", "ts", "request_id").drop("ts")
    return placed.mapInPandas(_ewma(alpha), "request_id string, ewma double, ewma_var double")


def detect_spike(counted: DataFrame, smoothed: DataFrame, total: str, z_needed: float = 3.0) -> DataFrame:
    """z of the minute's rate against the smoothed hour; needs more than 10 calls and some variance."""
    rows = counted.join(smoothed, "request_id")
    z = (F.col("n_1m") * 60 - F.col("ewma")) / F.greatest(F.sqrt("ewma_var"), F.lit(1.0))
    hit = (F.col(total) > 10) & (F.col("ewma_var") > 0) & (z >= z_needed)
    return rows.withColumns({"z": z, "spike": hit, "spike_score": F.when(hit, F.least(F.lit(1.0), z / 10)).otherwise(0.0)})


def detect_anomaly(rows: DataFrame) -> DataFrame:
    """Burst before first seen before spike; ``kind`` is null where nothing is odd."""
    kinds = [("burst", "burst_score"), ("first_seen", "first_seen_score"), ("spike", "spike_score")]
    kinds = [(k, s) for k, s in kinds if k in rows.columns]
    return rows.withColumns({"kind": F.coalesce(*[F.when(F.col(k), k) for k, _ in kinds]), "score": F.coalesce(*[F.when(F.col(k), F.col(s)) for k, s in kinds], F.lit(0.0))})


@dataclass(frozen=True)
class Chain:
    """Tools of consecutive calls, oldest first; ``trigger`` and ``unless`` look at the last call's arguments."""

    name: str
    steps: tuple[str, ...]
    severity: float
    trigger: str | None = None
    unless: str | None = None


_OUT4 = r"^(gmail\.send_email|slack\.send_message|sms\.send|webhook\.send)$"
# Chains in order; the first that matches wins.
CHAINS = [
    Chain("credential-harvest", (r"^filesystem\.(read|list)$", r"^(webhook\.send|http\.post|gmail\.send_email)$"), 1.0, r"\.env|credential|\.ssh|id_rsa|\.aws"),
    Chain("env-leak", (r"^(filesystem\.read|shell\.run)$", r"^(http\.post|webhook\.send|gmail\.send_email|slack\.send_message)$"), 0.95, r"\benv\b|\.env|environment"),
    Chain("read-pii-then-exfiltrate", (r"^(filesystem\.read|gmail\.read_email|postgres\.query|supabase\.select)$", r"^(gmail\.send_email|slack\.send_message|sms\.send|webhook\.send|http\.post)$"), 0.9),
    Chain("browser-then-internal-action", (r"^(browser\.fetch|http\.fetch)$", r"^(gmail\.send_email|slack\.send_message|webhook\.send|http\.post|postgres\.query|supabase\.query|github\.create_issue|github\.create_pr_comment)$"), 0.9),
    Chain("db-then-webhook", (r"^(postgres\.query|supabase\.select)$", r"^webhook\.send$"), 0.85),
    Chain("drive-then-public-share", (r"^gdrive\.(list|read)$", r"^(social\.publish_with_approval|webhook\.send|http\.post)$"), 0.85),
    Chain("recon-then-destroy", (r"^(supabase\.select|postgres\.query|filesystem\.list)$", r"^(postgres\.query|supabase\.query|filesystem\.delete|shell\.run)$"), 1.0, r"\b(drop|truncate|delete from|rm\s+-rf)\b"),
    Chain("inventory-then-mass-delete", (r"^(filesystem\.list|github\.list_repos|gmail\.list_messages)$", r"^(filesystem\.delete|github\.delete_branch)$"), 0.85),
    Chain("config-then-share", (r"^(filesystem\.read|github\.list_repos)$", r"^(slack\.send_message|webhook\.send|gmail\.send_email|http\.post)$"), 0.9, r"config|settings|token|api_key|secret"),
    Chain("fetch-then-act-on-content", (r"^(browser\.fetch|http\.fetch)$", r"^(postgres\.query|supabase\.query|shell\.run|filesystem\.write)$"), 0.85),
    Chain("email-then-act", (r"^gmail\.(read_email|list_messages)$", r"^(postgres\.query|supabase\.query|shell\.run|webhook\.send)$"), 0.85),
    Chain("social-spam-burst", (r"^social\.create_draft$", r"^social\.create_draft$", r"^social\.publish_with_approval$"), 0.7),
    Chain("bulk-outbound-burst", (_OUT4, _OUT4, _OUT4), 0.75),
    Chain("shell-then-network-fetch", (r"^shell\.run$", r"^(http\.fetch|http\.post|webhook\.send)$"), 0.8),
    Chain("github-write-then-deploy", (r"^github\.(create_issue|create_pr_comment|merge_pr)$", r"^deploy$"), 0.9),
    Chain("mass-read-then-bundle", (r"^(filesystem\.read|filesystem\.list|gmail\.list_messages|postgres\.query)$", r"^filesystem\.write$"), 0.7, r"bundle|archive|export|dump|backup"),
    Chain("select-then-delete", (r"^(postgres\.query|supabase\.query|supabase\.select)$", r"^(postgres\.query|supabase\.query)$"), 0.85, r"\b(delete\s+from|update\s+.+\s+set)\b", r"\bwhere\b"),
    Chain("shell-fetch-eval", (r"^shell\.run$", r"^shell\.run$"), 0.95, r"\b(curl|wget)\b.+\|\s*(?:bash|sh|zsh|python)"),
    Chain("browser-then-db-write", (r"^(browser\.fetch|http\.fetch)$", r"^(postgres\.query|supabase\.query|supabase\.select)$"), 0.9, r"\b(insert|update|upsert)\b"),
]


def steps_match(c: Chain) -> Column:
    """The tools of the last calls match the steps; ``_tool<i>`` and ``_recent<i>`` are the tool and freshness i calls back."""
    k = len(c.steps)
    hit = F.lit(True)
    for i, step in enumerate(c.steps):
        back = k - 1 - i
        hit = hit & F.coalesce(F.col(f"_tool{back}").rlike(step) & F.col(f"_recent{back}"), F.lit(False))
    return hit


def asked_for(c: Chain, args: Column) -> Column:
    """The arguments have the chain's trigger and not what excuses them."""
    hit = Pattern("", c.trigger, "i").found(args) if c.trigger else F.lit(True)
    return hit & ~Pattern("", c.unless, "i").found(args) if c.unless else hit


def chain_matches(c: Chain, args: Column) -> Column:
    """The last calls match the steps, and the last one's arguments are what the chain asks for."""
    return steps_match(c) & asked_for(c, args)


def chain_masks(args: str = "args", chains: Sequence[Chain] = tuple(CHAINS)) -> dict[str, Column]:
    """What ``folds.Steps`` reads of a call: chains whose last step it is (trigger included), whose step one back, whose step two back."""
    bits = lambda test: sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in test), F.lit(0).cast("long"))
    tool = F.col("tool_name")

    def last(c: Chain) -> Column:
        hit = tool.rlike(c.steps[-1])
        hit = hit & Pattern("", c.trigger, "i").found(F.col(args)) if c.trigger else hit
        return hit & ~Pattern("", c.unless, "i").found(F.col(args)) if c.unless else hit

    return {
        "now": bits((i, last(c)) for i, c in enumerate(chains)),
        "one": bits((i, tool.rlike(c.steps[-2])) for i, c in enumerate(chains)),
        "two": bits((i, tool.rlike(c.steps[-3])) for i, c in enumerate(chains) if len(c.steps) > 2),
    }


def detect_chains(calls: DataFrame, chains: Sequence[Chain] = tuple(CHAINS), window: int = 5 * MINUTE, keep: int = 50, flows: DataFrame | None = None, with_args: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``request_id, session_id, chain_id, severity, all_chains, confidence`` of the calls that complete a chain.

    Confidence: severity times a decay of the time since the oldest call in the
    window (of the last ``keep``; 0.5 at least, 1 up to a minute), times 0.85
    for calls that are not in ``flows`` (``request_id`` of ``flow.dataflow_join``).
    ``with_args`` adds ``args`` to calls that come without; only those whose tools match a chain get them.
    """
    order = W.partitionBy("session_id").orderBy("ts", "request_id")
    longest = max(len(c.steps) for c in chains)
    back = {f"_tool{i}": (F.lag("tool_name", i).over(order) if i else F.col("tool_name")) for i in range(longest)}
    age = {f"_recent{i}": (F.unix_micros("ts") - F.unix_micros(F.lag("ts", i).over(order)) <= window * 1_000_000) if i else F.lit(True) for i in range(longest)}
    inside = F.min(F.unix_micros("ts")).over(W.partitionBy("session_id").orderBy(F.unix_micros("ts")).rangeBetween(-window * 1_000_000, 0))
    oldest = F.greatest(inside, F.unix_micros(F.lag("ts", keep - 1).over(order)))
    rows = calls.withColumns({**back, **age, "_span": (F.unix_micros("ts") - oldest) / 1e6})
    decay = F.least(F.lit(1.0), F.greatest(F.lit(0.5), 1 - (F.col("_span") - 60) / window))
    named = lambda c: F.struct(F.lit(c.name).alias("id"), F.lit(c.severity).alias("severity"))
    if with_args is None:
        hits = F.array_compact(F.array(*[F.when(chain_matches(c, F.col("args")), named(c)) for c in chains]))
    else:
        stepped = F.array_compact(F.array(*[F.when(steps_match(c), F.lit(i)) for i, c in enumerate(chains)]))
        near = settled(rows.withColumn("_steps", stepped).where(F.size("_steps") > 0).select(*calls.columns, "_span", "_steps"))
        rows = with_args(near)
        hits = F.array_compact(F.array(*[F.when(F.array_contains("_steps", i) & asked_for(c, F.col("args")), named(c)) for i, c in enumerate(chains)]))
    found = rows.select("request_id", "session_id", hits.alias("h"), decay.alias("d")).where(F.size("h") > 0)
    weight = F.lit(0.85)
    if flows is not None:
        found = found.join(flows.select("request_id", F.lit(True).alias("_flow")).distinct(), "request_id", "left")
        weight = F.when(F.col("_flow"), 1.0).otherwise(0.85)
    return found.select("request_id", "session_id", F.get("h", 0)["id"].alias("chain_id"), F.get("h", 0)["severity"].alias("severity"), F.col("h.id").alias("all_chains"), F.least(F.lit(1.0), F.get("h", 0)["severity"] * F.col("d") * weight).alias("confidence"))


def session_history(calls: DataFrame, window: int = 5 * MINUTE, keep: int = 50) -> DataFrame:
    """Calls still held at each session's last call: not older than the window, the newest ``keep``."""
    newest = W.partitionBy("session_id")
    ranked = calls.withColumns({"_last": F.max(F.unix_micros("ts")).over(newest), "_r": F.row_number().over(newest.orderBy(F.desc("ts"), F.desc("request_id")))})
    return ranked.where((F.col("_r") <= keep) & (F.col("_last") - F.unix_micros("ts") <= window * 1_000_000)).drop("_last", "_r")


def activity_snapshot(calls: DataFrame, as_of: str, key: Sequence[str] = KEY, smoothed: DataFrame | None = None) -> DataFrame:
    """Calls by key: ``total, last_1m, last_1h, last_1d``, and with ``smoothed`` (of ``ewma``) ``ewma_1h``, its value after the last call."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ts")
    inside = lambda s: F.count_if((age >= 0) & (age <= s * 1_000_000))
    sums = [F.count("*").alias("total"), *[inside(s).alias(n) for n, s in (("last_1m", MINUTE), ("last_1h", HOUR), ("last_1d", DAY))]]
    if smoothed is not None:
        calls = calls.join(smoothed, "request_id")
        sums.append(F.max_by("ewma", F.struct("ts", "request_id")).alias("ewma_1h"))
    return calls.groupBy(*key).agg(*sums)


def approval_state(events: DataFrame, as_of: str) -> DataFrame:
    """Current state of approvals from their events (create, approve, reject): the latest event; pending ones past their expiry are EXPIRED."""
    last = events.groupBy("approval_id").agg(F.max_by(F.struct("event", "expires_at"), F.struct("ts", "event")).alias("e"), F.min("ts").alias("created"))
    state = F.when(F.col("e.event") == "approve", "APPROVED").when(F.col("e.event") == "reject", "REJECTED").when(F.col("e.expires_at") < F.lit(as_of).cast("timestamp"), "EXPIRED").otherwise("PENDING")
    return last.select("approval_id", "created", state.alias("status"))


def pending_approvals(events: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """Approvals that wait for a decision, newest first: ``approval_id, created``."""
    return approval_state(events, as_of).where("status = 'PENDING'").select("approval_id", "created").orderBy(F.desc("created"), "approval_id").limit(limit)


def token_use_audit(uses: DataFrame, issuer: str) -> DataFrame:
    """First refusal of each use of a capability token: issuer, expiry, tenant, tool, arguments, replay; null if accepted."""
    refused = (
        F.when(F.col("issuer") != issuer, "wrong-issuer").when(F.col("exp") < F.col("ts"), "expired").when(F.col("claim_tenant") != F.col("tenant_id"), "tenant")
        .when(F.col("claim_tool") != F.col("tool_name"), "tool").when(F.col("claim_args_hash") != F.col("args_hash"), "args")
    )
    rows = uses.withColumn("_r", refused)
    earlier = F.sum(F.col("_r").isNull().cast("int")).over(W.partitionBy("jti").orderBy("ts", "request_id").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("request_id", "jti", F.coalesce("_r", F.when(earlier > 0, "replay")).alias("refused"))


def outage_intervals(outcomes: DataFrame, failures: int = 5, cooldown: int = 30) -> DataFrame:
    """Streaks of at least ``failures`` failed calls by target: ``target, opened, until, n``."""
    order = W.partitionBy("target").orderBy("ts", "request_id")
    marked = outcomes.withColumn("_island", F.sum(F.col("success").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    failed = marked.where("not success").withColumn("_n", F.row_number().over(W.partitionBy("target", "_island").orderBy("ts", "request_id")))
    streaks = failed.groupBy("target", "_island").agg(F.count("*").alias("n"), F.min(F.when(F.col("_n") == failures, F.col("ts"))).alias("opened"), F.max("ts").alias("last"))
    return streaks.where(F.col("n") >= failures).select("target", "opened", (F.col("last") + F.make_dt_interval(secs=F.lit(cooldown))).alias("until"), "n")


def _bucket(capacity: float, per_second: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level, at = None, capacity, 0
        for pdf in batches:
            allowed, remaining = [], []
            for k, t, cost in zip(pdf["key"], pdf["us"], pdf["cost"], strict=True):
                if k != key:
                    key, level, at = k, capacity, t
                level, at = min(capacity, level + (t - at) / 1e6 * per_second), t
                allowed.append(level >= cost)
                level -= cost if level >= cost else 0
                remaining.append(level)
            yield pd.DataFrame({"request_id": pdf["request_id"], "key": pdf["key"], "allowed": allowed, "remaining": remaining})

    return run


def token_bucket_flags(requests: DataFrame, key: str, capacity: float = 60.0, per_second: float = 1.0) -> DataFrame:
    """``request_id, key, allowed, remaining`` under a token bucket by key, streamed in time order with two numbers of state."""
    rows = requests.select("request_id", F.col(key).alias("key"), F.unix_micros("ts").alias("us"), F.lit(1.0).alias("cost"))
    return rows.repartition("key").sortWithinPartitions("key", "us", "request_id").mapInPandas(_bucket(capacity, per_second), "request_id string, key string, allowed boolean, remaining double")


def outage_states(outcomes: DataFrame, failures: int = 5, cooldown: int = 30) -> DataFrame:
    """``target, request_id, allowed, state, after, failures`` of each call under a circuit breaker by target.

    Open after ``failures`` failures in a row; calls are refused until
    ``cooldown`` seconds later, when the first one is let through half open and closes
    the circuit or opens it again.
    """
    return fold_table(outcomes, ["target"], Circuit(failures, cooldown), {"success": F.col("success")})


def cached_advice(requests: DataFrame, by: Sequence[str], ttl: int = 60) -> DataFrame:
    """``by, request_id, cached``: whether an answer for the same key still lives, made at most ``ttl`` seconds before by a call that found none."""
    return fold_table(requests, by, Cache(ttl), {})
