"""Audit rows from decisions, and the analytics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Upper bounds of the latency histogram, in seconds; an infinite one follows.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
TOOL_ACTIONS = ("TOOL_CALL_EXECUTED", "TOOL_CALL_BLOCKED", "APPROVAL_REQUESTED")


def call_log_to_audit(decisions: DataFrame) -> DataFrame:
    """Several audit rows a decision: received, decided, and what came of it; redactions and injections as rows of their own.

    ``audit_id`` is the request and the place of the row among its rows.
    """
    row = lambda action, severity="INFO": F.struct(F.lit(action).alias("action"), F.lit(severity).alias("severity"))
    act, rule = F.col("action"), F.col("rule")
    outcome = F.when(act == "BLOCK", row("TOOL_CALL_BLOCKED", "WARN")).when(act == "REQUIRES_APPROVAL", row("APPROVAL_REQUESTED", "WARN")).otherwise(row("TOOL_CALL_EXECUTED"))
    rows = F.array_compact(F.array(row("TOOL_CALL_RECEIVED"), row("POLICY_DECISION"), F.when(act == "REDACT", row("PII_REDACTED")), F.when(rule == "prompt-injection", row("INJECTION_DETECTED", "WARN")), outcome))
    spread = decisions.select("request_id", "tenant_id", F.col("tool_name").alias("resource"), "ts", "rule", F.posexplode(rows).alias("pos", "a"))
    return spread.select(F.concat_ws(":", "request_id", F.col("pos").cast("string")).alias("audit_id"), "tenant_id", "resource", "ts", "rule", "a.action", "a.severity")


def audit_filter(audit: DataFrame, tenant=None, action=None, severity=None, since=None, until=None, limit: int = 200) -> DataFrame:
    """Newest first; every condition is optional and pushed to the scan."""
    for c, v in (("tenant_id", tenant), ("action", action), ("severity", severity)):
        audit = audit if v is None else audit.where(F.col(c) == v)
    audit = audit if since is None else audit.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    audit = audit if until is None else audit.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return audit.orderBy(F.desc("ts"), "audit_id").limit(limit)


def audit_search(audit: DataFrame, q: str, limit: int = 100, offset: int = 0, details: str = "rule") -> DataFrame:
    """Rows whose resource (any case) or details hold ``q``; one page, newest first, each with the total.

    The total is a separate aggregate, so that the page keeps its top-k plan.
    """
    escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = audit.where(F.col("resource").ilike(f"%{escaped}%") | F.col(details).contains(q))
    page = found.orderBy(F.desc("ts"), "audit_id").offset(offset).limit(min(limit, 1000))
    return page.withColumn("total", found.agg(F.count("*").alias("n")).scalar())


def _since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))


def audit_summary(audit: DataFrame, as_of: str, hours: int = 24 * 7) -> DataFrame:
    """Seven counts and two rates in one pass."""
    names = {"decisions": "POLICY_DECISION", "blocked": "TOOL_CALL_BLOCKED", "approvals_created": "APPROVAL_REQUESTED", "approvals_approved": "APPROVAL_GRANTED", "redactions": "PII_REDACTED", "injections": "INJECTION_DETECTED", "classifier_calls": "CLASSIFIER_INVOKED"}
    rows = audit.where(F.col("ts") >= _since(as_of, hours)).agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in names.items()])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumns({"block_rate": rate("blocked", "decisions"), "approval_rate": rate("approvals_approved", "approvals_created")})


def audit_timeline(audit: DataFrame, as_of: str, hours: int = 24 * 7, buckets: int = 24) -> DataFrame:
    """Counts in equal buckets, zero where there is nothing: ``bucket, decisions, blocked, approvals, redactions``."""
    width = max(60.0, hours * 3600 / buckets)
    since = _since(as_of, hours)
    at = F.floor((F.unix_micros("ts") - F.unix_micros(since)) / 1e6 / width)
    index = F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("int")
    series = {"decisions": "POLICY_DECISION", "blocked": "TOOL_CALL_BLOCKED", "approvals": "APPROVAL_REQUESTED", "redactions": "PII_REDACTED"}
    counts = audit.where(F.col("ts") >= since).groupBy(index.alias("bucket")).agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in series.items()])
    spine = audit.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in series])


def top_tools(audit: DataFrame, as_of: str, hours: int = 24 * 7, k: int = 25) -> DataFrame:
    rows = audit.where((F.col("ts") >= _since(as_of, hours)) & F.col("resource").isNotNull() & F.col("action").isin(*TOOL_ACTIONS))
    counts = rows.groupBy(F.col("resource").alias("tool")).agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in zip(("executed", "blocked", "approvals"), TOOL_ACTIONS, strict=True)])
    total = F.col("executed") + F.col("blocked") + F.col("approvals")
    return counts.withColumn("total", total).orderBy(F.desc("total"), "tool").limit(k)


def usage_by_month(audit: DataFrame, metric: str = "action") -> DataFrame:
    return audit.groupBy("tenant_id", F.col(metric).alias("metric"), F.trunc(F.col("ts").cast("date"), "month").cast("string").alias("month")).agg(F.count("*").alias("n"))


def plan_limit_check(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Usage against the tenant's limit; a null limit is unlimited and shown as -1."""
    joined = usage.join(plans, ["tenant_id"], "left")
    return joined.select("tenant_id", "metric", "month", "n", F.coalesce("monthly_limit", F.lit(-1)).alias("monthly_limit"), F.coalesce(F.col("n") > F.col("monthly_limit"), F.lit(False)).alias("over"))


def counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def latency_histogram(df: DataFrame, value: str, labels: Sequence[str], buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per bound with sum and count: one aggregate, spread afterwards."""
    agg = df.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)], F.sum(value).alias("total"), F.count(value).alias("n"))
    bounds = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("c")) for i, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("c"))]
    return agg.select(*labels, "total", "n", F.explode(F.array(*bounds)).alias("b")).select(*labels, "b.le", "b.c", "total", "n")


def latency_percentiles(df: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    """Mean, the values at place floor(n * q) for q of 0.5, 0.95, 0.99, and the maximum.

    Equal values are counted first, so what is ordered by label is the distinct values with their running counts.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*labels).orderBy(value)
    ranked = distinct.withColumn("_upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_n", F.sum("c").over(W.partitionBy(*labels)))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(q)), F.col(value)))
    return ranked.groupBy(*labels).agg((F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("max"))


def evaluate_labels(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Pass rates by category; ``truth``: key, category, action, rule (null: any rule will do)."""
    t = truth.select(key, "category", F.col("action").alias("_a"), F.col("rule").alias("_r"))
    ok = (F.col("action") == F.col("_a")) & (F.col("_r").isNull() | F.col("_r").eqNullSafe(F.col("rule")))
    return pred.join(t, key).groupBy("category").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.avg(ok.cast("int")).alias("rate"))


def binary_quality(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision and recall of boolean columns ``predicted`` and ``actual``."""
    p, a = F.col("predicted"), F.col("actual")
    agg = pred.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    rate = lambda d: F.when(d > 0, F.col("tp") / d).otherwise(0.0)
    return agg.withColumns({"precision": rate(F.col("tp") + F.col("fp")), "recall": rate(F.col("tp") + F.col("fn"))})


def tag_frequency(hints: DataFrame, tag: str = "framework") -> DataFrame:
    return hints.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
