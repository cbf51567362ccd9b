"""Queries over sequences of calls, flows, latencies, logs and dimensions, and replayed streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lanternwatch.functions.regexes import Pattern
from lanternwatch.operators import audit, flow, folds, ledger, pii, sequence
from lanternwatch.plans import content
from lanternwatch.plans.common import calls, query, table, texts
from lanternwatch.plans.policy import AS_OF, CLASS, flow_tables, spiked
from lanternwatch.sources.calls import CALLS_SQL

DAY_US = 86400 * 1_000_000
WINDOWS = {"n_1h": 3600, "n_1d": 86400, "n_7d": 7 * 86400}


def _range(us: int, key: str) -> str:
    return f"count(*) OVER (PARTITION BY {key} ORDER BY epoch_us(ts) RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"


@query("w1_rolling_counts", "SELECT request_id, " + ", ".join(f"{_range(s * 1_000_000, 'tenant_id, agent_id, tool_name')} AS {n}" for n, s in WINDOWS.items()) + " FROM calls", calls_sql=True)
def w1(spark, sf):
    return sequence.rolling_counts(calls(spark, sf), WINDOWS).select("request_id", *WINDOWS)


_SEVERE = f"({CLASS}) IN ('DESTRUCTIVE', 'EXTERNAL_SIDE_EFFECT')"


@query("w2_detect_burst", f"SELECT request_id, n >= t AS burst, CASE WHEN n >= t THEN least(1.0::DOUBLE, n / (2 * t)) ELSE 0.0::DOUBLE END AS burst_score FROM (SELECT request_id, {_range(DAY_US, 'user_id')} AS n, CASE WHEN {_SEVERE} THEN 5 ELSE 7 END AS t FROM calls)", calls_sql=True)
def w2(spark, sf):
    counted = sequence.rolling_counts(calls(spark, sf), {"n": 86400}, ["user_id"])
    return sequence.detect_burst(counted, "n", 5, 7).select("request_id", "burst", "burst_score")


@query("w3_detect_first_seen", f"SELECT request_id, first_seen, CASE WHEN first_seen THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS first_seen_score FROM (SELECT request_id, row_number() OVER (PARTITION BY tenant_id, agent_id, tool_name ORDER BY ts, request_id) = 1 AND {_SEVERE} AS first_seen FROM calls)", calls_sql=True)
def w3(spark, sf):
    return sequence.detect_first_seen(calls(spark, sf)).select("request_id", "first_seen", "first_seen_score")


#: The fold of the exponential mean and variance, row by row of a key.
_SPIKE_SQL = f"""WITH RECURSIVE calls AS ({CALLS_SQL}),
seq AS (SELECT request_id, tenant_id, agent_id, tool_name, {_range(3600 * 1_000_000, 'tenant_id, agent_id, tool_name')} AS h, {_range(60 * 1_000_000, 'tenant_id, agent_id, tool_name')} AS n, row_number() OVER (PARTITION BY tenant_id, agent_id, tool_name ORDER BY ts, request_id) AS r FROM calls),
fold AS (SELECT *, 0.2::DOUBLE * h AS m, 0.2::DOUBLE * h * h AS v FROM seq WHERE r = 1
         UNION ALL SELECT s.*, 0.8::DOUBLE * f.m + 0.2::DOUBLE * s.h, 0.8::DOUBLE * f.v + 0.2::DOUBLE * (s.h - f.m) * (s.h - f.m) FROM fold f JOIN seq s ON s.tenant_id = f.tenant_id AND s.agent_id = f.agent_id AND s.tool_name = f.tool_name AND s.r = f.r + 1),
zed AS (SELECT *, (n * 60 - m) / greatest(sqrt(v), 1.0::DOUBLE) AS z FROM fold),
spikes AS (SELECT *, r > 10 AND v > 0 AND z >= 3 AS spike, CASE WHEN r > 10 AND v > 0 AND z >= 3 THEN least(1.0::DOUBLE, z / 10) ELSE 0.0::DOUBLE END AS spike_score, CASE WHEN {_SEVERE} THEN 5 ELSE 20 END AS t FROM zed)"""


@query("w4_ewma", f"SELECT request_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_slice(xs, 1, r)), lambda m, x: 0.8 * m + 0.2 * x), 6) AS ewma FROM (SELECT request_id, row_number() OVER w AS r, list(x) OVER (PARTITION BY tenant_id, agent_id, tool_name ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs FROM (SELECT *, {_range(3600 * 1_000_000, 'tenant_id, agent_id, tool_name')}::DOUBLE AS x FROM calls) WINDOW w AS (PARTITION BY tenant_id, agent_id, tool_name ORDER BY ts, request_id))", calls_sql=True)
def w4(spark, sf):
    smoothed = sequence.ewma(sequence.rolling_counts(calls(spark, sf), {"n_1h": 3600}))
    return smoothed.select("request_id", F.round("ewma", 6).alias("ewma"))


def _spiked(spark, sf):
    return spiked(calls(spark, sf))


@query("w5_detect_spike", _SPIKE_SQL + " SELECT request_id, round(z, 6) AS z, spike, round(spike_score, 6) AS spike_score FROM spikes")
def w5(spark, sf):
    return _spiked(spark, sf).select("request_id", F.round("z", 6).alias("z"), "spike", F.round("spike_score", 6).alias("spike_score"))


@query("w6_detect_anomaly", _SPIKE_SQL + f" SELECT request_id, CASE WHEN h >= t THEN 'burst' WHEN r = 1 AND {_SEVERE} THEN 'first_seen' WHEN spike THEN 'spike' END AS kind, round(CASE WHEN h >= t THEN least(1.0::DOUBLE, h / (2 * t)) WHEN r = 1 AND {_SEVERE} THEN 0.55::DOUBLE ELSE spike_score END, 6) AS score FROM spikes")
def w6(spark, sf):
    rows = sequence.detect_first_seen(sequence.detect_burst(_spiked(spark, sf), "n_1h", 5, 20))
    return sequence.detect_anomaly(rows).select("request_id", "kind", F.round("score", 6).alias("score"))


def _chain_tests() -> dict[str, str]:
    """SQL that says whether the last calls match, by chain."""
    found = {}
    for c in sequence.CHAINS:
        k = len(c.steps)
        tests = [f"coalesce(regexp_matches({'tool_name' if k - 1 - i == 0 else f't{k - 1 - i}'}, '{s}') AND {'TRUE' if k - 1 - i == 0 else f'a{k - 1 - i}'}, FALSE)" for i, s in enumerate(c.steps)]
        if c.trigger:
            tests.append(Pattern("", c.trigger, "i").sql_found("args"))
        if c.unless:
            tests.append("NOT " + Pattern("", c.unless, "i").sql_found("args"))
        found[c.name] = " AND ".join(tests)
    return found


def _chain_case() -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in _chain_tests().items()) + " END"


_LAGGED = f"SELECT *, lag(tool_name, 1) OVER w AS t1, lag(tool_name, 2) OVER w AS t2, epoch_us(ts) - epoch_us(lag(ts, 1) OVER w) <= {DAY_US} AS a1, epoch_us(ts) - epoch_us(lag(ts, 2) OVER w) <= {DAY_US} AS a2, (epoch_us(ts) - greatest(min(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW), epoch_us(lag(ts, 49) OVER w))) / 1e6 AS span FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)"


@query("w7_detect_chains", f"SELECT request_id, session_id, chain_id FROM (SELECT request_id, session_id, {_chain_case()} AS chain_id FROM (SELECT *, lag(tool_name, 1) OVER w AS t1, lag(tool_name, 2) OVER w AS t2, epoch_us(ts) - epoch_us(lag(ts, 1) OVER w) <= {DAY_US} AS a1, epoch_us(ts) - epoch_us(lag(ts, 2) OVER w) <= {DAY_US} AS a2 FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id))) WHERE chain_id IS NOT NULL", calls_sql=True)
def w7(spark, sf):
    return sequence.detect_chains(calls(spark, sf), window=86400).select("request_id", "session_id", "chain_id")


_SEVERITY = "CASE chain_id " + " ".join(f"WHEN '{c.name}' THEN {c.severity}::DOUBLE" for c in sequence.CHAINS) + " END"


#: Outputs of reading calls and calls with their bodies, of real sessions; pairs within the time to live, the newest 50 outputs a call.
_SQL_OUT = "o AS (SELECT request_id AS source_id, session_id, ts AS ots, tool_name AS st, text AS output FROM calls JOIN documents ON event_id % (SELECT count(*) FROM documents) = doc_id WHERE tool_name IN ('browser.fetch', 'http.fetch', 'filesystem.read', 'gmail.read_email'))"
_SQL_IN = """src AS (SELECT *, (CASE WHEN event_id % 4 = 1 THEN coalesce(last_value(CASE WHEN tool_name IN ('browser.fetch', 'http.fetch', 'filesystem.read', 'gmail.read_email') THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) ELSE event_id END) % (SELECT count(*) FROM documents) AS doc FROM calls),
c AS (SELECT request_id, session_id, ts, tool_name, coalesce(text, '') || ' ' || phrase AS args FROM src LEFT JOIN documents ON doc = doc_id)"""
_SINK = "c.tool_name IN ('gmail.send_email', 'slack.send_message', 'sms.send', 'webhook.send', 'http.post', 'social.publish_with_approval', 'github.create_issue', 'github.create_pr_comment', 'postgres.query', 'supabase.query')"


def _pairs(name: str, seconds: int, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT c.request_id, c.tool_name, args, source_id, st, output FROM c JOIN o ON c.session_id = o.session_id AND epoch_us(c.ts) - epoch_us(ots) > 0 AND epoch_us(c.ts) - epoch_us(ots) < {seconds * 1_000_000} WHERE {where} QUALIFY row_number() OVER (PARTITION BY c.request_id ORDER BY ots DESC, source_id DESC) <= 50)"


_NEEDLES = "SELECT request_id, source_id, count(*) AS n_needles FROM (SELECT request_id, source_id, args, substr(output, i + 1, 60) AS x FROM (SELECT *, unnest([0, 200, 400, 600, 800]) AS i FROM {}) WHERE i < length(output)) WHERE length(x) >= 12 AND contains(args, x) GROUP BY 1, 2"
_PIECES = "SELECT request_id, source_id FROM {} WHERE len(list_filter(range(0, 971, 30), lambda i: i + 30 <= length(output) AND contains(args, substr(output, i + 1, 30)))) > 0"
_SHINGLE = "list_distinct(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')))"
_TOK = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_ALIKE = f"""SELECT request_id, source_id, similarity FROM (SELECT request_id, source_id, len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM (SELECT request_id, source_id, (SELECT {_SHINGLE} FROM (SELECT {_TOK.format("output")} AS w)) AS a, (SELECT {_SHINGLE} FROM (SELECT {_TOK.format("args")} AS w)) AS b FROM <pairs>) WHERE len(a) > 0 AND len(b) > 0) WHERE similarity >= 0.3"""


@query("w8_chain_confidence", f", {_SQL_OUT}, {_SQL_IN}, {_pairs('p', 86400)}, flows AS ({_PIECES.format('p')}) SELECT request_id, chain_id, {_SEVERITY} AS severity, round(least(1.0::DOUBLE, {_SEVERITY} * least(1.0::DOUBLE, greatest(0.5::DOUBLE, 1 - (span - 60) / 86400)) * CASE WHEN request_id IN (SELECT request_id FROM flows) THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END), 6) AS confidence, n_chains FROM (SELECT request_id, span, {_chain_case()} AS chain_id, {' + '.join(f'({t})::INT' for t in _chain_tests().values())} AS n_chains FROM ({_LAGGED})) WHERE chain_id IS NOT NULL", calls_sql=True)
def w8(spark, sf):
    """With the data flow of earlier outputs into each call's body."""
    outputs, bodies, fetch = flow_tables(spark, sf)
    flows = flow.dataflow_join(outputs, bodies, window=86400, fetch=fetch)
    found = sequence.detect_chains(calls(spark, sf), window=86400, flows=flows)
    return found.select("request_id", "chain_id", "severity", F.round("confidence", 6).alias("confidence"), F.size("all_chains").alias("n_chains"))


@query("w9_session_history", f"SELECT session_id, request_id FROM (SELECT session_id, request_id, max(epoch_us(ts)) OVER (PARTITION BY session_id) - epoch_us(ts) AS age, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS r FROM calls) WHERE r <= 50 AND age <= {DAY_US}", calls_sql=True)
def w9(spark, sf):
    return sequence.session_history(calls(spark, sf), 86400).select("session_id", "request_id")


_EVENTS = "SELECT 'ap_' || (event_id - event_id % 3) AS approval_id, CASE event_id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'approve' ELSE 'reject' END AS event, ts, ts + INTERVAL 1 DAY AS expires_at FROM calls WHERE event_id % 3 = 0 OR event_id % 7 = 1"


def _approval_events(spark, sf):
    return _as_approvals(calls(spark, sf))


def _as_approvals(c):
    kind = F.col("event_id") % 3
    return c.where("event_id % 3 = 0 OR event_id % 7 = 1").select(F.concat(F.lit("ap_"), (F.col("event_id") - kind).cast("string")).alias("approval_id"), F.when(kind == 0, "create").when(kind == 1, "approve").otherwise("reject").alias("event"), "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


@query("w10_approval_state", f", e AS ({_EVENTS}), l AS (SELECT approval_id, arg_max(event, (ts, event)) AS event, arg_max(expires_at, (ts, event)) AS x FROM e GROUP BY 1) SELECT approval_id, CASE WHEN event = 'approve' THEN 'APPROVED' WHEN event = 'reject' THEN 'REJECTED' WHEN x < TIMESTAMP '{AS_OF}' THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM l", calls_sql=True)
def w10(spark, sf):
    return sequence.approval_state(_approval_events(spark, sf), AS_OF).select("approval_id", "status")


@query("f3_pending_approvals", f", e AS ({_EVENTS}), l AS (SELECT approval_id, arg_max(event, (ts, event)) AS event, arg_max(expires_at, (ts, event)) AS x, min(ts) AS created FROM e GROUP BY 1) SELECT approval_id, created FROM l WHERE event = 'create' AND x >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY ORDER BY created DESC, approval_id LIMIT 100", calls_sql=True)
def f3(spark, sf):
    """The newest hundred that were pending twenty days before the last day."""
    return sequence.pending_approvals(_approval_events(spark, sf), "2024-01-11 00:00:00").select("approval_id", "created")


@query("a12_active_approvals", f", e AS ({_EVENTS}), l AS (SELECT approval_id, arg_max(event, (ts, event)) AS event, arg_max(expires_at, (ts, event)) AS x FROM e GROUP BY 1) SELECT count(*) FILTER (event = 'create' AND x >= TIMESTAMP '{AS_OF}') AS pending, count(*) AS n FROM l", calls_sql=True)
def a12(spark, sf):
    state = sequence.approval_state(_approval_events(spark, sf), AS_OF)
    return state.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count("*").alias("n"))


_PAUSES = "SELECT 'p_' || event_id AS pause_id, user_id AS scope_key, ts AS start_ts, ts + INTERVAL 2 HOUR AS end_ts FROM calls WHERE event_id % 4 = 0"
_RESUMES = "SELECT 'p_' || event_id AS pause_id, ts + INTERVAL 40 MINUTE AS ts FROM calls WHERE event_id % 8 = 0"


def _pauses(spark, sf):
    return calls(spark, sf).where("event_id % 4 = 0").select(F.concat(F.lit("p_"), F.col("event_id").cast("string")).alias("pause_id"), F.lit("user").alias("scope"), F.col("user_id").alias("scope_key"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_ts"), F.when(F.col("event_id") % 16 == 0, "too short").otherwise("planned maintenance of the mail gateway").alias("reason"))


@query("w11_pause_effective", f""", p AS ({_PAUSES}), r AS ({_RESUMES}), e AS (SELECT p.pause_id, scope_key, p.start_ts, least(p.end_ts, coalesce(r.ts, p.end_ts)) AS end_ts, r.ts IS NOT NULL AS by_resume FROM p LEFT JOIN r USING (pause_id)),
b AS (SELECT request_id, pause_id FROM calls JOIN e ON user_id = scope_key AND ts >= start_ts AND ts < end_ts QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY start_ts DESC, pause_id) = 1),
n AS (SELECT pause_id, count(*) AS n FROM b GROUP BY 1)
SELECT pause_id, start_ts, end_ts, by_resume, coalesce(n, 0) AS calls_observed, CASE WHEN by_resume THEN substr(pause_id, 3)::BIGINT % 16 = 0 ELSE coalesce(n, 0) > 0 END AS scrutiny_opened FROM e LEFT JOIN n USING (pause_id)""", calls_sql=True)
def w11(spark, sf):
    """Pauses of users with the calls that they let through; every other resume names a session."""
    c = calls(spark, sf)
    resumes = c.where("event_id % 8 = 0").select(F.concat(F.lit("p_"), F.col("event_id").cast("string")).alias("pause_id"), (F.col("ts") + F.expr("INTERVAL 40 MINUTES")).alias("ts"), F.when(F.col("event_id") % 16 == 0, F.col("session_id")).alias("session_id"))
    found = flow.pause_effective(_pauses(spark, sf), resumes, c.select("request_id", "ts", "session_id", "user_id", "tenant_id"))
    return found.select("pause_id", "start_ts", "end_ts", "by_resume", "calls_observed", "scrutiny_opened")


@query("r15_validate_pauses", ", p AS (SELECT event_id, 'p_' || event_id AS pause_id, user_id, ts AS s, ts + INTERVAL 2 HOUR AS e, CASE WHEN event_id % 16 = 0 THEN 'REASON_TOO_SHORT' END AS r FROM calls WHERE event_id % 4 = 0) SELECT pause_id, coalesce(r, CASE WHEN max(CASE WHEN r IS NULL THEN e END) OVER (PARTITION BY user_id ORDER BY s, pause_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 'ALREADY_PAUSED' END) AS refused FROM p", calls_sql=True)
def r15(spark, sf):
    return flow.validate_pauses(_pauses(spark, sf), longest=7200)


_USES = "SELECT request_id, ts, 'jti_' || (event_id % 4000) AS jti, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'me' END AS issuer, ts + (event_id % 13 - 1) * INTERVAL 1 MINUTE AS exp, CASE WHEN event_id % 17 = 0 THEN 't9' ELSE tenant_id END AS ct, tenant_id FROM calls"


@query("w12_token_use_audit", f", u AS ({_USES}), x AS (SELECT *, CASE WHEN issuer <> 'me' THEN 'wrong-issuer' WHEN exp < ts THEN 'expired' WHEN ct <> tenant_id THEN 'tenant' END AS r FROM u) SELECT request_id, jti, coalesce(r, CASE WHEN sum((r IS NULL)::INT) OVER (PARTITION BY jti ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'replay' END) AS refused FROM x", calls_sql=True)
def w12(spark, sf):
    e = F.col("event_id")
    uses = calls(spark, sf).select("request_id", "ts", F.concat(F.lit("jti_"), (e % 4000).cast("string")).alias("jti"), F.when(e % 11 == 0, "other").otherwise("me").alias("issuer"), (F.col("ts") + F.make_dt_interval(mins=(e % 13 - 1).cast("int"))).alias("exp"), F.when(e % 17 == 0, "t9").otherwise(F.col("tenant_id")).alias("claim_tenant"), "tenant_id", F.col("tool_name").alias("claim_tool"), "tool_name", F.lit("h").alias("claim_args_hash"), F.lit("h").alias("args_hash"))
    return sequence.token_use_audit(uses, "me")


@query("w13_outage_intervals", ", o AS (SELECT request_id, tool_name AS target, ts, k % 4 = 0 AS ok FROM calls), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY target ORDER BY ts, request_id) AS g FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY target, g ORDER BY ts, request_id) AS n FROM i WHERE NOT ok) SELECT target, min(CASE WHEN n = 5 THEN ts END) AS opened, max(ts) + INTERVAL 30 SECOND AS until, count(*) AS n FROM f GROUP BY target, g HAVING count(*) >= 5", calls_sql=True)
def w13(spark, sf):
    return sequence.outage_intervals(calls(spark, sf).select("request_id", F.col("tool_name").alias("target"), "ts", (F.col("k") % 4 == 0).alias("success")))


_CIRCUIT_SQL = f"""WITH RECURSIVE calls AS ({CALLS_SQL}),
seq AS (SELECT request_id, tool_name AS target, epoch_us(ts) AS us, k % 4 = 0 AS ok, row_number() OVER (PARTITION BY tool_name ORDER BY ts, request_id) AS r FROM calls),
fold AS (SELECT target, 0::BIGINT AS r, NULL::VARCHAR AS request_id, TRUE AS allowed, 'CLOSED' AS state, 'CLOSED' AS after, 0::BIGINT AS failures, 0::BIGINT AS opened FROM (SELECT DISTINCT target FROM seq)
  UNION ALL
  SELECT target, r, request_id, now <> 'OPEN', now, after, CASE WHEN now = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN now <> 'OPEN' AND after = 'OPEN' THEN us ELSE opened END
  FROM (SELECT *, CASE WHEN now = 'OPEN' THEN 'OPEN' WHEN ok THEN 'CLOSED' WHEN now = 'HALF_OPEN' OR failures + 1 >= 5 THEN 'OPEN' ELSE 'CLOSED' END AS after
        FROM (SELECT s.target, s.r, s.request_id, s.us, s.ok, f.failures, f.opened, CASE WHEN f.after = 'OPEN' AND s.us - f.opened >= 21600000000 THEN 'HALF_OPEN' ELSE f.after END AS now FROM fold f JOIN seq s ON s.target = f.target AND s.r = f.r + 1)))
SELECT target, request_id, allowed, state, after, failures FROM fold WHERE r > 0"""


def _outcomes(c):
    return c.select("request_id", F.col("tool_name").alias("target"), "ts", (F.col("k") % 4 == 0).alias("success"))


@query("w13_outage_states", _CIRCUIT_SQL)
def w13_states(spark, sf):
    return sequence.outage_states(_outcomes(calls(spark, sf)), 5, 21600)


@query("w14_token_bucket_flags", f"""WITH RECURSIVE calls AS ({CALLS_SQL}),
seq AS (SELECT request_id, tenant_id AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS r FROM calls),
fold AS (SELECT *, TRUE AS allowed, 9.0::DOUBLE AS remaining FROM seq WHERE r = 1
         UNION ALL SELECT x.request_id, x.key, x.us, x.r, level >= 1, CASE WHEN level >= 1 THEN level - 1 ELSE level END FROM (SELECT s.*, least(10.0::DOUBLE, f.remaining + (s.us - f.us) / 1e6::DOUBLE * (1::DOUBLE / 3600)) AS level FROM fold f JOIN seq s ON s.key = f.key AND s.r = f.r + 1) x)
SELECT request_id, key, allowed, round(remaining, 6) AS remaining FROM fold""")
def w14(spark, sf):
    return sequence.token_bucket_flags(calls(spark, sf), "tenant_id", 10.0, 1 / 3600).select("request_id", "key", "allowed", F.round("remaining", 6).alias("remaining"))


@query("w15_cached_advice", f"""WITH RECURSIVE calls AS ({CALLS_SQL}),
seq AS (SELECT request_id, tool_name, arg_sql, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tool_name, arg_sql ORDER BY ts, request_id) AS r FROM calls),
fold AS (SELECT *, us + 36000000000 AS ends, FALSE AS cached FROM seq WHERE r = 1
         UNION ALL SELECT s.*, CASE WHEN s.us <= f.ends THEN f.ends ELSE s.us + 36000000000 END, s.us <= f.ends FROM fold f JOIN seq s ON s.tool_name = f.tool_name AND s.arg_sql = f.arg_sql AND s.r = f.r + 1)
SELECT request_id, cached FROM fold""")
def w15(spark, sf):
    return sequence.cached_advice(calls(spark, sf), ["tool_name", "arg_sql"], 36000).select("request_id", "cached")


@query("a11_activity_snapshot", _SPIKE_SQL + f", newest AS (SELECT tenant_id, agent_id, tool_name, arg_max(m, r) AS ewma FROM fold GROUP BY ALL) SELECT tenant_id, agent_id, tool_name, count(*) AS total, " + ", ".join(f"count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) BETWEEN 0 AND {s * 1_000_000}) AS {n}" for n, s in (("last_1m", 60), ("last_1h", 3600), ("last_1d", 86400))) + ", round(max(ewma), 6) AS ewma_1h FROM calls JOIN newest USING (tenant_id, agent_id, tool_name) GROUP BY ALL")
def a11(spark, sf):
    c = calls(spark, sf)
    smoothed = sequence.ewma(sequence.rolling_counts(c, {"n_1h": 3600}))
    return sequence.activity_snapshot(c, AS_OF, smoothed=smoothed).withColumn("ewma_1h", F.round("ewma_1h", 6))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("a6_latency_histogram", "SELECT tool_name, le, count(*) FILTER (value <= b) AS c, round(sum(value), 4) AS total, count(value) AS n FROM calls, (VALUES " + ", ".join(f"('{b}', {b}::DOUBLE)" for b in _BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)) t(le, b) GROUP BY ALL", calls_sql=True)
def a6(spark, sf):
    return audit.latency_histogram(calls(spark, sf), "value", ["tool_name"], _BOUNDS).withColumn("total", F.round("total", 4))


@query("a7_latency_percentiles", "SELECT tool_name, round(avg(value), 6) AS mean, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99, max(value) AS max FROM (SELECT tool_name, value, list(value ORDER BY value) OVER (PARTITION BY tool_name) AS v FROM calls) GROUP BY tool_name, v", calls_sql=True)
def a7(spark, sf):
    return audit.latency_percentiles(calls(spark, sf), "value", ["tool_name"]).withColumn("mean", F.round("mean", 6))


@query("a10_best_finding_per_type", f"SELECT doc_id, type, min(sample) AS sample, round(max(confidence), 6) AS confidence FROM ({content.simple_sql()}) GROUP BY 1, 2")
def a10(spark, sf):
    found = pii.scan_pii(texts(spark, sf, "documents"), ["doc_id"], layers=content.SIMPLE)
    return pii.best_finding_per_type(found, ["doc_id"]).withColumn("confidence", F.round("confidence", 6))


@query("k3_last_per_key", "SELECT user_id, request_id FROM calls QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) <= 3", calls_sql=True)
def k3(spark, sf):
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("request_id")))
    return calls(spark, sf).withColumn("_r", newest).where("_r <= 3").select("user_id", "request_id")


@query("j1_taint_verbatim", f", {_SQL_OUT}, {_SQL_IN}, {_pairs('p', 14400)} {_NEEDLES.format('p')}", calls_sql=True)
def j1(spark, sf):
    outputs, bodies, fetch = flow_tables(spark, sf)
    found = flow.taint_verbatim(outputs, bodies, ttl=14400, fetch=fetch)
    return found.select("request_id", "source_id", F.col("n_needles").cast("long").alias("n_needles"))


@query("j2_taint_similarity", f", {_SQL_OUT}, {_SQL_IN}, {_pairs('p', 14400)} SELECT request_id, source_id, round(similarity, 6) AS similarity FROM ({_ALIKE.replace('<pairs>', 'p')})", calls_sql=True)
def j2(spark, sf):
    outputs, bodies, fetch = flow_tables(spark, sf)
    found = flow.taint_similarity(outputs, bodies, ttl=14400, fetch=fetch)
    return found.select("request_id", "source_id", F.round("similarity", 6).alias("similarity"))


@query("j2_shingle_overlap", f"WITH b AS (SELECT item_id, {_SHINGLE} AS s FROM (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark)), d AS (SELECT doc_id, {_SHINGLE} AS s FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)), x AS (SELECT item_id, len(s) AS na, unnest(s) AS h FROM b), y AS (SELECT doc_id, len(s) AS nb, unnest(s) AS h FROM d) SELECT item_id, doc_id, count(*) AS shared, round(count(*) / (na + nb - count(*)), 6) AS jaccard, round(count(*) / na, 6) AS containment FROM x JOIN y USING (h) GROUP BY item_id, doc_id, na, nb")
def j2_overlap(spark, sf):
    found = flow.shingle_overlap(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", "text", "text")
    return found.withColumns({"jaccard": F.round("jaccard", 6), "containment": F.round("containment", 6)})


@query("j3_taint_flows", f", {_SQL_OUT}, {_SQL_IN}, {_pairs('p', 14400, _SINK)}, v AS ({_NEEDLES.format('p')}), s AS ({_ALIKE.replace('<pairs>', 'p')}) SELECT request_id, source_id, bool_or(verbatim) AS verbatim FROM (SELECT request_id, source_id, TRUE AS verbatim FROM v UNION ALL SELECT request_id, source_id, FALSE FROM s) GROUP BY 1, 2", calls_sql=True)
def j3(spark, sf):
    outputs, bodies, fetch = flow_tables(spark, sf)
    return flow.taint_flows(outputs, bodies, ttl=14400, fetch=fetch)


@query("j4_dataflow_join", f", {_SQL_OUT}, {_SQL_IN}, {_pairs('p', 14400)} {_PIECES.format('p')}", calls_sql=True)
def j4(spark, sf):
    outputs, bodies, fetch = flow_tables(spark, sf)
    return flow.dataflow_join(outputs, bodies, window=14400, fetch=fetch)


@query("j7_resolve_api_keys", ", k AS (SELECT event_id, request_id, 'lw_' || user_id AS raw FROM calls), s AS (SELECT DISTINCT sha256('lw_' || user_id) AS h, 'key_' || user_id AS key_id, user_id FROM calls WHERE user_id < 'u5') SELECT request_id, key_id, coalesce(key_id IS NOT NULL AND NOT ends_with(user_id, '3') AND (ends_with(user_id, '1') OR ends_with(user_id, '2')), FALSE) AS allowed FROM k LEFT JOIN s ON sha256(raw) = h", calls_sql=True)
def j7(spark, sf):
    c = calls(spark, sf)
    user = F.col("user_id")
    scopes = F.when(user.endswith("1"), F.array(F.lit("read"))).when(user.endswith("2"), F.array(F.lit("admin"))).otherwise(F.array(F.lit("none")))
    keys = c.where("user_id < 'u5'").select("user_id").distinct().select(F.sha2(F.concat(F.lit("lw_"), user), 256).alias("key_hash"), F.concat(F.lit("key_"), user).alias("key_id"), scopes.alias("scopes"), F.when(user.endswith("3"), F.lit("2024-01-01")).alias("revoked_at"))
    return ledger.resolve_api_keys(c.select("request_id", F.concat(F.lit("lw_"), user).alias("raw_key")), keys, "read")


@query("j8_members", "SELECT n_nationkey AS tenant_id, c_custkey AS user_id, c_name AS name, c_acctbal AS joined_at FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j8(spark, sf):
    customer = table(spark, sf, "customer")
    links = customer.select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("joined_at"))
    links = links.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant_id")), "tenant_id", "left_semi")
    return ledger.members(links, customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")))


@query("j9_connector_gaps", "SELECT c_nationkey AS tenant_id, 'order' AS connector, c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j9(spark, sf):
    needed = table(spark, sf, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.lit("order").alias("connector"), F.col("c_custkey").alias("name"))
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("tenant_id"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("name")).distinct().join(nation, "name").withColumn("connector", F.lit("order"))
    return ledger.connector_gaps(needed, held)


@query("t1_stream_burst", "SELECT tenant_id, agent_id, tool_name, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM calls GROUP BY ALL", calls_sql=True)
def t1(spark, sf):
    """The events replayed as a stream into day windows, and read back from the sink."""
    from lanternwatch.streaming import calls as streams

    counted = _replayed(spark, sf, "complete", lambda rows: streams.burst_counts(rows, "1 day", "1 day"))
    return counted.select("tenant_id", "agent_id", "tool_name", F.unix_micros("window.start").alias("start_us"), "n")


@query("t11_stream_rules", "SELECT request_id FROM calls WHERE regexp_matches(tool_name, 'payment')", calls_sql=True)
def t11(spark, sf):
    """The payment rule over replayed calls."""
    from lanternwatch.operators import policy

    return _replayed(spark, sf, "append", lambda rows: policy.apply_rules(rows, [policy.RULES[4]])).select("request_id")


def _replayed(spark, sf, mode, job):
    """Runs a streaming job over the events file, with its state and sink in the shared folder."""
    import uuid

    from lanternwatch.sources.calls import calls_from_events
    from lanternwatch.streaming.shared import shared_folder

    events = table(spark, sf, "events")
    base = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").option("recursiveFileLookup", True).parquet(sf)
    rows = job(calls_from_events(stream))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _to_the_end(spark, sf, job):
    """A streaming job over the events and one event at the end of time, which moves the watermark past all others."""
    import uuid

    from lanternwatch.sources.calls import calls_from_events
    from lanternwatch.streaming.calls import replay
    from lanternwatch.streaming.shared import shared_folder

    events = table(spark, sf, "events")
    base = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    last = {"event_id": F.lit(LAST_EVENT), "ts": F.lit("2200-01-01 00:00:00"), "props": F.lit('{"k": 0}'), "user_id": F.lit(0), "event_type": F.lit("view")}
    spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(f"{base}/last")
    read = lambda glob, path: spark.readStream.schema(events.schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(path)
    rows = read("events*", sf).unionByName(read("*.parquet", f"{base}/last"))
    # each batch is written under its number, so one that is repeated after a failure replaces itself
    replay(job(calls_from_events(rows)), lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").drop("batch")


LAST_EVENT = 3 * 10**15
#: Groups of sessions or approvals in a stream, of which there are far more.
LANES = 1024


@query("t2_stream_anomaly", _SPIKE_SQL + f" SELECT request_id, h AS n_1h, round(m, 6) AS ewma, CASE WHEN h >= t THEN 'burst' WHEN r = 1 AND {_SEVERE} THEN 'first_seen' WHEN spike THEN 'spike' END AS kind, round(CASE WHEN h >= t THEN least(1.0::DOUBLE, h / (2 * t)) WHEN r = 1 AND {_SEVERE} THEN 0.55::DOUBLE ELSE spike_score END, 6) AS score FROM spikes")
def t2(spark, sf):
    from lanternwatch.streaming import calls as streams

    found = _to_the_end(spark, sf, lambda rows: streams.anomaly_state(rows, "0 seconds", folds.Anomaly(burst="n_1h")))
    return found.where(F.col("request_id") != f"req_{LAST_EVENT}").select("request_id", "n_1h", F.round("ewma", 6).alias("ewma"), "kind", F.round("score", 6).alias("score"))


@query("t3_stream_chains", f"SELECT request_id, chain_id, {_SEVERITY} AS severity, round(least(1.0::DOUBLE, {_SEVERITY} * least(1.0::DOUBLE, greatest(0.5::DOUBLE, 1 - (span - 60) / 86400)) * 0.85::DOUBLE), 6) AS confidence, n_chains FROM (SELECT request_id, span, {_chain_case()} AS chain_id, {' + '.join(f'({t})::INT' for t in _chain_tests().values())} AS n_chains FROM ({_LAGGED})) WHERE chain_id IS NOT NULL", calls_sql=True)
def t3(spark, sf):
    from lanternwatch.streaming import calls as streams

    found = _to_the_end(spark, sf, lambda rows: streams.chain_state(rows, "0 seconds", 86400, lanes=LANES))
    return found.select("request_id", "chain_id", "severity", F.round("confidence", 6).alias("confidence"), F.size("all_chains").alias("n_chains"))


@query("t8_stream_outages", _CIRCUIT_SQL)
def t8(spark, sf):
    from lanternwatch.streaming import calls as streams

    found = _to_the_end(spark, sf, lambda rows: streams.circuit_state(_outcomes(rows), 5, 21600, "0 seconds"))
    return found.where(F.col("request_id") != f"req_{LAST_EVENT}")


@query("t9_stream_approvals", f", e AS ({_EVENTS}), l AS (SELECT approval_id, arg_max(event, (ts, event)) AS event FROM e GROUP BY 1) SELECT approval_id, CASE event WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE 'EXPIRED' END AS status FROM l", calls_sql=True)
def t9(spark, sf):
    """The newest status of each approval at the end of time, when every one that still waited has expired by its timer."""
    from lanternwatch.streaming import calls as streams

    states = _to_the_end(spark, sf, lambda rows: streams.approval_states(_as_approvals(rows), "0 seconds", LANES)).where(F.col("approval_id") != f"ap_{LAST_EVENT}")
    return states.groupBy("approval_id").agg(F.max_by("status", F.struct("us", (F.col("status") == "EXPIRED").alias("last"))).alias("status"))
