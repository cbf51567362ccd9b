"""Streams equal their batch operators: shuffled rows, five batches, chunks of ten rows, late rows dropped."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lanternwatch.operators import flow, folds, sequence
from lanternwatch.streaming import calls as streams
from lanternwatch.streaming import ordered

BASE, SPAN, END = 1_000_000, 200, 10**8
TOOLS = ["filesystem.read", "webhook.send", "shell.run", "browser.fetch", "postgres.query", "filesystem.write", "social.create_draft", "social.publish_with_approval", "deploy"]
CALLS = "request_id string, tenant_id string, session_id string, agent_id string, tool_name string, args string, success boolean, scrutiny_calls int, s double"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """300 calls over 1 000 s in five files by time, shuffled, some up to 150 s behind, and one call at the end of time."""
    r, rows = random.Random(3), []
    for i in range(300):
        s = BASE + i * 3 + r.choice([0, 0, 0.25, 1])
        tool = r.choice(TOOLS) if i % 5 else "webhook.send"
        args = r.choice(["{}", '{"p": ".env"}', '{"q": "delete from t where a"}', '{"q": "drop it"}', '{"f": "backup.zip"}'])
        rows.append((f"r{r.randrange(10**6):06d}-{i}", f"t{i % 2}", f"s{i % 3}", "a", tool, args, r.random() < 0.3 or i % 50 > 45, 3 if i % 23 == 4 else 0, float(int(s) if i % 4 else s)))
    late = [x for x in rows if r.random() < 0.1]
    kept = [[x for x in rows if BASE + k * SPAN <= x[-1] < BASE + (k + 1) * SPAN and x not in late] for k in range(5)]
    for x in late:  # behind by a file at most, within the allowed lateness
        kept[min(4, int((x[-1] - BASE) // SPAN) + (1 if (x[-1] - BASE) % SPAN > 60 else 0))].append(x)
    too_late = [("late", "t0", "s0", "a", "webhook.send", "{}", False, 0, float(BASE + 1))]
    path = str(tmp_path_factory.mktemp("calls") / "in")
    frame = lambda x: spark.createDataFrame(x, CALLS).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    for k, part in enumerate(kept):
        r.shuffle(part)
        frame(part + (too_late if k == 4 else [])).coalesce(1).write.mode("append").parquet(path)
    frame([("end", "end", "end", "end", "end", "{}", True, 0, float(BASE + END))]).coalesce(1).write.mode("append").parquet(path)
    batch = frame(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield batch.cache(), lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


LATE = "150 seconds"


def replayed(job, folder) -> list:
    got: list = []
    streams.replay(job, lambda df, _: got.extend(df.collect()), str(folder / "state"))
    return got


def by_id(rows, *names):
    found = {r["request_id"]: tuple(round(r[n], 9) if isinstance(r[n], float) else tuple(r[n]) if isinstance(r[n], list) else r[n] for n in names) for r in rows if r["request_id"] != "end"}
    assert "late" not in found
    return found


def test_anomalies(world, tmp_path):
    batch, stream = world
    counted = sequence.rolling_counts(batch, {"n_1m": 60, "n_1h": 3600}).withColumn("total", F.row_number().over(sequence.W.partitionBy(*sequence.KEY).orderBy("ts", "request_id")))
    spiked = sequence.detect_spike(counted, sequence.ewma(counted), "total")
    want = by_id(sequence.detect_anomaly(sequence.detect_first_seen(sequence.detect_burst(spiked))).collect(), "n_1m", "n_1h", "ewma", "ewma_var", "z", "kind", "score")
    assert by_id(replayed(streams.anomaly_state(stream(), LATE), tmp_path), "n_1m", "n_1h", "ewma", "ewma_var", "z", "kind", "score") == want
    assert {"burst", "first_seen", None} <= {w[5] for w in want.values()}


@pytest.mark.parametrize("keep", [50, 4])
def test_chains(world, tmp_path, keep):
    batch, stream = world
    names = ("session_id", "chain_id", "severity", "all_chains", "confidence")
    want = by_id(sequence.detect_chains(batch, window=60, keep=keep).collect(), *names)
    got = by_id(replayed(streams.chain_state(stream(), LATE, 60, keep), tmp_path), *names)
    assert got == want and len({w[1] for w in want.values()}) > 5


def test_buckets_circuits_and_advice(world, tmp_path):
    batch, stream = world
    want = by_id(sequence.token_bucket_flags(batch, "session_id", 3.0, 0.05).collect(), "allowed", "remaining")
    assert by_id(replayed(streams.bucket_state(stream(), "session_id", 3.0, 0.05, LATE), tmp_path / "a"), "allowed", "remaining") == want
    assert len({w[0] for w in want.values()}) == 2
    target = lambda df: df.withColumnRenamed("tool_name", "target")
    names = ("allowed", "state", "after", "failures")
    want = by_id(sequence.outage_states(target(batch), 3, 40).collect(), *names)
    assert by_id(replayed(streams.circuit_state(target(stream()), 3, 40, LATE), tmp_path / "b"), *names) == want
    assert {w[1] for w in want.values()} == {"CLOSED", "OPEN", "HALF_OPEN"}
    by = ["tool_name", "args"]
    want = by_id(sequence.cached_advice(batch, by, 100).collect(), "cached")
    assert by_id(replayed(streams.advice_state(stream(), by, 100, LATE), tmp_path / "c"), "cached") == want


def test_scrutiny(world, tmp_path):
    batch, stream = world
    want = by_id(flow.scrutiny_windows(batch.where("scrutiny_calls > 0"), batch.where("scrutiny_calls = 0"), 20).collect(), "under_scrutiny", "calls_left")
    assert by_id(replayed(streams.scrutiny_state(stream(), 20, LATE), tmp_path), "under_scrutiny", "calls_left") == want
    assert any(w[0] for w in want.values())


def test_approvals_expire_by_timer(spark, tmp_path):
    r, rows = random.Random(9), []
    for a in range(40):
        made = BASE + r.randrange(900)
        rows.append((f"ap{a}", "create", made, made + r.choice([50, 100, 5000])))
        if r.random() < 0.6:
            rows.append((f"ap{a}", r.choice(["approve", "reject"]), made + r.choice([1, 20, 60, 140]), rows[-1][3]))
    frame = lambda x: spark.createDataFrame(x, "approval_id string, event string, s long, e long").select("approval_id", "event", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("e").alias("expires_at"))
    path = str(tmp_path / "in")
    for k in range(5):
        part = [x for x in rows if min(4, (x[2] - BASE) // SPAN) == k]
        r.shuffle(part)
        frame(part).coalesce(1).write.mode("append").parquet(path)
    frame([("end", "create", BASE + 2000, BASE + 9000)]).coalesce(1).write.mode("append").parquet(path)
    got = replayed(streams.approval_states(spark.readStream.schema(frame(rows).schema).option("maxFilesPerTrigger", 1).parquet(path), LATE), tmp_path)
    newest: dict = {}
    for x in sorted(got, key=lambda x: (x["us"], x["status"] == "EXPIRED")):
        newest[x["approval_id"]] = x["status"]
    as_of = spark.range(1).select(F.timestamp_seconds(F.lit(BASE + 2000 - 150)).cast("string")).first()[0]
    want = {x["approval_id"]: x["status"] for x in sequence.approval_state(frame(rows), as_of).collect()}
    assert {k: v for k, v in newest.items() if k != "end"} == want and set(want.values()) == {"APPROVED", "REJECTED", "EXPIRED", "PENDING"}
    decided_in_time = {x[0] for x in rows if x[1] != "create" and x[2] <= x[3]}
    assert not decided_in_time & {x["approval_id"] for x in got if x["status"] == "EXPIRED"}
    table = folds.fold_table(frame(rows).withColumn("request_id", F.col("event")), ["approval_id"], folds.Approval(), {"event": F.col("event"), "expires_us": F.unix_micros("expires_at")}, until=(BASE + 2000 - 150) * 1_000_000 + 1)
    assert sorted(map(tuple, table.collect())) == sorted(tuple(x) for x in got if x["approval_id"] != "end")


def test_states_end(spark, world, tmp_path):
    """After the end of time nothing is left of a session but the row that moved the watermark."""
    _, stream = world
    replayed(streams.chain_state(stream(), LATE, 60), tmp_path)
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "state").load()
    assert [x[0] for x in left.select("key.session_id").collect()] in ([], ["end"])


def test_cache_entry_is_not_renewed(spark):
    rows = spark.createDataFrame([("1", "k", 0), ("2", "k", 50), ("3", "k", 100), ("4", "k", 160), ("5", "k", 161), ("6", "x", 161)], "request_id string, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["request_id"]: r["cached"] for r in sequence.cached_advice(rows, ["k"], 60).collect()} == {"1": False, "2": True, "3": False, "4": True, "5": False, "6": False}


def test_circuit_probe(spark):
    outcomes = [(0, False), (1, False), (2, False), (3, True), (31, True), (32, False), (33, True), (40, False), (41, False), (42, False), (72, False), (73, True), (102, True), (103, True)]
    rows = spark.createDataFrame([(f"{i:02d}", "t", ok, s) for i, (s, ok) in enumerate(outcomes)], "request_id string, target string, success boolean, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r["allowed"], r["state"], r["after"]) for r in sorted(sequence.outage_states(rows, 3, 29).collect(), key=lambda r: r["request_id"])]
    assert got[3:5] == [(False, "OPEN", "OPEN"), (True, "HALF_OPEN", "CLOSED")] and got[9:] == [(True, "CLOSED", "OPEN"), (True, "HALF_OPEN", "OPEN"), (False, "OPEN", "OPEN"), (True, "HALF_OPEN", "CLOSED"), (True, "CLOSED", "CLOSED")]


def test_provider_is_set_only_where_it_is_the_default(spark):
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, "my.own.Provider")
    ordered.use_rocksdb(spark)
    assert spark.conf.get(ordered.PROVIDER) == "my.own.Provider"
    spark.conf.set(ordered.PROVIDER, before)


def test_sink_writes_each_batch_once(spark, tmp_path):
    """A failure between two tables, then the batch again, then a second batch."""
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    failing = streams.table_sink(str(tmp_path), {"a": lambda b: b, "b": lambda b: b.where("no_such_column")})
    with pytest.raises(Exception, match="no_such_column"):
        failing(rows("1", "2"), 0)
    sink = streams.table_sink(str(tmp_path), {"a": lambda b: b, "b": lambda b: b.where("id > '1'")})
    for number, batch in ((0, rows("1", "2")), (1, rows("3")), (1, rows("3"))):
        sink(batch, number)
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").select("id", "batch").collect())
    assert read("a") == [("1", 0), ("2", 0), ("3", 1)] and read("b") == [("2", 0), ("3", 1)]


def test_live_scan_of_all_rules(spark, tmp_path):
    rows = [("1", "shell.run", '{"command": "rm -rf /"}'), ("2", "submit_payment", "{}"), ("3", "filesystem.list", "{}")]
    calls = spark.createDataFrame(rows, "request_id string, tool_name string, args string").select("*", F.lit("t").alias("tenant_id"), F.lit("TENANT_ADMIN").alias("role"), F.timestamp_seconds(F.lit(BASE)).alias("ts"))
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.scan_live(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {(r["request_id"], r["rule"]) for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()}
    assert {("1", "dangerous-shell"), ("2", "payment")} <= found and not any(i == "3" for i, _ in found)
    audit = spark.read.parquet(str(tmp_path / "out/audit"))
    assert audit.where("batch = 0").count() == audit.count() >= 6


def test_lanes_give_what_keys_give(world, tmp_path):
    """Keys that share groups by hash, released in slices."""
    batch, read = world
    want = by_id(replayed(streams.chain_state(read(), LATE, 60), tmp_path / "keys"), "session_id", "chain_id", "confidence")
    assert want and by_id(replayed(streams.chain_state(read(), LATE, 60, lanes=2), tmp_path / "lanes"), "session_id", "chain_id", "confidence") == want
