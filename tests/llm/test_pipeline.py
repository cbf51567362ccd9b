"""The stages of the pipeline, each against a plain version on its own input, and names that could clash."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from lanternwatch.llm import decontamination, lines, minhash, mixing

SF = "/root/testdata/sf0.001"


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, rows = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, SF), name)
        rows[name] = at.collect()
        if name != "mixing":
            assert at.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    ids = {n: Counter(r["doc_id"] for r in found) for n, found in rows.items()}
    # quality: bad labels go, good ones stay, nearly always
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in ids["quality"]) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    assert ids["line_dedup"] == ids["quality"]
    # near-duplicates: what is left has no link, what went had one
    texts = {r["doc_id"]: r["text"] for r in rows["line_dedup"]}
    sets = {i: _sets(t) for i, t in texts.items()}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = set(ids["near_dedup"])
    assert not [(a, b) for a in kept for b in kept if a < b and linked(a, b)]
    assert all(any(linked(i, j) for j in texts if j != i) for i in texts if i not in kept)
    # decontamination: no window of 10 words of an item is left, and only such documents went
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    for r in rows["near_dedup"]:
        w = words(r["text"])
        hit = any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
        assert (r["doc_id"] in ids["decontamination"]) != hit
    # mixing: copies as the schedule says, no document over twice
    report = {r["doc_id"]: r["n_taken"] for r in mixing.mix_report(spark.createDataFrame(rows["decontamination"], docs.schema)).collect()}
    assert ids["mixing"] == Counter({i: n for i, n in report.items() if n}) and max(ids["mixing"].values()) <= 2
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == set(ids["mixing"])


def test_clashing_names_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(5)
    names = ["k", "row", "drop", "hits", "_k", "_dk", "_pk", "_drop", "_hits", "finish", "epoch", "line_no", "h", "node"]
    odd = docs.withColumns({n: F.lit("clash") for n in names})
    for job in (lambda d: decontamination.drop_contaminated(d, bench), lambda d: decontamination.strip_contaminated(d, bench), minhash.drop_near_duplicates, lines.dedup_lines, mixing.mixture):
        out = job(odd)
        assert {n for n in names if n not in ("finish", "epoch")} <= set(out.columns)
        assert {r["k"] for r in out.select("k").distinct().collect()} == {"clash"}
        assert job(odd.limit(0)).count() == 0


def test_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(20)
    twice = docs.unionByName(docs)
    assert lines.line_report(twice).count() == 40
    assert minhash.near_duplicates(twice).count() == 40
    report = mixing.mix_report(twice).collect()
    assert len(report) == 40 and all(r["taken"] <= 2 * r["size"] for r in report)
