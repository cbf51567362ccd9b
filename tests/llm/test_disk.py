"""What operators leave on disk or send through it."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lanternwatch.llm import substrings
from lanternwatch.llm.common import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for d in disk.localDirs() for f in Path(str(d)).rglob("shuffle_*")}


def test_materialize_removes_its_shuffles(spark):
    there, before = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    rows = spark.range(5000).selectExpr("id % 977 AS k", "id AS v").groupBy("k").sum("v")
    out = materialize(rows, "sums")
    until = time.time() + 20
    while (left := _shuffle_files(spark) - there) and time.time() < until:  # executors remove them a little later
        time.sleep(0.2)
    assert not left
    assert out.count() == 977 and rows.count() == 977
    assert spark.conf.get(CLEANUP, None) == before


def test_materialize_restores_the_setting_after_a_failure(spark):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(Exception, match="no such row"):
        materialize(spark.range(3).selectExpr("raise_error('no such row') AS x"), "none")
    assert spark.conf.get(CLEANUP, None) == before
    spark.conf.set(CLEANUP, "false")
    try:
        assert materialize(spark.range(3), "three").count() == 3 and spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)


def _letters(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .", k=n))


def test_fetched_bytes_are_those_a_window_can_touch():
    rng, places = random.Random(4), list(range(40, 900, 20))
    docs = pd.DataFrame({"id": [7], "text": [_letters(rng, 1000)]})
    tag = zlib.crc32(docs["text"][0].encode()) & 0xFFFF
    n = len(places)
    asked = substrings.pack((np.full(n, 7, np.uint64), 8), (np.full(n, tag, np.uint64), 2), (np.array(places, np.uint64), 4))
    sent = substrings._fetch(1)(docs, pd.DataFrame({"blob": [asked]}))
    assert sent["side"].tolist() == [0, 1]
    assert sum(map(len, sent["spans"])) < 0.75 * 2 * substrings.SPAN * n
    for side in (0, 1):  # the first and last byte of every window of the side, from the first byte of the span
        a, b = substrings.REACH[side]
        before = range(substrings.SIDE, substrings.LEFT + 1) if side == 0 else range(substrings.SIDE)
        assert (a, b) == (substrings.LEFT - max(before), substrings.LEFT - min(before) + substrings.LENGTH)


def test_short_shared_passages_in_other_surroundings(spark):
    rng = random.Random(5)
    passages = [_letters(rng, n) for n in (49, 50, 51, 52, 55, 60, 66, 67, 70, 83, 84, 90)]
    texts = [_letters(rng, rng.randrange(40)) + _letters(rng, 30).join(rng.sample(passages, 3)) + _letters(rng, rng.randrange(40)) for _ in range(60)]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen: dict[bytes, int] = {}
    for d, b in enumerate(t.encode() for t in texts):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        row = next(r for r in got if r["doc_id"] == d)
        assert (row["n_removed"], row["kept_sha256"]) == (sum(gone), hashlib.sha256(left).hexdigest())
