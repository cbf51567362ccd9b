"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.langid import remainder


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, modulus: int = 5, held: int = 0, longest: int = 40_000) -> pd.DataFrame:
    """About ``per_class`` labelled documents of each class, drawn by hash: ``text, y, weight``.

    Only rows whose crc32 remainder is not ``held`` are learnt from; texts of
    over ``longest`` characters are left out of the sample. The weights undo
    the uneven drawing of the classes. The sample is bounded, so the labels
    drawn are broadcast to the scan and the texts come to the driver.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    known = known.groupBy("doc_id").agg(F.max(column).alias("y"))
    counts = {r["y"]: r["c"] for r in known.groupBy("y").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "y": [], "weight": []})
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    cut = F.lit(0.0)
    for y, c in counts.items():
        cut = F.when(F.col("y") == y, float(1 << 30) * per_class / c).otherwise(cut)
    drawn = known.where(h < cut).limit(3 * per_class)
    rows = docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    pdf = rows.orderBy("doc_id", "text").limit(6 * per_class).toPandas()
    pdf["y"] = pdf["y"].astype(int)
    pdf["weight"] = pdf["y"].map({y: c / min(c, per_class) for y, c in counts.items()}).astype(float)
    pdf["weight"] /= max(pdf["weight"].mean(), 1e-9) if len(pdf) else 1.0
    return pdf[["text", "y", "weight"]]


def unlabelled(docs: DataFrame, labels: DataFrame, n: int, modulus: int = 5, held: int = 0, longest: int = 40_000) -> list[str]:
    """About ``n`` texts without any label, drawn by hash from the rows not held out; two times ``n`` at most."""
    free = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= longest) & (remainder(F.col("doc_id"), modulus) != held)).select("doc_id", "text")
    h = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30))
    drawn = free.where(h < F.lit(float(1 << 30)) * n / max(1, docs.count()))
    drawn = drawn.join(labels.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")
    return [r["text"] for r in drawn.orderBy("doc_id", "text").limit(2 * n).collect()]
