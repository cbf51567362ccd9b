"""Personal data and secrets in text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import replace
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternwatch.functions import checksums
from lanternwatch.functions.fixed_pii import LABELS, PHI, SECRETS, V1, V2, Layer
from lanternwatch.functions.regexes import Pattern, by_width, hint, let, marked_spans, readings

MIN_CONFIDENCE, VALIDATOR_BONUS, CONTEXT_BONUS, CONTEXT_RADIUS, NO_CONTEXT_FLOOR = 0.5, 0.3, 0.25, 40, 0.6


def scan_pii_v1(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """All matches of the flat patterns: ``keys, type, value``."""
    return scan_patterns(df, keys, text, V1)


def scan_secrets(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return scan_patterns(df, keys, text, SECRETS)


def typed_matches(p: Pattern, r: Column) -> Column:
    """Matches with their type; ``r``: the text's ``readings``."""
    name = p.name
    return F.transform(p.values(r), lambda m: F.struct(F.lit(name).alias("type"), m.alias("value")))


def scan_patterns(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[Pattern]) -> DataFrame:
    found = let(readings(F.col(text)), lambda r: F.concat(*[typed_matches(p, r) for p in patterns]))
    return df.where(F.col(text).isNotNull()).select(*keys, F.explode(found).alias("f")).select(*keys, "f.type", "f.value")


def redact_v1(text: Column) -> Column:
    """Replaces in layer order, each on the text the earlier layers left. Texts in which no pattern can occur pass."""

    def replaced(patterns: list[Pattern]) -> Column:
        out = text
        for p in patterns:
            out = F.regexp_replace(out, p.java, LABELS[p.name])
        return out

    return F.when(text.rlike("|".join(sorted({p.needs for p in V1}))), by_width(text, V1, replaced)).otherwise(text)


def types_v1(text: Column) -> Column:
    """Types of the flat patterns that occur."""
    return let(readings(text), lambda r: F.array_compact(F.array(*[F.when(p.occurs(r), p.name) for p in V1])))


def phi_flag(text: Column) -> Column:
    return F.coalesce(F.arrays_overlap(types_v1(text), F.array(*[F.lit(t) for t in PHI])), F.lit(False))


def _layer(layer: Layer, r: Column) -> Column:
    """Findings of a layer, checked and scored; ``r``: the text's ``readings``, in which no control characters mark spans yet."""
    col, name = r["text"], layer.pattern.name

    def scored(x: Column) -> Column:
        ok = checksums.valid(layer.check, x["m"]) if layer.check else F.lit(True)
        base = min(1.0, layer.base + VALIDATOR_BONUS) if layer.check else layer.base
        hint = F.lit(None).cast("string")
        confidence = F.lit(base)
        if layer.context:
            start = F.greatest(x["s"] - CONTEXT_RADIUS, F.lit(0))
            near = F.lower(F.substr(col, start + 1, x["e"] - start + CONTEXT_RADIUS))
            hint = F.coalesce(*[F.when(near.contains(w), w) for w in layer.context])
            confidence = F.when(hint.isNotNull(), min(1.0, base + CONTEXT_BONUS)).when(F.lit(base >= NO_CONTEXT_FLOOR), base)
        validators = F.concat(F.array(F.lit("regex")), F.array(F.lit(layer.check.lower())) if layer.check else F.array().cast("array<string>"), F.when(hint.isNotNull(), F.array(F.lit("context"))).otherwise(F.array().cast("array<string>")))
        return F.struct(F.lit(name).alias("type"), x["m"].alias("sample"), x["s"].alias("start"), x["e"].alias("end"), F.when(ok, confidence).alias("confidence"), validators.alias("validators"), hint.alias("hint"))

    return F.filter(F.transform(marked_spans(r["words"], replace(layer.pattern, ascii=True).java), scored), lambda f: f["confidence"] >= MIN_CONFIDENCE)


def findings(text: str, layers: Sequence[Layer] = V2) -> Column:
    """Array of scored findings of all layers. A layer's work starts only where its pattern occurs."""
    return _findings(text, tuple(layers))


@lru_cache(maxsize=32)
def _findings(text: str, layers: tuple[Layer, ...]) -> Column:
    """The expression depends on names alone and takes seconds to put together, so it is kept."""
    empty = "array<struct<type:string,sample:string,start:int,end:int,confidence:double,validators:array<string>,hint:string>>"

    def scanned(r: Column) -> Column:
        return F.concat(*[F.when(x.pattern.occurs(r), _layer(x, r).cast(empty)).otherwise(F.array().cast(empty)) for x in layers])

    # no layer matches a control character, so those that mark spans may be others as well
    col = F.col(text)
    return let(readings(F.when(col.rlike("[\x01\x02]"), F.translate(col, "\x01\x02", "\x03\x03")).otherwise(col)), scanned)


#: What a text must hold for any scored layer to find something in it.
ANY_LAYER = r"[0-9]{2}|@|::|(?i:dl|license|student|roll)|[A-Z]{6}|[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}|bc1"


@lru_cache(maxsize=1)
def hints() -> list[str]:
    """``regexes.hint`` of all patterns, flat and layered."""
    return [hint(p) for p in [*V1, *(x.pattern for x in V2)]]


def _holds(layer: Layer, r: Column) -> Column:
    """Whether a layer has a finding. Where its score is enough without context words, that is whether a match passes its check."""
    base = min(1.0, layer.base + VALIDATOR_BONUS) if layer.check else layer.base
    if base < MIN_CONFIDENCE or layer.context and base < NO_CONTEXT_FLOOR:
        return F.size(_layer(layer, r)) > 0
    if not layer.check:
        return F.lit(True)
    found = F.regexp_extract_all(r["words"], F.lit(replace(layer.pattern, ascii=True).java), F.lit(0))
    return F.coalesce(F.exists(found, lambda m: checksums.valid(layer.check, m)), F.lit(False))


@lru_cache(maxsize=32)
def holds_pii(text: str) -> Column:
    """Whether the layered scan finds anything; texts in which no layer can are passed over. The expression is kept, as in ``findings``."""
    col = F.col(text)
    found = let(readings(F.when(col.rlike("[\x01\x02]"), F.translate(col, "\x01\x02", "\x03\x03")).otherwise(col)), lambda r: reduce(or_, [x.pattern.occurs(r) & _holds(x, r) for x in V2]))
    return F.coalesce(F.when(col.rlike(ANY_LAYER), found), F.lit(False))


def scan_pii(df: DataFrame, keys: Sequence[str], text: str = "text", layers: Sequence[Layer] = V2) -> DataFrame:
    """Layered scan: pattern, checksum (a failure rejects), context words within 40 characters."""
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.explode(findings(text, layers)).alias("f"))
    return rows.select(*keys, "f.*")


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Adds the text with the findings replaced by labels.

    Overlapping findings are resolved first: by start, then confidence and
    length descending; what overlaps an earlier one stays out.
    """
    label = F.create_map(*[x for t, v in LABELS.items() for x in (F.lit(t), F.lit(v))])
    order = F.array_sort(F.transform("_f", lambda f: F.struct(f["start"].alias("start"), (-f["confidence"]).alias("c"), (-f["end"]).alias("n"), f["end"].alias("end"), f["type"].alias("type"))))
    start, whole = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), F.col(text)

    def step(acc: Column, f: Column) -> Column:
        cut = F.concat(acc["out"], F.substr(whole, acc["at"] + 1, f["start"] - acc["at"]), F.element_at(label, f["type"]))
        free = f["start"] >= acc["at"]
        return F.struct(F.when(free, f["end"]).otherwise(acc["at"]).alias("at"), F.when(free, cut).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"] + 1, F.char_length(whole))))
    return df.withColumn("_f", findings(text)).withColumn(out, folded).drop("_f")


def scan_and_redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii`` and ``secrets`` (types found, secrets in what the first redaction left), ``redacted`` and ``has_findings``."""
    once = df.withColumn("_r", F.explode(F.array(F.struct(redact_v1(F.col(text)).alias("t"), types_v1(F.col(text)).alias("p")))))
    secrets = F.array_compact(F.array(*[F.when(p.found(F.col("_r.t")), p.name) for p in SECRETS]))
    out = F.col("_r.t")
    for p in SECRETS:
        out = F.regexp_replace(out, p.java, f"[REDACTED-{p.name}]")
    added = once.withColumns({"pii": F.col("_r.p"), "secrets": secrets, "redacted": out}).drop("_r")
    return added.withColumn("has_findings", (F.size("pii") > 0) | (F.size("secrets") > 0))


def _walk(value, patterns):
    if isinstance(value, str):
        for pattern, label in patterns:
            value = pattern.sub(label, value)
        return value
    if isinstance(value, list):
        return [_walk(v, patterns) for v in value]
    return {k: _walk(v, patterns) for k, v in value.items()} if isinstance(value, dict) else value


@F.pandas_udf(T.StringType())
def redact_for_persistence(text: pd.Series) -> pd.Series:
    """JSON with every string in it redacted, at any depth: personal data, then secrets. What is no JSON is redacted as text.

    Only the walk over nested values is Python; keys stay as they are.
    """
    flags = {"i": re.I, "s": re.S, "m": re.M}
    compiled = [(re.compile(p.regex, re.A | sum(flags[f] for f in p.flags)), LABELS.get(p.name, f"[REDACTED-{p.name}]")) for p in [*V1, *SECRETS]]

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            value = json.loads(t)
        except ValueError:
            return _walk(t, compiled)
        return json.dumps(_walk(value, compiled), ensure_ascii=False, separators=(",", ":"))

    return text.map(clean)


def best_finding_per_type(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, type, sample, confidence``: the most certain finding of each type; of equals the one with the least sample."""
    best = found.groupBy(*keys, "type").agg(F.min_by(F.struct("sample", "confidence"), F.struct((-F.col("confidence")).alias("c"), "sample")).alias("b"))
    return best.select(*keys, "type", "b.sample", "b.confidence")


def pii_audit(found: DataFrame, by: Sequence[str], kind: str = "type") -> DataFrame:
    """Findings and distinct values by the given columns and type."""
    value = "sample" if "sample" in found.columns else "value"
    return found.groupBy(*by, kind).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"))


def validate_ids(df: DataFrame, value: str, kinds: Sequence[str]) -> DataFrame:
    """How many values of a column pass each check: ``kind, n, n_valid``. One pass."""
    counts = df.agg(F.count(value).alias("n"), *[F.count_if(checksums.valid(k, F.col(value))).alias(k) for k in kinds])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_valid")) for k in kinds])).alias("x")).select("x.kind", "n", "x.n_valid")
