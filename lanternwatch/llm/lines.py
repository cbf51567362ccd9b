"""Line dedup by a log-template tree (DataFrame functions only).

Lines fall into leaves by their number of tokens and their leading tokens,
tokens with a digit being variable. Within a leaf a later token is fixed where
it recurs at its place in at least ``min_docs`` documents, and variable
otherwise; a line with its variable tokens masked is its template. Templates
that recur in at least ``min_docs`` documents are dropped, except for their
first occurrence, so that a copied document is whole in one place.

A line that recurs unchanged needs no template: one of ``LONG_TOKENS`` tokens
and more is dropped from the second document on, and one made mostly of
variable tokens, which has no template, in ``min_docs`` documents.

Only leaves with enough lines are looked at past their hash, equal lines are
merged before their tokens are counted, and the whole corpus is shuffled once,
to cut the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.common import doc_key, materialize

DEPTH = 4
MIN_DOCS = 10
MIN_TOKENS = 3
#: A line of so many tokens that stands unchanged in two documents is a copied passage.
LONG_TOKENS = 50
#: A template needs this share of fixed tokens; lines that agree in less are prose that begins alike.
MIN_FIXED = 0.5
#: Up to so many frequent leaves (8 bytes each) are broadcast; more join by shuffle.
MAX_BROADCAST_LEAVES = 500_000
SPACES = r"[\x20\x09-\x0D]+"
#: A token with a digit, from its start; possessive, so that prose is passed over in linear time.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def line_table(docs: DataFrame, depth: int = DEPTH, raw: bool = False) -> DataFrame:
    """``k, doc_id, line_no`` (from 0), ``line`` (masked, single spaces), ``n_tokens, leaf`` of every line, with ``raw`` if asked for."""
    rows = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    masked = F.regexp_replace(F.regexp_replace("raw", VARIABLE, "<*>"), SPACES, " ")
    plain = ~F.col("raw").rlike("[0-9\\x09-\\x0D]|  ")  # most prose: nothing to mask or squeeze
    kept = ["k", "doc_id", "line_no", *(["raw"] if raw else [])]
    lines = rows.select(*kept, F.trim(F.when(plain, F.col("raw")).otherwise(masked)).alias("line"))
    n_tokens = F.when(F.col("line") == "", 0).otherwise(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1)
    counted = lines.withColumn("n_tokens", n_tokens)
    leaf = F.xxhash64("n_tokens", F.substring_index("line", " ", depth))
    # exploding an array of one keeps filters above from computing the line once more below
    once = counted.select(*kept, F.explode(F.array(F.struct("line", "n_tokens", leaf.alias("leaf")))).alias("l"))
    return once.select(*kept, "l.*")


def recurring_lines(docs: DataFrame, depth=DEPTH, min_docs=MIN_DOCS, min_tokens=MIN_TOKENS, min_fixed=MIN_FIXED) -> DataFrame:
    """``k, line_no`` of the lines to drop. Lines travel as hashes; only distinct lines of frequent leaves travel as text."""
    lines = line_table(docs, depth)
    wanted = F.when(F.col("n_tokens") >= min_tokens, F.col("leaf"))
    leaves = materialize(lines.groupBy(wanted.alias("leaf")).agg(F.count("*").alias("c")).where((F.col("c") >= min_docs) & F.col("leaf").isNotNull()).select("leaf"), "leaves")
    small = leaves.count() <= MAX_BROADCAST_LEAVES
    hashed = lines.withColumn("h", F.xxhash64("line"))
    lines = materialize(hashed.join(F.broadcast(leaves) if small else leaves, "leaf").where(F.col("n_tokens") >= min_tokens).select("k", "doc_id", "line_no", "leaf", "h", "line"), "lines")
    # distinct lines, with the number of documents that hold them
    n_docs = lines.select("leaf", "h", "k").distinct().groupBy("leaf", "h").agg(F.count("*").alias("docs"))
    distinct = materialize(lines.groupBy("leaf", "h").agg(F.first("line").alias("line")).join(n_docs, ["leaf", "h"]), "distinct-lines")
    tokens = distinct.select("leaf", "h", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token")).where((F.col("pos") >= depth) & (F.col("token") != "<*>"))
    tokens = tokens.select("leaf", "h", "docs", "pos", F.xxhash64("pos", "token").alias("token"))
    common = tokens.groupBy("leaf", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "token")
    fixed = tokens.join(common, ["leaf", "token"]).groupBy("leaf", "h").agg(F.collect_set("pos").alias("fixed"))
    parts = distinct.join(fixed, ["leaf", "h"], "left").select("leaf", "h", F.split("line", " ").alias("t"), F.coalesce("fixed", F.array().cast("array<int>")).alias("fixed"))
    shown = F.transform("t", lambda t, i: F.when((i < depth) | F.array_contains("fixed", i), t).otherwise("<*>"))
    templates = parts.select("leaf", "h", shown.alias("shown")).select("leaf", "h", F.xxhash64("shown").alias("template"), (F.size(F.filter("shown", lambda t: t != "<*>")) / F.size("shown")).alias("share"))
    # plain tables, so that a join with a line or template that everyone has can be broadcast or split
    templates = materialize(templates.where(F.col("share") >= min_fixed).select("leaf", "h", "template"), "templates")
    placed = lines.select("k", "doc_id", "line_no", "leaf", "h").join(templates, ["leaf", "h"])
    # a line and its document, merged before documents are counted
    per_doc = placed.groupBy("leaf", "template", "k").agg(F.min(F.struct("doc_id", "k", "line_no")).alias("first"))
    recurring = per_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)
    dropped = placed.join(materialize(recurring.select("leaf", "template", "first"), "recurring"), ["leaf", "template"])
    return dropped.where((F.col("k") != F.col("first.k")) | (F.col("line_no") != F.col("first.line_no"))).select("k", "line_no").distinct()


def repeated_lines(docs: DataFrame, long_tokens=LONG_TOKENS, min_docs=MIN_DOCS, min_tokens=MIN_TOKENS, min_fixed=MIN_FIXED, only_long=False) -> DataFrame:
    """``k, line_no`` of unchanged repeats: long lines from the second document on, short ones without a template from ``min_docs``.

    Lines with enough fixed tokens are equal if they are when masked, the rest (rows of numbers) only if every token is.
    """
    rows = line_table(docs, raw=True)
    n_variable = F.size(F.filter(F.split("line", " "), lambda t: t == "<*>"))
    numbers = F.col("line").contains("<*>") & (1 - n_variable / F.col("n_tokens") < min_fixed)
    exact = F.trim(F.regexp_replace("raw", SPACES, " "))
    is_long = F.lit(False) if long_tokens is None else F.col("n_tokens") >= long_tokens
    wanted = is_long if only_long else is_long | ((F.col("n_tokens") >= min_tokens) & numbers)
    h = F.when(numbers, F.xxhash64(F.lit("exact"), exact)).otherwise(F.xxhash64("line"))
    lines = materialize(rows.where(wanted).select("k", "doc_id", "line_no", h.alias("h"), F.when(is_long, 2).otherwise(min_docs).alias("least")), "repeats")
    per_doc = lines.groupBy("h", "least", "k").agg(F.min(F.struct("doc_id", "k", "line_no")).alias("first"))
    groups = per_doc.groupBy("h", "least").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= F.col("least"))
    groups = materialize(groups.select("h", "least", "first"), "repeated")  # a plain table, so that a join with a hot line can be split
    dropped = lines.join(groups, ["h", "least"])
    return dropped.where((F.col("k") != F.col("first.k")) | (F.col("line_no") != F.col("first.line_no"))).select("k", "line_no").distinct()


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """All documents and columns, recurring lines cut from ``text``; adds ``n_lines`` and ``n_dropped``.

    Null texts stay null with 0 lines. Blank and very short lines (under
    ``min_tokens`` tokens) always stay. A document keeps its row even if all
    its lines go. Rows that repeat id and text lose the same lines; among equal
    first ids the row's key decides. Documents without such lines are not
    changed in a byte. Texts and lines of any length are read whole; an empty
    table gives an empty result; no name of another column clashes.
    """
    shared = {n: v for n, v in options.items() if n != "depth"}
    return cut_lines(docs, recurring_lines(docs, **options).union(repeated_lines(docs, **shared)).distinct())


def dedup_templates(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` without the long lines that stand in a few documents: for texts whose near-copies are still in."""
    return cut_lines(docs, recurring_lines(docs).union(repeated_lines(docs, long_tokens=None)).distinct())


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Only long unchanged lines cut, from the second document on."""
    return cut_lines(docs, repeated_lines(docs, only_long=True))


def cut_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the lines ``k, line_no`` of ``dropped``; adds ``n_lines`` and ``n_dropped``, in place of columns of these names."""
    drops = dropped.groupBy("k").agg(F.sort_array(F.collect_list("line_no")).alias("drop"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), doc_key(F.col("doc_id"), F.col("text")).alias("k"))
    joined = rows.join(drops, "k", "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("drop", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    cut = F.when(F.col("drop").isNull(), text).otherwise(kept)
    plain = [cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]
    return joined.select(*plain, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
