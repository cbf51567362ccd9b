"""Benchmark decontamination (DataFrame functions only).

Items become windows of ``n`` consecutive normalised words, each with an anchor
word. A bit set over the hashes of the anchors passes over nearly every word of
the corpus inside the row, without exploding it; what is left is exploded with
the words around it and joined with the windows, a broadcast hash set, so that
every hit is verified word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.common import ITEM_WORD, ascii_lower, doc_key, materialize

WINDOW = 10
#: Beyond this many windows nothing is broadcast: hashes are exploded and join by shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000


#: What separates words before lower-casing.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words in their own case; splitting is much cheaper than extracting, and A-Z have no effect on where words end."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def item_words(text: Column) -> Column:
    return raw_words(ascii_lower(text))


def benchmark_windows(bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """``anchor, offset, len, key, items``: the distinct windows of all items with the ids of the items that hold them.

    The anchor is the window's longest word (ties: by hash, then the first),
    the one least likely to be met elsewhere; ``offset`` is its place, from 0.
    """
    words = bench.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("len", F.least(F.size("w"), F.lit(n)))
    windows = sized.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("w"))
    best = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), F.xxhash64(x).alias("h"), (-i).alias("i"), x.alias("word"))))
    distinct = windows.groupBy("len", "w").agg(F.collect_set("item").alias("items")).withColumn("a", best)
    return distinct.select(F.col("a.word").alias("anchor"), (-F.col("a.i")).alias("offset"), "len", F.concat_ws(" ", "w").alias("key"), "items")


def _slot(h: Column, slots: int) -> Column:
    return F.shiftrightunsigned(h, 7).bitwiseAND(F.lit(slots - 1)).cast("int")


def _bit_set(anchors: DataFrame, slots: int) -> DataFrame:
    """One row, one array<bigint>: a bit for the hash of each anchor, 64 bits and more to an anchor."""
    h = anchors.select(F.xxhash64(F.lower("anchor")).alias("h"))
    bits = h.groupBy(_slot(F.col("h"), slots).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("b"))
    rows = h.sparkSession.range(slots).withColumnRenamed("id", "slot").join(bits, "slot", "left").select(F.struct("slot", F.coalesce("b", F.lit(0)).alias("b")).alias("s"))
    return rows.agg(F.sort_array(F.collect_list("s"))["b"].alias("bits"))


def _context(words: str, pos: Column, n: int) -> Column:
    """The words up to n - 1 to either side of ``pos``, and where they start."""
    start = F.greatest(pos - (n - 1), F.lit(0))
    return F.struct(pos.alias("pos"), start.alias("start"), F.transform(F.slice(words, start + 1, pos - start + n), ascii_lower).alias("ctx"))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document row: ``_k, doc_id, n_words, hits, items``.

    ``hits``: sorted array of struct(pos, len), pos from 0, of the verified
    windows; ``items``: sorted ids. Null and empty texts have no words; rows
    that repeat an id are judged apart; an empty benchmark hits nothing; a null
    item_id marks words but cannot be listed. ``_k`` is ``doc_key`` of the row.

    Beyond ``max_broadcast`` windows nothing of the benchmark is broadcast: the
    words of the corpus meet the anchors in a shuffled join instead.
    """
    windows = benchmark_windows(bench, n)
    windows = materialize(windows, "windows")
    count = windows.count()
    small = count <= max_broadcast
    rows = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("_k"), F.monotonically_increasing_id().alias("_rid"), "doc_id", raw_words(F.col("text")).alias("_w"))
    if small:
        slots = 1 << max(4, count.bit_length())

        def passes(i: Column) -> Column:
            h = F.xxhash64(F.lower(F.get("_w", i)))
            return F.getbit(F.get("_bits", _slot(h, slots)), h.bitwiseAND(F.lit(63)).cast("int")) == 1

        places = F.when(F.size("_w") > 0, F.filter(F.sequence(F.lit(0), F.size("_w") - 1), passes))
        marked = rows.withColumn("_bits", _bit_set(windows, slots).scalar()).select("_k", "_rid", "doc_id", "_w", places.alias("_at"))
        spots = marked.select("_k", "_rid", "doc_id", F.size("_w").alias("n_words"), F.explode_outer(F.transform("_at", lambda i: _context("_w", i, n))).alias("s"))
    else:
        rows = materialize(rows, "words")  # the row ids are drawn once
        at = rows.select("_k", F.posexplode("_w").alias("pos", "word")).withColumn("anchor", F.lower("word"))
        at = at.join(windows.select(F.lower("anchor").alias("anchor")).distinct().hint("shuffle_merge"), "anchor", "left_semi").select("_k", "pos").distinct()
        found = rows.join(at.hint("shuffle_merge"), "_k").select("_k", "_rid", _context("_w", F.col("pos"), n).alias("s"))
        spots = rows.select("_k", "_rid", "doc_id", F.size("_w").alias("n_words")).unionByName(found, allowMissingColumns=True)
    spots = spots.select("_k", "_rid", "doc_id", "n_words", F.get("s.ctx", F.col("s.pos") - F.col("s.start")).alias("anchor"), "s.pos", "s.start", "s.ctx")
    tried = spots.join(F.broadcast(windows) if small else windows, "anchor", "left")
    first = F.col("pos") - F.col("offset")
    same = (first >= F.col("start")) & (F.concat_ws(" ", F.slice("ctx", F.greatest(first - F.col("start") + 1, F.lit(1)), F.coalesce("len", F.lit(0)))) == F.col("key"))
    merged = tried.groupBy("_rid").agg(
        F.first("_k", True).alias("_k"), F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(same, F.struct(first.alias("pos"), "len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(same, F.col("items")))))).alias("items"),
    )
    return merged.drop("_rid")


def n_hit_words(hits: Column) -> Column:
    """Words inside the union of the hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["pos"] + x["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["pos"])).alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"]).cast("long")


def contamination_report(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    hits = find_hits(docs, bench, n)
    return hits.select(
        "doc_id", "n_words", n_hit_words(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their key, so that no name clashes."""
    return docs.select(F.struct("*").alias("row"), doc_key(F.col("doc_id"), F.col("text")).alias("k"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents without any hit; all columns stay as they are."""
    bad = find_hits(docs, bench, n).where(F.size("hits") > 0).select(F.col("_k").alias("k")).distinct()
    return _keyed(docs).join(bad, "k", "left_anti").select("row.*")


def strip_contaminated(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents, hit words (with what follows each up to the next word) cut from ``text``."""
    bad = find_hits(docs, bench, n).where(F.size("hits") > 0).groupBy(F.col("_k").alias("k")).agg(F.first("hits").alias("hits"))
    word, text = ITEM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), F.col("row.text")
    joined = _keyed(docs).join(bad, "k", "left")
    gaps, words = F.split(text, word), F.regexp_extract_all(text, F.lit(word), F.lit(0))
    hit = lambda i: F.exists("hits", lambda h: (h["pos"] <= i) & (i < h["pos"] + h["len"]))
    kept = F.transform(words, lambda w, i: F.when(hit(i), F.lit("")).otherwise(F.concat(w, F.coalesce(F.get(gaps, i + 1), F.lit("")))))
    stripped = F.when(F.col("hits").isNull(), text).otherwise(F.concat(gaps[0], F.concat_ws("", kept)))
    return joined.select(*[stripped.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
