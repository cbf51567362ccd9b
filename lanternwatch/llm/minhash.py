"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A signature holds ``K`` minima of 32 bits. Two signatures that differ in at
most ``2 * CHUNKS - 1`` places have, by the pigeonhole principle, a chunk with
at most one differing place; every chunk is therefore indexed once for each
place it may be wrong in, under its other places. With 64 minima in 16 chunks
this finds every pair within distance 31, while a pair of similarity 0.8
differs in 12.8 places on average (31 lies 5.7 standard deviations above).

Equal sets are one node from the start. Buckets are never expanded into pairs.
First each bucket compares its members with one drawn leader, and the links
found merge components. Buckets that still hold several components are then
compared whole, in blocks, inside tasks: signatures first, each pair only in
the first bucket it shares, then sets. What leaves a task are the members with
a plausible partner, and in the end just enough links to join the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternwatch.llm.common import doc_key, materialize
from lanternwatch.llm.components import contract

K, CHUNKS = 64, 16
SHINGLE_WORDS = 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members of a bucket, and shingles of theirs, that are compared in one task with as many others (on average).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**64, K, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, K, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles (the whole sequence if shorter)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    width, tag = min(n, len(words)), np.uint64(len(words) if len(words) < n else 0)
    acc = np.full(len(words) - width + 1, tag, np.uint64)
    for i in range(width):
        acc = acc + _mix(h[i : i + len(acc)] ^ np.uint64(i)) * _ODD[i]
    return np.unique(_mix(acc))


def signature(s: np.ndarray) -> np.ndarray:
    """K minima of 32 bits; ``s`` is not empty."""
    best = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 8192):  # bounds memory for very long texts
        best = np.minimum(best, (s[i : i + 8192, None] * _MUL + _ADD).min(axis=0))
    return best >> np.uint64(32)


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """For each row of signatures, one key for each chunk and each place it may be wrong in."""
    r = K // CHUNKS
    chunks = sigs.reshape(len(sigs), CHUNKS, r)
    keys = []
    for wrong in range(r):
        acc = np.broadcast_to(_ODD[:CHUNKS] * np.uint64(wrong + 1), (len(sigs), CHUNKS)).copy()
        for place in range(r):
            if place != wrong:
                acc += _mix(chunks[:, :, place] + _ODD[place]) * _ODD[CHUNKS + place]
        keys.append(_mix(acc))
    return np.concatenate(keys, axis=1).view(np.int64)


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType())]))
def _sign(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({
        "n": [len(s) for s in sets],
        "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
        "sig": [signature(s).astype(np.uint32).tobytes() if len(s) else None for s in sets],
    })


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            keys = index_keys(np.stack([np.frombuffer(s, np.uint32) for s in pdf["sig"]]).astype(np.uint64))
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(pdf["node"].to_numpy(), K), "n": np.repeat(pdf["n"].to_numpy(), K)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(t) for t in pdf["text"]]
        yield pd.DataFrame({"node": pdf["node"], "members": [s.tobytes() for s in sets]})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        linked = []
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pdf.loc[linked, ["a", "b"]]


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``a, b``, those whose full sets are similar enough."""
    pairs = pairs.select("a", "b").distinct()
    xs, ys = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(xs, "a").join(ys, "b").select("a", "b", "x", "y").mapInPandas(_confirm, "a binary, b binary")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups of sorted input, with the rows at which the groups start."""
    left = None
    for pdf in batches:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        new = np.append(True, (pdf[by].to_numpy()[1:] != pdf[by].to_numpy()[:-1]).any(axis=1))[: len(pdf)]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]], starts[:-1]
        left = pdf.iloc[starts[-1] :].reset_index(drop=True) if len(starts) else None
    if left is not None and len(left):
        yield left, np.array([0])


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different labels and fitting sizes within one group, in slices; only across blocks if there are two."""
    label, n, block = pd.factorize(pdf["label"])[0], pdf["n"].to_numpy(), pdf["block"].to_numpy()
    two = block.min() != block.max()
    for i in range(0, len(pdf), 256):
        at = np.arange(i, min(i + 256, len(pdf)))
        fits = (label[at, None] != label) & (np.minimum(n[at, None], n) * 100 >= np.maximum(n[at, None], n) * PERCENT)
        fits &= (block[at, None] < block) if two else (at[:, None] < np.arange(len(pdf)))
        x, y = np.nonzero(fits)
        for k in range(0, len(x), 1 << 18):
            yield at[x[k : k + (1 << 18)]], y[k : k + (1 << 18)]


def _first_shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of signatures, and the first chunk and wrong place whose key both have (-1: none)."""
    r = K // CHUNKS
    differ = (x != y).reshape(-1, CHUNKS, r)
    wrong = differ.sum(axis=2)
    chunk = (wrong <= 1).argmax(axis=1)
    here = np.take_along_axis(differ, chunk[:, None, None], 1)[:, 0]
    return wrong.sum(axis=1), np.where((wrong <= 1).any(axis=1), chunk, -1), np.where(here.any(axis=1), here.argmax(axis=1), 0)


def _plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a bucket that have a partner of another label within the distance, for which this is the first bucket they share."""
    for pdf, starts in _groups(batches, ["key", "lo", "hi"]):
        keep = np.zeros(len(pdf), bool)
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, K)
        keys = pdf["key"].to_numpy()
        for a, b in zip(starts, np.append(starts, len(pdf))[1:], strict=True):
            own = index_keys(sigs[a : a + 1].astype(np.uint64))[0]
            place = int(np.flatnonzero(own == keys[a])[0])
            for i, j in _pairs(pdf.iloc[a:b]):
                distance, chunk, wrong = _first_shared(sigs[a + i], sigs[a + j])
                near = (distance < 2 * CHUNKS) & (chunk + CHUNKS * wrong == place)
                keep[a + i[near]] = keep[a + j[near]] = True
        yield pdf.loc[keep, ["key", "lo", "hi", "block", "node", "label", "n"]]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between different labels of a bucket, only as many as join the labels up.

    A row's intersections with all others are counted at once, from the list of
    the members that hold each of its shingles.
    """
    for pdf, starts in _groups(batches, ["key", "lo", "hi"]):
        out, nodes = [], pdf["node"].to_numpy()
        for a, b in zip(starts, np.append(starts, len(pdf))[1:], strict=True):
            part = pdf.iloc[a:b]
            sets = [np.frombuffer(m, np.uint64) for m in part["members"]]
            ends = np.cumsum([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            holders, first = owner[np.argsort(code, kind="stable")], np.cumsum(count) - count
            n, block, root = part["n"].to_numpy(), part["block"].to_numpy(), pd.factorize(part["label"])[0]
            two = block.min() != block.max()
            for i in range(len(sets)):
                wanted = (root != root[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * PERCENT)
                wanted &= (block != block[i]) if two else True
                wanted[: i + 1] = False
                if not wanted.any():
                    continue
                both, own = np.zeros(len(sets), np.int64), code[ends[i] - len(sets[i]) : ends[i]]
                for k in range(0, len(own), 4096):
                    size = count[own[k : k + 4096]]
                    at = np.arange(size.sum()) + np.repeat(first[own[k : k + 4096]] - (np.cumsum(size) - size), size)
                    both += np.bincount(holders[at], minlength=len(sets))
                for j in np.flatnonzero(wanted & (100 * both >= PERCENT * (n[i] + n - both))):
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        out.append((nodes[a + i], nodes[a + j]))
        yield pd.DataFrame(out, columns=["a", "b"])


def _node_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` for the nodes that share a bucket with another."""
    keys = nodes.select("node", "n", "sig").mapInPandas(_index, "key long, node binary, n long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"), F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"), F.col("n").alias("nb"))).alias("lead")).where("c > 1")
    keys = materialize(keys.join(shared.select("key", "c", "shingles", "lead.b", "lead.nb"), "key"), "buckets")
    suspects = keys.select("node").distinct().join(nodes.select("node", "k"), "node")
    texts = docs.select(doc_key(F.col("doc_id"), F.col("text")).alias("k"), "text").join(suspects, "k").dropDuplicates(["node"])
    sets = materialize(texts.select("node", "text").mapInPandas(_sets, "node binary, members binary"), "sets")
    # every member of a bucket against its leader
    near = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * PERCENT
    pairs = keys.where(near & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b")
    labels = contract(_linked(pairs, sets))
    # what is left across components
    labelled = keys.join(labels, "node", "left").select("key", "c", "shingles", "node", "n", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label", "n").join(nodes.select("node", "sig"), "node")
    plausible = materialize(_by_bucket(rows).mapInPandas(_plausible, "key long, lo int, hi int, block int, node binary, label binary, n long"), "plausible")
    found = _by_bucket(plausible.join(sets, "node")).mapInPandas(_forest, "a binary, b binary")
    confirmed = materialize(found.distinct(), "edges")
    if confirmed.isEmpty():
        return labels
    to = labels.withColumnRenamed("root", "label")
    at = lambda c: F.coalesce(f"{c}_label", c).alias(c)
    edges = confirmed.join(to.select(F.col("node").alias("a"), F.col("label").alias("a_label")), "a", "left").join(to.select(F.col("node").alias("b"), F.col("label").alias("b_label")), "b", "left").select(at("a"), at("b"))
    merged = contract(edges)
    roots = labels.select("node", F.col("root").alias("old")).unionByName(merged.select("node", F.col("node").alias("old")))
    return roots.join(merged.select(F.col("node").alias("old"), "root"), "old", "left").select("node", F.coalesce("root", "old").alias("root")).distinct()


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept`` and the row's key ``k``. Whole texts of any length.

    Null and empty texts have no shingles and are linked with nothing. Rows
    that repeat an id are separate members with that id; a null id belongs to
    its component but is its smallest id only if all are null.
    """
    rows = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("k"), _sign("text").alias("s"))
    signed = materialize(rows.select("doc_id", "k", "s.n", "s.node", "s.sig"), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    roots = _node_components(docs, nodes)
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = placed.join(ids, "root").select("node", "component_id")
    out = signed.select("doc_id", "k", "n", "node").join(member, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "k")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns stay as they are."""
    gone = near_duplicates(docs).where("not kept").select("k").distinct()
    rows = docs.select(F.struct("*").alias("row"), doc_key(F.col("doc_id"), F.col("text")).alias("k"))
    return rows.join(gone, "k", "left_anti").select("row.*")
