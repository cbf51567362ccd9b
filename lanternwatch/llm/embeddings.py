"""Exact near-duplicates of embeddings by dual traversal of a cover tree.

Vectors are unit length for the tree, so a cosine of at least ``THRESHOLD`` is
a distance of at most ``reach``. Each label has a simplified cover tree: the
centre of a node is a point and is again a centre among its children (nesting),
children cover their node within half its radius (halving), and siblings lie
farther apart than that (separation).

The levels above cells of ``CELL`` vectors are tables: a larger cell takes a
net from a bounded sample of itself, of ``MAX_CENTRES`` points at most, and its
vectors go to the nearest centre, so here covering radii are those measured and
may exceed a half. Below, a task builds the tree of its cell to single points.

The traversal descends from (root, root) pair by pair: a pair whose centres are
farther apart than both covering radii and the reach goes, one that lies within
the reach altogether is linked without comparing, points that meet are compared
on the full vectors. Equal vectors are one node with a multiplicity, and links
leave a task as counts and a spanning forest, never as all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternwatch.llm.common import materialize
from lanternwatch.llm.components import contract

THRESHOLD = 0.98
#: Vectors of a label whose tree is built in one task; a task holds two such cells at most.
CELL = 8192
#: Nodes of the tree with so many points or fewer are compared without descending further.
BASE = 16
#: Pairs of points compared at once, which bounds a task's memory.
PAIRS = 1 << 14
#: Members of a cell drawn to pick its net from, about; and the most centres of a net (fewer where a few cells will do).
SAMPLE, MAX_CENTRES = 1024, 128
#: For rounding: distances come from products of unit vectors. Only ever keeps pairs that could have been left out.
SLACK = 1e-6


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, all against all."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


class Tree:
    """Cover tree of the rows of ``x`` (unit vectors): ``centre, radius, kids, points`` by node; node 0 is the root."""

    def __init__(self, x: np.ndarray):
        self.x, self.centre, self.radius, self.kids, self.points = x, [], [], [], []
        todo = [self._node(np.arange(len(x)), 0)]
        while todo:
            node = todo.pop()
            points, half = self.points[node], self.radius[node] / 2
            if len(points) <= BASE or half < SLACK:
                continue
            groups, rest, at = [], points, self.centre[node]  # the node's own centre comes first
            while len(rest):
                near = _apart(x[rest], x[at : at + 1])[:, 0] <= half
                near |= rest == at
                groups.append((rest[near], at))
                rest = rest[~near]
                at = int(rest[0]) if len(rest) else at
            self.kids[node] = np.array([self._node(*g) for g in groups])
            todo += self.kids[node].tolist()
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.size = np.array([len(p) for p in self.points])

    def _node(self, points: np.ndarray, centre: int) -> int:
        self.points.append(points)
        self.centre.append(centre)
        self.radius.append(float(_apart(self.x[points], self.x[centre : centre + 1]).max()) if len(points) > 1 else 0.0)
        self.kids.append(np.empty(0, np.int64))
        return len(self.points) - 1


def linked_blocks(a: Tree, b: Tree, reach: float):
    """Dual traversal: yields ``(points of a, points of b, whether all are linked)``; what it leaves out is not linked.

    With ``a is b`` every pair of different nodes comes once, and a node with itself.
    """
    same = a is b
    ax, bx = a.x[a.centre], b.x[b.centre]

    def kept(p: np.ndarray, q: np.ndarray):
        """Pairs of nodes, one of each list, that may hold links, and whether they hold nothing else."""
        for i in range(0, len(p), 512):
            d = _apart(ax[p[i : i + 512]], bx[q])
            r = a.radius[p[i : i + 512], None] + b.radius[q]
            x, y = np.nonzero(d <= r + reach + SLACK)
            yield p[i + x], q[y], (d + r)[x, y] < reach - SLACK

    root = np.array([0])
    stack = [(root, root)]  # one list twice: each pair of its nodes once
    while stack:
        p0, q0 = stack.pop()
        for p, q, solid in kept(p0, q0):
            if p0 is q0 and same:
                once = p <= q
                p, q, solid = p[once], q[once], solid[once]
            single = (a.size[p] == 1) & (b.size[q] == 1)
            met = single & (p != q) if same else single
            for k in range(0, int(met.sum()), PAIRS):
                yield a.centre[p[met][k : k + PAIRS]], b.centre[q[met][k : k + PAIRS]], None
            for i, j, all_linked in zip(p[~single].tolist(), q[~single].tolist(), solid[~single].tolist(), strict=True):
                ki, kj = a.kids[i], b.kids[j]
                if all_linked or not (len(ki) or len(kj)):
                    yield a.points[i], b.points[j], all_linked
                elif same and i == j:
                    stack.append((ki, ki))
                elif len(ki) and (not len(kj) or a.radius[i] >= b.radius[j]):
                    stack.append((ki, np.array([j])))
                else:
                    stack.append((np.array([i]), kj))


def valid(vector: Column, label: Column) -> Column:
    """Vectors that can be compared: a label, components that are all finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def node_key(vector: Column, label: Column) -> Column:
    return F.concat_ws(":", label.cast("string"), F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.reverse(vector), label)))


def _net(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cell's centre and points of its sample that lie farther apart than half the cell's radius, in order of their hashes."""
    pdf = pdf.sort_values("node")
    x = np.vstack([np.array(pdf["centre"].iloc[0])[None], _unit(_matrix(pdf["vector"]))])
    half, chosen, rest = pdf["radius"].iloc[0] / 2, [0], np.arange(len(x))
    while True:
        rest = rest[_apart(x[rest], x[chosen[-1:]])[:, 0] > half]
        if not len(rest) or len(chosen) == pdf["most"].iloc[0]:
            break
        chosen.append(int(rest[0]))
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centres": [x[chosen].tolist()]})


@F.pandas_udf(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("d", T.DoubleType())]))
def _nearest(vector: pd.Series, centres: pd.Series) -> pd.DataFrame:
    """The nearest of each row's centres, and its distance. Rows of a cell share one list of centres."""
    c, d = np.zeros(len(vector), np.int32), np.zeros(len(vector))
    nets = [np.array([np.asarray(v, np.float64) for v in x]) for x in centres]
    key = pd.Series([x.tobytes() for x in nets])
    for at in key.groupby(key).indices.values():
        far = _apart(_unit(_matrix(vector.iloc[at])), nets[at[0]])
        c[at], d[at] = far.argmin(axis=1), far.min(axis=1)
    return pd.DataFrame({"c": c, "d": d})


def _split(members: DataFrame, centres: DataFrame, depth: int, reach: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """``members`` and ``centres`` after every cell of more than CELL vectors went to its children; None if there is none.

    A ball so small that all its vectors are linked needs no finer centres: it is dealt by hash, to bound what a task holds.
    """
    large = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).where(F.col("n") > CELL)
    large = materialize(large.join(centres, "cell"), "cells")
    if large.isEmpty():
        return None
    # what lies beyond half the radius is drawn by its own count: few far vectors are all drawn, so that no split leaves a ball as wide as it was
    far, solid = F.col("d") > F.col("radius") / 2, F.col("radius") < reach / 4
    wide = members.join(large.where(~solid).select("cell", "n", "centre", "radius"), "cell")
    shell = wide.where(far).groupBy("cell").agg(F.count("*").alias("n_far"))
    among = F.when(far, F.col("n_far")).otherwise(F.col("n"))
    chance = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / among
    most = F.least(F.lit(MAX_CENTRES), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / CELL)))
    drawn = wide.join(shell, "cell").where(chance).select("cell", "node", "vector", "centre", "radius", most.alias("most"))
    nets = drawn.groupBy("cell").applyInPandas(_net, "cell string, centres array<array<double>>")
    large = materialize(large.join(nets, "cell", "left").withColumn("centres", F.coalesce("centres", F.array("centre"))), "nets")
    joined = members.join(large.select("cell", "n", "centres", solid.alias("solid")), "cell", "left")
    found = joined.where("n is not null and not solid").withColumn("near", _nearest("vector", "centres"))
    by_hash = F.pmod(F.xxhash64("node", F.lit(-depth)), F.ceil(F.col("n") / CELL)).cast("int")
    child = lambda c: F.concat_ws("/", "cell", c).alias("cell")
    keep = ["node", "vector", "mult"]
    moved = found.select(*keep, child("near.c"), F.col("near.d").alias("d"))
    moved = moved.unionByName(joined.where("solid").select(*keep, child(by_hash), "d")).unionByName(joined.where("n is null").select(*keep, "cell", "d"))
    parts = F.when(solid, F.array_repeat("centre", F.ceil(F.col("n") / CELL).cast("int"))).otherwise(F.col("centres"))
    fresh = large.select("cell", F.posexplode(parts).alias("c", "centre")).select(child("c"), "centre")
    return materialize(moved, "members"), materialize(centres.unionByName(fresh), "centres"), large


def _verdicts(reach: float):
    @F.pandas_udf(T.StringType())
    def verdict(x: pd.Series, r: pd.Series, y: pd.Series, s: pd.Series) -> pd.Series:
        d = np.linalg.norm(_matrix(x) - _matrix(y), axis=1) if len(x) else np.zeros(0)
        return pd.Series(np.where(d > r + s + reach + SLACK, "apart", np.where(d + r + s < reach - SLACK, "within", "compare")))

    return verdict


@F.pandas_udf(T.DoubleType())
def _distance(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.linalg.norm(_matrix(x) - _matrix(y), axis=1) if len(x) else np.zeros(0))


def _levels(leaves: DataFrame, centres: DataFrame) -> list[DataFrame]:
    """``cell, centre, radius`` from the roots down. A leaf stands in for itself on the levels below it.

    An inner cell's ball covers the balls of its children, which costs no look at the vectors.
    """
    depth = leaves.select(F.max(F.size(F.split("cell", "/")))).first()[0] or 1
    found, level = [leaves], leaves
    for d in range(depth - 1, 0, -1):
        up = level.withColumnsRenamed({"cell": "low", "centre": "low_centre"}).withColumn("cell", F.substring_index("low", "/", d)).join(centres, "cell")
        reached = F.when(F.col("low") == F.col("cell"), F.col("radius")).otherwise(_distance("centre", "low_centre") + F.col("radius"))
        level = materialize(up.select("cell", "centre", reached.alias("radius")).groupBy("cell").agg(F.first("centre").alias("centre"), F.max("radius").alias("radius")), "cells")
        found.append(level)
    return found[::-1]


def leaf_pairs(leaves: DataFrame, centres: DataFrame, reach: float) -> DataFrame:
    """``a, b, verdict`` (a <= b) for the pairs of leaves that may hold links."""
    verdict, levels = _verdicts(reach), _levels(leaves, centres)
    pairs = levels[0].select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for d, level in enumerate(levels):
        up = F.substring_index("cell", "/", d) if d else F.col("cell")
        x = level.select(F.col("cell").alias("a2"), up.alias("a"), F.col("centre").alias("x"), F.col("radius").alias("r"))
        y = level.select(F.col("cell").alias("b2"), up.alias("b"), F.col("centre").alias("y"), F.col("radius").alias("s"))
        both = pairs.select("a", "b").join(x, "a").join(y, "b").where("a2 <= b2 or a <> b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"), verdict("x", "r", "y", "s").alias("verdict"))
        pairs = materialize(both.where("verdict <> 'apart'"), "pairs")
    return pairs


def _merge(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable places once the links (i, j) are added."""
    while True:
        x, y = low[i], low[j]
        if (x == y).all():
            return low
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _links(threshold: float):
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = not len(right)
        other = left if same else right
        if not len(left) or not len(other):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        shift = 0 if same else len(left)
        name, low = np.concatenate([left["node"], [] if same else right["node"]]), np.arange(len(left) + (0 if same else len(right)))
        mult = np.concatenate([left["mult"].to_numpy(np.int64), [] if same else other["mult"].to_numpy(np.int64)]).astype(np.int64)
        count = np.zeros(len(low), np.int64)
        if left["verdict"].iloc[0] == "within":
            rows = np.arange(len(left))
            blocks = [(rows, rows if same else np.arange(len(other)), True)]
        else:
            x, y = _matrix(left["vector"]), _matrix(other["vector"])
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            tree = Tree(x / nx[:, None])
            blocks = linked_blocks(tree, tree if same else Tree(y / ny[:, None]), reach)
        for p, q, solid in blocks:
            if solid is None:  # single points, pair by pair
                linked = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= threshold
                i, j = p[linked], q[linked] + shift
                np.add.at(count, i, mult[j])
                np.add.at(count, j, mult[i])
                low = _merge(low, i, j)
                continue
            itself = same and p is q
            if solid:
                total_p, total_q = mult[p].sum(), mult[q + shift].sum()
                count[p] += total_q - (mult[p] if itself else 0)
                count[q + shift] += 0 if itself else total_p
                low = _merge(low, np.append(p, q + shift), np.full(len(p) + len(q), p[0]))
                continue
            for k in range(0, len(p), 512):
                rows = p[k : k + 512]
                linked = (x[rows] @ y[q].T) / np.outer(nx[rows], ny[q]) >= threshold
                if itself:
                    linked &= rows[:, None] != q
                count[rows] += linked @ mult[q + shift]
                if not itself:
                    count[q + shift] += linked.T @ mult[rows]
                i, j = np.nonzero(linked)
                low = _merge(low, rows[i], q[j] + shift)
        seen = np.flatnonzero(count)
        return pd.DataFrame({"node": name[seen], "links": count[seen], "root": name[low[seen]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector row.

    Null labels, null, empty or zero vectors and vectors with a null or
    non-finite component link with nothing. Vectors of different lengths are
    not compared. Rows that repeat an id are separate vectors with that id; a
    null id is a vector of its own. An empty table gives an empty result, and
    other columns are not looked at.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), "label")
    rows = rows.withColumn("node", F.when(valid(F.col("vector"), F.col("label")), node_key(F.col("vector"), F.col("label"))))
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    nodes = materialize(nodes, "nodes")
    members = nodes.select("node", "vector", "mult", F.md5(F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string"))).alias("cell"))
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda acc, v: acc + v * v))
    centres = members.groupBy("cell").agg(F.min_by(F.col("vector").cast("array<double>"), "node").alias("centre"))
    centres = materialize(centres.withColumn("_norm", norm).select("cell", F.transform("centre", lambda v: v / F.col("_norm")).alias("centre")), "centres")
    near = _nearest("vector", F.array("centre"))
    members, depth = members.join(centres, "cell").select("node", "vector", "mult", "cell", near.alias("near")).select("node", "vector", "mult", "cell", F.col("near.d").alias("d")), 1
    members = materialize(members, "members")
    while (split := _split(members, centres, depth, reach)) is not None:
        members, centres, _ = split
        depth += 1
    leaves = materialize(members.groupBy("cell").agg(F.max("d").alias("radius")).join(centres, "cell").select("cell", "centre", "radius"), "leaves")
    pairs = leaf_pairs(leaves, centres, reach).withColumn("pair", F.concat_ws("|", "a", "b"))
    vector = F.when(F.col("verdict") == "compare", F.col("vector")).alias("vector")
    left = pairs.select("pair", "verdict", F.col("a").alias("cell")).join(members, "cell").select("pair", "verdict", "node", vector, "mult")
    right = pairs.where("a <> b").select(F.col("pair").alias("other"), "verdict", F.col("b").alias("cell")).join(members, "cell").select("other", F.col("node").alias("node"), vector, F.col("mult").alias("mult"))  # aliases tell the sides apart
    found = left.groupBy("pair").cogroup(right.groupBy("other")).applyInPandas(_links(threshold), "node string, links long, root string")
    found = materialize(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = contract(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "least", "mult").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(ids, "root").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
