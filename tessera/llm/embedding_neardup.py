"""Embedding near duplicates: exact pairs by dual traversal of cover trees.

Unit vectors with a cosine of t or more lie within sqrt(2 - 2t) of each other.
A bounded sample gives a tree of nested levels whose radii halve; every vector
descends it to a leaf, and neighbouring leaves form chunks of bounded size (a
large leaf several). Neighbouring chunks are nodes of a tree, level by level. It
is traversed against itself from the top: pairs of nodes farther apart than both
covering radii and the distance are pruned, the others give way to the pairs of
their children. Pairs of chunks that are left meet in a group each, where both
chunks' own trees of nested levels, radii halving again, are traversed in the
same way, and pairs of leaves are computed. No pair of vectors is ever a row: a
group gives each vector's number of links, and a forest that connects what the
links connect. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, connected_components, read
from tessera.llm.vectors import fitted, matrix, valid

THRESHOLD = 0.95
#: Vectors of the sample that the top levels are made from, and of a chunk; points of a leaf; children of a node.
SAMPLE, CHUNK, LEAF, FAN = 2048, 4096, 48, 32
#: Children of a node of the tree over chunks.
WIDE = 64
#: Cosines this close to the threshold are summed again, in one order and without rounding between.
CLOSE = 1e-12


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows."""
    top = np.abs(m).max(1, initial=0)[:, None]
    m = m / np.where(top > 0, top, 1)
    n = np.sqrt((m * m).sum(1))[:, None]
    return m / np.where(n > 0, n, 1)


class Node:
    """Points (indexes) within radius of a centre; leaves have no children."""

    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: np.ndarray):
        self.centre, self.points, self.children = centre, points, []
        self.radius = float(np.sqrt(((x[points] - centre) ** 2).sum(1).max(initial=0.0)))


def cover(x: np.ndarray, points: np.ndarray | None = None, least: float = 0.0, leaf: int = LEAF) -> Node:
    """A tree of nested levels with halving radii over rows of x.

    Children of a node lie around centres chosen greedily among its points, each
    within half the node's radius. Points that FAN centres leave uncovered are a
    child of their own, without levels below if they are most of the node.
    """
    points = np.arange(len(x)) if points is None else points
    root = Node(x, points, x[points[0]] if len(points) else np.zeros(x.shape[1]))
    todo = [(root, False)]
    while todo:
        node, flat = todo.pop()
        if flat or len(node.points) <= leaf or node.radius <= least:
            continue
        rest, half = node.points, node.radius / 2
        for _ in range(FAN):
            if not len(rest):
                break
            d = ((x[rest] - x[rest[0]]) ** 2).sum(1)
            near = d <= half * half
            near[0] = True
            child = Node(x, rest[near], x[rest[0]])
            node.children.append(child)
            todo.append((child, len(child.points) == len(node.points) and child.radius >= node.radius))
            rest = rest[~near]
        if len(rest):
            child = Node(x, rest, x[rest[0]])
            node.children.append(child)
            todo.append((child, len(rest) > len(node.points) / 2))
    return root


def linked_leaves(a: Node, b: Node, distance: float):
    """Pairs of leaves of two trees (or of one with itself, each pair once) that may hold links."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is not q and np.sqrt(((p.centre - q.centre) ** 2).sum()) > p.radius + q.radius + distance + 1e-9:
            continue
        if p is q and p.children:
            todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
        elif not p.children and not q.children:
            yield p, q
        elif q.children and (not p.children or q.radius >= p.radius):
            todo += [(p, c) for c in q.children]
        else:
            todo += [(c, q) for c in p.children]


def links(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray | None, wb: np.ndarray | None, threshold: float):
    """Links of two chunks, or of one (xb None): weights linked to each row, a root row for each, and how many pairs were computed.

    Rows of b are numbered behind those of a.
    """
    same = xb is None
    xb, wb = (xa, wa) if same else (xb, wb)
    shift, n = (0, len(xa)) if same else (len(xa), len(xa) + len(xb))
    counts, root = np.zeros(n, np.int64), np.arange(n)
    ta = cover(xa)
    tb = ta if same else cover(xb)
    met, pairs = [], 0
    for p, q in linked_leaves(ta, tb, float(np.sqrt(max(0.0, 2 - 2 * threshold)))):
        cosines = xa[p.points] @ xb[q.points].T
        hit = cosines >= threshold - CLOSE
        pairs += hit.size
        if p is q and same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        some = np.argwhere(hit)
        for i, j in some[cosines[hit] < threshold + CLOSE]:
            hit[i, j] = math.fsum((xa[p.points[i]] * xb[q.points[j]]).tolist()) >= threshold
        counts[p.points] += hit @ wb[q.points]
        if not (p is q and same):
            counts[q.points + shift] += hit.T @ wa[p.points]
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        met.append((p.points[rows], q.points[cols] + shift, hit[np.ix_(rows, cols)]))
    changed = True
    while changed:  # the smallest number spreads over links until nothing changes
        changed = False
        for rows, cols, hit in met:
            low = np.minimum(root[rows], np.where(hit, root[cols][None, :], n).min(1))
            changed |= bool((low < root[rows]).any())
            root[rows] = np.minimum(root[rows], low)
            low = np.minimum(root[cols], np.where(hit, root[rows][:, None], n).min(0))
            changed |= bool((low < root[cols]).any())
            root[cols] = np.minimum(root[cols], low)
        root = root[root]
    return counts, root, pairs


def leaves_of(sample: np.ndarray, distance: float) -> np.ndarray:
    """Centres of the leaves of the sample's tree, in the tree's order; bounded by the sample."""
    out, todo = [], [cover(sample, least=2 * distance, leaf=8)] if len(sample) else []
    while todo:
        node = todo.pop()
        if node.children:
            todo += reversed(node.children)
        elif len(node.points):
            out.append(node.centre)
    return np.array(out) if out else np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK, sample: int = SAMPLE, log: dict | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Links are pairs of rows with cosine >= threshold in doubles. component_id is
    the smallest id that links lead to. Vectors that are null, zero, empty or hold
    null or non-finite components link with nothing; shorter ones count as padded
    with zeros. Rows that repeat an id are rows of their own; null ids count last.
    log, if given, gets the pairs of different vectors computed, and all of them.
    """
    spark = vectors.sparkSession
    store = Written(spark)
    distance = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    # What takes no part gets a null vector.
    live = valid(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(live, F.col("v")).alias("v")).withColumn("uid", F.monotonically_increasing_id())
    rows = store.write(rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v")))
    order = F.struct(F.col("id").isNull().alias("no"), "id")
    points = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("uid").alias("node"), F.count("*").alias("w"), F.min(order).alias("least"), F.first("v").alias("v"))
    some = points.select("v").orderBy("k1", "k2").limit(sample).collect()
    centres = leaves_of(unit(matrix([r[0] for r in some])), distance)

    def assign(batches):
        for b in batches:
            x = unit(matrix(b.column("v").to_pylist()))
            width = max(x.shape[1], centres.shape[1])
            near = np.argmax(fitted(x, width) @ fitted(centres, width).T, axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype("<i4"))], names=[*b.schema.names, "leaf"])

    points = store.write(points.select("node", "w", "least.id", "v", "k1", "k2").mapInArrow(assign, "node long, w long, id long, v array<double>, k1 long, k2 long, leaf int"))
    counts = {r.leaf: r.n for r in points.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total:
        # Leaves in the tree's order, cut into chunks of one size: each leaf covers a range of places.
        size, at, ranges = -(-total // -(-total // chunk)), 0, {}
        for leaf in sorted(counts):
            ranges[leaf] = (at, counts[leaf])
            at += counts[leaf]
        table = F.create_map(*[x for leaf, (s, n) in ranges.items() for x in (F.lit(leaf), F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")))])
        of = table[F.col("leaf")]
        place = of["s"] + F.pmod(F.xxhash64("node"), of["n"])
        chunks = store.write(points.select(F.floor(place / size).alias("chunk"), "node", "w", "v").groupBy("chunk").applyInArrow(_chunk_row, "chunk long, width int, nodes binary, ws binary, m binary, centre array<double>, radius double"))
        near = _near_chunks(chunks, -(-total // size), distance, store)
        found = store.write(_pairs(chunks, near, threshold))
        made = found.where("node is not null")
        if log is not None:
            log.update(computed=found.where("node is null").agg(F.sum("n")).first()[0], all=total * (total + 1) // 2)
        counted = made.groupBy("node").agg(F.sum("n").alias("n"))
        comps = connected_components(made.where("root <> node"), store, u="node", v="root")
        nodes = points.select("node", "w", "id", "k1", "k2").join(counted, "node", "left").join(comps, "node", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), "id", F.coalesce("component", "node").alias("component"))
        nodes = store.write(nodes)
        # Written, so that a large component can be split in the join.
        least = store.write(nodes.groupBy("component").agg(F.min("id").alias("c")))
        nodes = nodes.join(least, "component").select("k1", "k2", "n", "c")
        out = rows.join(nodes, (rows.k1 == nodes.k1) & (rows.k2 == nodes.k2) & rows.v.isNotNull(), "left")
    else:
        out = rows.withColumn("n", F.lit(None).cast("long")).withColumn("c", F.lit(None).cast("long"))
    out = out.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _chunk_row(t: pa.Table) -> pa.Table:
    raw = matrix(t.column("v").to_pylist())
    x = unit(raw)
    centre = x.mean(0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
    # Components that are floats are kept as such.
    small = raw.astype("<f4")
    m = small.tobytes() if (small.astype(float) == raw).all() else raw.tobytes()
    return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int64()), "width": pa.array([raw.shape[1]], pa.int32()), "nodes": [t.column("node").to_numpy().astype("<i8").tobytes()], "ws": [t.column("w").to_numpy().astype("<i8").tobytes()], "m": [m], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})


def _parents(wide: int):
    """Of groups of nodes (node, centre, radius): a node that covers them."""

    def run(t: pa.Table) -> pa.Table:
        c, r = matrix(t.column("centre").to_pylist()), t.column("radius").to_numpy()
        centre = c.mean(0)
        radius = float((np.sqrt(((c - centre) ** 2).sum(1)) + r).max())
        return pa.table({"node": pa.array([t.column("node")[0].as_py() // wide], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    return run


def _near_chunks(chunks: DataFrame, n: int, distance: float, store: Written, wide: int = WIDE) -> DataFrame:
    """Pairs (i, j), i <= j, of n chunks that may hold links, by a dual descent of the tree over them."""
    levels, sizes = [store.write(chunks.select(F.col("chunk").alias("node"), "centre", "radius"))], [n]
    while sizes[-1] > wide:
        up = levels[-1].groupBy(F.floor(F.col("node") / wide).alias("up")).applyInArrow(_parents(wide), "node long, centre array<double>, radius double")
        levels.append(store.write(up))
        sizes.append(-(-sizes[-1] // wide))
    square = lambda a, b: (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) * (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    gap = F.sqrt(F.aggregate(F.zip_with("ci", "cj", square), F.lit(0.0), lambda s, x: s + x))
    side = lambda level, key: level.select(F.col("node").alias(key), F.col("centre").alias(f"c{key}"), F.col("radius").alias(f"r{key}"))
    pairs = levels[-1].select(F.col("node").alias("i"), F.explode(F.sequence(F.col("node"), F.lit(sizes[-1] - 1).cast("long"))).alias("j"))
    for depth in range(len(levels) - 1, -1, -1):
        near = pairs.join(side(levels[depth], "i"), "i").join(side(levels[depth], "j"), "j").where(gap <= F.col("ri") + F.col("rj") + distance + 1e-9).select("i", "j")
        if not depth:
            return near
        near = store.write(near)
        below = lambda c: F.explode(F.sequence(F.col(c) * wide, F.least((F.col(c) + 1) * wide, F.lit(sizes[depth - 1]).cast("long")) - 1))  # noqa: E731, B023
        pairs = near.withColumn("a", below("i")).withColumn("b", below("j")).where("a <= b").select(F.col("a").alias("i"), F.col("b").alias("j"))


def _pairs(chunks: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) of each pair (i, j) of near; one row more of each, without node, counts the pairs computed."""
    body = ["width", "nodes", "ws", "m"]
    side = lambda key: chunks.select(F.col("chunk").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in body))
    met = near.join(side("i"), "i").join(side("j"), "j")

    def load(row, key):
        nodes, width = np.frombuffer(row[f"nodes_{key}"], "<i8"), row[f"width_{key}"]
        raw = row[f"m_{key}"]
        m = np.frombuffer(raw, "<f8" if len(raw) == len(nodes) * width * 8 else "<f4").astype(float).reshape(len(nodes), width)
        return nodes, np.frombuffer(row[f"ws_{key}"], "<i8"), unit(m)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                na, wa, xa = load(row, "i")
                if row["i"] == row["j"]:
                    nodes, (counts, root, computed) = na, links(xa, wa, None, None, threshold)
                else:
                    nb, wb, xb = load(row, "j")
                    width = max(xa.shape[1], xb.shape[1])
                    nodes, (counts, root, computed) = np.concatenate([na, nb]), links(fitted(xa, width), wa, fitted(xb, width), wb, threshold)
                some = counts > 0
                parts = nodes[some].tolist() + [None], counts[some].tolist() + [computed], nodes[root[some]].tolist() + [None]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["node", "n", "root"])

    return met.mapInArrow(run, "node long, n long, root long")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
