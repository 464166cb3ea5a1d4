"""Near duplicates by DartMinHash signatures, banded joining and exact checks.

1. Each text is sketched once, whole: 128 darts in 32 bands of 4, thrown into
   regions as wide as a shingle's weight.
2. Equal word sequences are one node from here on, however many rows they have.
3. Nodes that share a band's key are candidates. In each bucket all nodes are
   compared with one pivot, the pivots change by round, and pairs that are
   already connected are left out: the cost is linear in the bucket.
4. What then still holds unconnected nodes is compared in blocks: a bucket's
   members are cut into chunks of bounded size, those of its largest component
   apart from the others, and each pair of chunks that can hold unconnected
   nodes is a group of its own. Groups get sketches first; only the members left
   with a likely partner meet again with their texts, where each pair of
   different components is checked in the first band that the pair shares, and a
   forest of links is returned. So no candidate pair of different components is
   left out, no task holds a bucket, and pairs are no rows.
5. A pair is a link if its exact weighted Jaccard similarity over shingles of five
   words is at least the threshold. Classes are the connected components of links.

A pair of the threshold's similarity 0.8 shares no band with probability 4.8e-8.
Darts are cut to 8 bits for a first estimate; pairs estimated more than slack =
0.25 below the threshold (seven standard deviations) are not compared exactly,
which loses such a pair with probability 1e-10 at most: below 5e-8 with the bands.
slack = 1 compares every pair that shares a band.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, connected_components, map_rows, read
from tessera.llm.dart_sketch import K, WORDS, band_keys, shingle_sets, shingles, signatures, similarities, similarity, weighed, words_of

THRESHOLD, SLACK = 0.8, 0.25
#: Rounds of pivots, and members of a chunk of what these leave.
ROUNDS, CHUNK = 2, 256
#: Texts of a chunk that are compared with one at once.
TOGETHER = 32


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, weights: str = "counts") -> DataFrame:
    """(uid, id, text, a, b, bands, darts) of each row; uid is unique once written.

    a, b: 128 bits of the text's words, or of the row where there are none. bands
    is empty then. darts: 8 bits of each dart.
    """
    import xxhash

    def make():
        at = TaskContext.get().partitionId() << 36

        def run(rows):
            nonlocal at
            out = {k: [] for k in ("uid", "id", "text", "a", "b", "bands", "darts")}
            for i in range(0, len(rows["id"]), 64):
                texts = rows["text"][i : i + 64]
                split = [words_of(t) for t in texts]
                sigs = signatures([weighed(*x, weights) for x in shingle_sets(split, n=words)])
                keys = band_keys(sigs).tolist()
                for key, text, w, sig, bands in zip(rows["id"][i : i + 64], texts, split, sigs, keys):
                    digest = xxhash.xxh3_128_digest(" ".join(w)) if w else None
                    row = (at, key, text if w else None, *(np.frombuffer(digest, "<i8").tolist() if w else (at, -1)), bands if w else [], (sig & np.uint64(255)).astype(np.uint8).tobytes())
                    for name, x in zip(out, row):
                        out[name].append(x)
                    at += 1
            return out

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "uid long, id long, text string, a long, b long, bands array<long>, darts binary", "text")


def _estimated(pairs: DataFrame, darts: DataFrame, least: float) -> DataFrame:
    """Of pairs (x, y), those whose darts agree in a share of least or more."""
    both = pairs.join(darts.select(F.col("node").alias("x"), F.col("darts").alias("dx")), "x").join(darts.select(F.col("node").alias("y"), F.col("darts").alias("dy")), "y").select("x", "y", "dx", "dy")

    def run(batches):
        for b in batches:
            if b.num_rows:
                dx, dy = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, K) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array(np.count_nonzero(dx == dy, axis=1) >= least * K))

    return both.mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int, weights: str) -> DataFrame:
    """(x, y, ok) of pairs, by exact similarity."""
    both = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def make():
        def run(rows):
            last: dict[str, tuple] = {}

            def of(text):
                if text not in last:
                    if len(last) > 16:
                        last.clear()
                    last[text] = weighed(*shingles(words_of(text), n=words), weights)
                return last[text]

            return {"x": rows["x"], "y": rows["y"], "ok": [similarity(of(a), of(b)) >= threshold for a, b in zip(rows["tx"], rows["ty"])]}

        return run

    return map_rows(both, make, "x long, y long, ok boolean", "tx")


def _labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps.withColumnRenamed("component", "found"), "node", "left").select("band", "key", "node", F.coalesce("found", "node").alias("comp"))


def _open(members: DataFrame) -> DataFrame:
    """Buckets that hold several components: (band, key, n, pivots of all rounds)."""
    seeds = [F.min("node").alias("p0"), F.max("node").alias("p1"), F.min_by("node", F.xxhash64("node")).alias("p2")]
    return members.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), *seeds).where("lo <> hi").drop("lo", "hi")


def _chunked(members: DataFrame, known: DataFrame, store: Written, chunk: int) -> DataFrame:
    """Members of open buckets, once for each pair of chunks (i, j) of a bucket that they have a part in.

    A bucket's largest component has chunks of its own, the first ones; pairs of
    these have nothing to connect and are left out.
    """
    sizes = members.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    pieces = lambda n: F.ceil(n / chunk).cast("int")
    large = sizes.groupBy("band", "key").agg(F.max(F.struct("n", (-F.col("comp")).alias("neg"))).alias("x"), F.sum("n").alias("n"))
    large = large.select("band", "key", (-F.col("x.neg")).alias("large"), pieces(F.col("x.n")).alias("own"), pieces(F.col("n") - F.col("x.n")).alias("others"))
    rows = members.join(store.write(large), ["band", "key"]).join(known, "node")
    inside = F.col("comp") == F.col("large")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("c", F.when(inside, place(F.col("own"))).otherwise(F.col("own") + place(F.col("others"))))
    start = F.when(inside, F.col("own")).otherwise(F.lit(0))
    rows = rows.withColumn("o", F.explode(F.sequence(start, F.col("own") + F.col("others") - 1)))
    return rows.select("band", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "comp", "darts", "bands")


class _Block:
    """Members of a pair of chunks, and the pairs of them that may be links."""

    def __init__(self, t: pa.Table, cut: float):
        self.c, self.node, self.comp = (t.column(k).to_numpy() for k in ("c", "node", "comp"))
        self.i, self.j, self.band = (t.column(k)[0].as_py() for k in ("i", "j", "band"))
        self.darts = np.frombuffer(b"".join(t.column("darts").to_pylist()), np.uint8).reshape(-1, K)
        self.bands = np.array(t.column("bands").to_pylist(), np.int64)
        self.cut, self.root = cut, np.unique(self.comp, return_inverse=True)[1]

    def partners(self):
        """(a, rows b) of each row of chunk i: of another component, likely enough, and in no band before this one together."""
        right = np.flatnonzero(self.c == self.j)
        for a in np.flatnonzero(self.c == self.i):
            r = right[(self.root[right] != self.root[a]) & ((self.node[right] > self.node[a]) if self.i == self.j else True)]
            r = r[~(self.bands[r, : self.band] == self.bands[a, : self.band]).any(1)] if self.band else r
            r = r[np.count_nonzero(self.darts[r] == self.darts[a], axis=1) >= self.cut * K]
            if len(r):
                yield a, r


def _likely(rows: DataFrame, cut: float) -> DataFrame:
    """Of rows of _chunked, those with a partner in their pair of chunks."""

    def run(t: pa.Table) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for a, r in _Block(t, cut).partners():
            some[a] = some[r] = True
        return t.filter(pa.array(some))

    return rows.groupBy("band", "key", "i", "j").applyInArrow(run, rows.schema)


def _links(rows: DataFrame, cut: float, threshold: float, words: int, weights: str) -> DataFrame:
    """Links (x, y) that connect nodes of different components; rows: those of _likely with their texts."""

    def run(t: pa.Table) -> pa.Table:
        block, texts, sets = _Block(t, cut), t.column("text"), {}

        def of(a):
            if a not in sets:
                sets[a] = weighed(*shingles(words_of(texts[a].as_py()), n=words), weights)
            return sets[a]

        xs, ys, node, root = [], [], block.node, block.root
        for a, r in block.partners():
            for k in range(0, len(r), TOGETHER):
                part = [b for b in r[k : k + TOGETHER] if root[b] != root[a]]
                # With room for rounding; what is near is compared once more, as everywhere.
                near = similarities(of(a), [of(b) for b in part]) >= threshold - 1e-9 if part else []
                for b in itertools.compress(part, near):
                    if root[b] != root[a] and similarity(of(a), of(b)) >= threshold:
                        xs.append(max(node[a], node[b]))
                        ys.append(min(node[a], node[b]))
                        root[root == root[b]] = root[a]
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return rows.groupBy("band", "key", "i", "j").applyInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, weights: str = "counts", chunk: int = CHUNK, rounds: int = ROUNDS, slack: float = SLACK) -> tuple[DataFrame, Written]:
    """(uid, id, class_id, kept) of each row, and the store that holds the intermediates.

    class_id is the smallest id of the class, kept is true for one row of it,
    the one with the smallest id. Null, empty and blank texts are in no class
    but their own. Texts of fewer than five words equal only their copies. Null
    ids come last; rows that repeat an id are rows of their own. weights: see
    weighed(). slack: how far below the threshold an estimate may lie before a
    pair is left out; at 1 none is.
    """
    spark = docs.sparkSession
    store = Written(spark)
    rows = store.write(sketch(docs, id_col=id_col, text_col=text_col, words=words, weights=weights))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "uid")
    nodes = store.write(rows.groupBy("a", "b").agg(F.min("uid").alias("node"), F.min(order).alias("first")))
    heads = rows.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    keyed = heads.select(F.col("uid").alias("node"), F.posexplode("bands").alias("band", "key"))
    # Written, here and below, so that joins have plain exchanges on both sides and a hot key can be split.
    shared = store.write(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    members = store.write(keyed.join(shared, ["band", "key"]))
    some = store.write(members.select("node").distinct())
    known = store.write(rows.withColumnRenamed("uid", "node").join(some, "node").select("node", "text", "darts", "bands"))
    darts, texts, least = known.select("node", "darts"), known.select("node", "text"), threshold - slack
    comps = None
    for k in range(rounds + 1):
        labelled = store.write(_labelled(members, comps))
        buckets = store.write(_open(labelled))
        if buckets.isEmpty():
            break
        if k < rounds:
            pivots = buckets.select("band", "key", F.col(f"p{k % 3}").alias("pivot"))
            met = labelled.join(pivots, ["band", "key"]).where("node <> pivot").select(F.greatest("node", "pivot").alias("x"), F.least("node", "pivot").alias("y")).distinct()
            met = _apart(met, comps)
            found = store.write(_verified(_estimated(met, darts, least), texts, threshold, words, weights).where("ok").select("x", "y"))
        else:
            left = store.write(labelled.join(buckets.select("band", "key"), ["band", "key"], "left_semi"))
            likely = store.write(_likely(_chunked(left, known.drop("text"), store, chunk), least))
            found = store.write(_links(likely.join(texts, "node"), least, threshold, words, weights))
        # What is connected already is passed on as stars, not link by link.
        links = found if comps is None else found.union(comps.select("node", "component"))
        comps = store.write(connected_components(links, store, u="x", v="y"))
        members = labelled.join(buckets.select("band", "key"), ["band", "key"], "left_semi").drop("comp")
    whole = nodes if comps is None else nodes.join(comps, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node") if comps is not None else F.col("node"))
    best = store.write(whole.groupBy("component").agg(F.min("first").alias("best")))
    named = whole.join(best, "component").select("a", "b", F.col("best.id").alias("class_id"), F.col("best.uid").alias("best_uid"))
    return rows.join(named, ["a", "b"]).select("uid", "id", "class_id", (F.col("uid") == F.col("best_uid")).alias("kept")), store


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs of nodes not yet in one component."""
    if comps is None:
        return pairs
    for end in ("x", "y"):
        pairs = pairs.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.where("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, unchanged, one of each class of near duplicates.

    A row goes if all rows of its id go, so rows that repeat an id stay together:
    give ids that are unique to keep exactly one row of each class.
    """
    classes, _ = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stays = classes.groupBy("id").agg(F.max("kept").alias("stays")).where("not stays").select(F.col("id").alias("__gone"))
    return docs.join(stays, docs[id_col].cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", "kept")
