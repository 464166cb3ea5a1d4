"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token counts; those longer than a sequence are cut into full
pieces, the first of which takes what remains. Pieces below a full sequence
are dealt by hash into blocks of a bounded number of pieces. A block starts with
best-fit decreasing; where that reaches a lower bound of the number of bins
nothing is left to gain. The other blocks are evolved by several islands, each
one a row that any task can take. A genome is a list of bins. Crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold
duplicates of injected pieces, and packs the displaced pieces again: first in
exchange for smaller ones where they fill a bin better, then by best fit, longest
first. Between epochs the best genome of each island migrates to the next island
of its ring, populations stay. The best genome of a block gives its well-filled
bins; what lies in the other bins is pooled over all blocks and packed again in
fewer blocks, until one block is left. From level to level less full bins count
as well filled, in the end all, so there are nine levels at most.
"""

from __future__ import annotations

import array
import bisect
import heapq
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm.common import Memo, Written, kept, map_rows, read

CAPACITY = 2048
#: Pieces of a block at most, islands of a block, epochs, genomes of an island.
BLOCK, ISLANDS, EPOCHS, POPULATION = 1024, 3, 3, 6
#: Crossovers of an epoch, and those without a better genome after which an epoch ends.
GENERATIONS, STALL = 30, 10
#: A bin with at most this share of the capacity free is closed at the first level; the pieces of others are pooled.
WELL = 1 / 256
#: Times this share a level later, or times its cube after a level that leaves more than LEFT of its pieces.
LOOSER, LEFT = 2, 0.75
#: Displaced pieces, the largest, that are tried in twos; the rest are tried one by one.
PAIRED = 24
MEMO = 250_000
#: The pattern that byte-level tokenizers split texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Ids of whole texts by a tokenizers file, with a memo of words.

    Byte-level BPE with the usual pattern never joins what stands before white
    space with it, so each word is encoded once, with the white space before
    it. Words not in the memo go to a tiktoken engine made from the file's own
    vocabulary (an id is a merge rank there; checked on loading), as it takes a
    third of the time for single words; any other file, and a text that holds a
    special token, goes to the tokenizer whole.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.engine = _ranked(json.loads(data), set(self.special))
        ids, packed = self.engine and self.engine.encode_ordinary, array.array
        self.memo = Memo(lambda p: packed("I", ids(p if p[:1] == "\n" else " " + p)).tobytes(), MEMO)
        self.bare = Memo(lambda p: packed("I", ids(p)).tobytes(), MEMO // 10)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.engine is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if re.search(r"\s\s", text):
            return b"".join(map(self.bare.__getitem__, re.findall(r"\s*\S+|\s+", text)))
        words = text.replace("\n", " \n").split(" ")
        first = self.bare[words[0]] if words[0] else b""
        return first + b"".join(map(self.memo.__getitem__, words[1:]))


def _ranked(spec: dict, special: set[str]):
    """A tiktoken engine with the ids of a byte-level BPE file; None if it isn't one."""
    import tiktoken

    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(chars[c] for c in p): i for p, i in model["vocab"].items() if p not in special}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    at = [model["vocab"]["".join(m)] for m in merged]
    if at != sorted(set(at)) or len(at) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def piece_documents(docs: DataFrame, tokenizer: bytes, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, id, piece, start, length, ids_crc32) of each document's pieces.

    row_id is unique once written. A null text is empty and has the end id only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokens, at = kept("tokens", shared.value, Tokens), TaskContext.get().partitionId() << 36

        def run(rows):
            nonlocal at
            out = {k: [] for k in ("row_id", "id", "piece", "start", "length", "ids_crc32")}
            for key, text in zip(rows["id"], rows["text"]):
                ids = tokens.encode(text or "") + end
                n = len(ids) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    part = ids[4 * start : 4 * (start + size)]
                    for name, x in zip(out, (at, key, k, start, size, zlib.crc32(part))):
                        out[name].append(x)
                    start += size
                    at += 1
            return out

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "row_id long, id long, piece int, start long, length long, ids_crc32 long", "text")


class Bins:
    """Bins of indexes of items, with best fit by a bit mask over free space."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.mask, self.at = 0, {}

    def put(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.open(len(self.items) - 1, free)

    def open(self, k: int, free: int) -> None:
        if free > 0:
            self.at.setdefault(free, []).append(k)
            self.mask |= 1 << free

    def fit(self, item: int) -> None:
        """Into the fullest bin that has room, else a new one."""
        size = self.sizes[item]
        rest = self.mask >> size
        if not rest:
            self.put([item], self.capacity - size)
            return
        free = size + (rest & -rest).bit_length() - 1
        line = self.at[free]
        k = line.pop()
        if not line:
            self.mask ^= 1 << free
        self.items[k].append(item)
        self.open(k, free - size)


def bound(sizes: list[int], capacity: int) -> int:
    """A lower bound of the number of bins: by volume, and by pieces that cannot share a bin."""
    x = np.sort(np.asarray(sizes, np.int64))
    if not len(x):
        return 0
    total, best = np.concatenate([[0], np.cumsum(x)]), -(-int(x.sum()) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))  # pieces from here on need a bin each
    for k in np.unique(x[:half]).tolist() + [capacity // 2 + 1]:
        alone, low = int(np.searchsorted(x, capacity - k, "right")), int(np.searchsorted(x, k, "left"))
        middle = max(0, alone - half)
        room = middle * capacity - int(total[max(alone, half)] - total[half])
        rest = int(total[half] - total[min(low, half)])
        best = max(best, len(x) - half + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int, noise: float = 0.0, rng: random.Random | None = None) -> list[list[int]]:
    """Best-fit decreasing; with noise the order is blurred by that share of a size."""
    out = Bins(sizes, capacity)
    for i in sorted(range(len(sizes)), key=(lambda i: -sizes[i]) if rng is None else lambda i: -sizes[i] * (1 + noise * rng.random())):
        out.fit(i)
    return out.items


class _Loose:
    """Displaced pieces by size, and sums of two of the largest."""

    def __init__(self, sizes: list[int], items: list[int]):
        self.sizes, self.held = sizes, set(items)
        singles = sorted((sizes[i], i) for i in items)
        some = singles[-PAIRED:]
        pairs = sorted((x + y, i, j) for k, (x, i) in enumerate(some) for y, j in some[:k])
        self.one, self.ones = [x for x, _ in singles], [i for _, i in singles]
        self.two, self.twos = [x[0] for x in pairs], [x[1:] for x in pairs]

    def take(self, low: int, high: int) -> tuple[int, ...] | None:
        """One or two pieces of a size above low and up to high, the largest."""
        held, best = self.held, None
        k = bisect.bisect_right(self.one, high) - 1
        while k >= 0 and self.one[k] > low:
            if self.ones[k] in held:
                low, best = self.one[k], (self.ones[k],)
                break
            k -= 1
        k = bisect.bisect_right(self.two, high) - 1
        while k >= 0 and self.two[k] > low:
            i, j = self.twos[k]
            if i in held and j in held:
                return i, j
            k -= 1
        return best

    def swap(self, out: tuple[int, ...], back: tuple[int, ...]) -> None:
        self.held.difference_update(out)
        for i in back:
            self.held.add(i)
            k = bisect.bisect_right(self.one, self.sizes[i])
            self.one.insert(k, self.sizes[i])
            self.ones.insert(k, i)


def _refilled(kept: list[tuple[list[int], int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """All bins, once displaced pieces took the place of smaller ones in kept bins and the rest was packed by best fit."""
    loose = _Loose(sizes, items)
    out = Bins(sizes, capacity)
    for held, free in kept:
        if free > 0 and loose.held:
            for back in itertools.chain(((i,) for i in held), itertools.combinations(held, 2) if len(held) <= 8 else ()):
                size = sizes[back[0]] if len(back) == 1 else sizes[back[0]] + sizes[back[1]]
                if found := loose.take(size, size + free):
                    loose.swap(found, back)
                    held = [i for i in held if i not in back] + list(found)
                    free = capacity - sum(sizes[i] for i in held)
                    break
        out.put(list(held), free)
    for i in sorted(loose.held, key=lambda i: (-sizes[i], i)):
        out.fit(i)
    return out.items


class Genome:
    """Bins of item indexes with their free space. Fewer bins are better, then fuller ones."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.free = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.cost = len(bins), -sum((1 - f / capacity) ** 2 for f in self.free)


def crossed(mother: Genome, father: Genome, sizes: list[int], capacity: int, rng: random.Random) -> Genome:
    """mother with well-filled bins of father, fuller than his mean; her bins that hold their pieces go, and some of her emptiest and of chance."""
    hers = {frozenset(b) for b in mother.bins}
    fresh = sorted((f, k) for k, (b, f) in enumerate(zip(father.bins, father.free)) if frozenset(b) not in hers)
    most, mean = max(1, len(fresh) // 3), sum(father.free) / len(father.free)
    gift = [father.bins[k] for f, k in fresh[: 2 * most] if rng.random() < 0.5 and f <= mean][:most]
    held = {i for b in gift for i in b}
    worst = {k for _, k in heapq.nlargest(2 + rng.randrange(3), ((f, k) for k, f in enumerate(mother.free)))} | {rng.randrange(len(mother.bins)) for _ in range(2)}
    kept, loose = [(b, capacity - sum(sizes[i] for i in b)) for b in gift], []
    for k, (b, f) in enumerate(zip(mother.bins, mother.free)):
        if k in worst or any(i in held for i in b):
            loose += [i for i in b if i not in held]
        else:
            kept.append((b, f))
    rng.shuffle(kept)
    return Genome(_refilled(kept, loose, sizes, capacity), sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, population: list[list[list[int]]], *, size: int = POPULATION, generations: int = GENERATIONS, least: int | None = None) -> tuple[list[list[list[int]]], int]:
    """One epoch of an island: its population, best genome first, and the number of crossovers. least: a bound known to hold."""
    rng, least = random.Random(seed), bound(sizes, capacity) if least is None else least
    pool = [Genome(b, sizes, capacity) for b in population] or [Genome(best_fit(sizes, capacity), sizes, capacity)]
    best = min(g.cost for g in pool)
    if best[0] > least:
        pool += [Genome(best_fit(sizes, capacity, 0.05 + 0.25 * rng.random(), rng), sizes, capacity) for _ in range(size - len(pool))]
    done = stall = 0
    while done < generations and stall < STALL and best[0] > least and len(sizes) > 1:
        pick = lambda: min(rng.sample(pool, 2), key=lambda g: g.cost)
        mother, father = pick(), pick()
        child = crossed(mother, father, sizes, capacity, rng)
        done, stall = done + 1, stall + 1
        last = max(range(len(pool)), key=lambda k: pool[k].cost)
        if child.cost < pool[last].cost and all(g.cost != child.cost for g in pool):
            pool[last] = child
        if child.cost < best:
            best, stall = child.cost, 0
    pool.sort(key=lambda g: g.cost)
    return [g.bins for g in pool[:size]], done


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _grouped(genome: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(genome):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


_START = "block long, ids array<long>, sizes array<int>, genome array<int>, first int, bins int, least int"
_ISLAND = "block long, island int, sizes array<int>, pool array<array<int>>, bins int, fill double, least int, crossovers int"


def _by_row(df: DataFrame, run, ddl: str) -> DataFrame:
    """Map single rows, given as dicts, to dicts."""
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([run(batch.slice(k, 1).to_pylist()[0])], schema=schema)

    return df.mapInArrow(each, ddl)


def _started(grouped: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing of each block (block, ids, sizes), and the bound."""

    def run(row):
        bins = best_fit(row["sizes"], capacity)
        return {**row, "genome": _flat(bins, len(row["sizes"])), "first": len(bins), "bins": len(bins), "least": bound(row["sizes"], capacity)}

    return _by_row(grouped, run, _START)


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(row):
        sizes = row["sizes"]
        pool, n = evolve(sizes, capacity, (row["block"] * 31 + row["island"]) * 31 + epoch, [_grouped(g) for g in row["pool"]], least=row["least"])
        cost = Genome(pool[0], sizes, capacity).cost
        return {**row, "pool": [_flat(b, len(sizes)) for b in pool], "bins": cost[0], "fill": cost[1], "crossovers": row["crossovers"] + n}

    return _by_row(islands, run, _ISLAND)


def pack_level(items: DataFrame, blocks: int, store: Written, *, capacity: int, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(block, ids, sizes, genome, first, bins, least, crossovers) of each block's best genome.

    A block that hashing makes larger than ``block`` is cut, so none is.
    """
    spark = store.spark
    key = F.pmod(F.xxhash64("row_id"), F.lit(blocks))
    lists = items.groupBy(key.alias("block")).agg(F.sort_array(F.collect_list(F.struct("row_id", F.col("length").cast("int").alias("length")))).alias("items"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / block)), lambda k: F.slice("items", (k * block + 1).cast("int"), block))
    grouped = lists.select("block", F.posexplode(parts).alias("part", "items")).select((F.col("block") * 1024 + F.col("part")).alias("block"), F.col("items.row_id").alias("ids"), F.col("items.length").alias("sizes"))
    tasks = max(spark.sparkContext.defaultParallelism, min(blocks * islands, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    start = store.write(_started(grouped.repartition(tasks, "block"), capacity))
    rows = start.where("bins > least").select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.array("genome").alias("pool"), "bins", F.lit(0.0).alias("fill"), "least", F.lit(0).alias("crossovers"))
    done = []
    for epoch in range(epochs):
        if (start.where("bins > least") if not epoch else gaps).isEmpty():
            break
        state = store.write(_epoch(rows.repartition(tasks, "block", "island"), capacity, epoch))
        done.append(state)
        # Blocks that have met the bound are left alone from here on.
        gaps = state.groupBy("block").agg(F.min(F.col("bins") - F.col("least")).alias("gap")).where("gap > 0")
        # A ring of islands: each gets the best genome of the one before in place of its last.
        moved = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("pool")[0].alias("came"))
        keep = F.slice("pool", F.lit(1), F.greatest(F.size("pool") - 1, F.lit(1)))
        rows = state.join(moved, ["block", "island"]).join(gaps.select("block"), "block", "left_semi").withColumn("pool", F.concat(keep, F.array("came"))).drop("came")
    if not done:
        return start.withColumn("crossovers", F.lit(0).cast("long"))
    every = done[0].withColumn("epoch", F.lit(0))
    for epoch, state in enumerate(done[1:], 1):
        every = every.unionByName(state.withColumn("epoch", F.lit(epoch)))
    # An island's count goes on over its epochs; its last one has all.
    counts = every.groupBy("block", "island").agg(F.max("crossovers").alias("n")).groupBy("block").agg(F.sum("n").alias("crossovers"))
    best = every.groupBy("block").agg(F.min(F.struct("bins", "fill", "epoch", "island", F.col("pool")[0].alias("genome"))).alias("x")).join(counts, "block")
    best = best.select("block", F.col("x.genome").alias("evolved"), F.col("x.bins").alias("fewer"), "crossovers")
    out = start.join(best, "block", "left").withColumn("genome", F.coalesce("evolved", "genome")).withColumn("bins", F.coalesce("fewer", "bins"))
    return store.write(out.withColumn("crossovers", F.coalesce("crossovers", F.lit(0).cast("long"))).drop("evolved", "fewer"))


def pack(pieces: DataFrame, store: Written, *, capacity: int = CAPACITY, block: int = BLOCK, log: list | None = None) -> DataFrame:
    """(row_id, sequence_id, offset) of each of pieces (row_id, length), 1 <= length <= capacity.

    Full pieces take a sequence each. Ties are broken by row_id; no piece is lost.
    log, if given, gets for each level its pieces, blocks, the bins of best fit, of
    the result and of the bound, and the number of crossovers.
    """
    full = pieces.where(F.col("length") >= capacity).select("row_id", (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level = pieces.where(F.col("length") < capacity).select("row_id", "length"), full, 0
    n, well = rest.count(), WELL
    while n:
        blocks = -(-n // block)
        last = blocks == 1 or well >= 1
        best = pack_level(rest, blocks, store, capacity=capacity, block=block)
        if log is not None:
            log.append({"pieces": n, **best.agg(F.count("*").alias("blocks"), F.max(F.size("sizes")).alias("largest"), F.sum("first").alias("best_fit"), F.sum("bins").alias("bins"), F.sum("least").alias("bound"), F.sum("crossovers").alias("crossovers")).first().asDict()})
        placed = store.write(_places(best.select("block", "ids", "sizes", "genome"), capacity, level, 1.0 if last else well))
        done = done.union(placed.where("sequence_id is not null").select("row_id", "sequence_id", "offset"))
        rest = placed.where("sequence_id is null").select("row_id", "length")
        left = 0 if last else rest.count()
        well *= LOOSER**3 if left > LEFT * n else LOOSER
        n, level = left, level + 1
    return done


def _places(genomes: DataFrame, capacity: int, level: int, well: float) -> DataFrame:
    """(row_id, length, sequence_id, offset) of all pieces, without sequence_id in bins with more than the share well free."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = {"row_id": [], "length": [], "sequence_id": [], "offset": []}
                for k, b in enumerate(_grouped(row["genome"])):
                    sizes = [row["sizes"][i] for i in b]
                    keep = capacity - sum(sizes) <= capacity * well
                    at = 0
                    for i, size in zip(b, sizes):
                        out["row_id"].append(row["ids"][i])
                        out["length"].append(size)
                        out["sequence_id"].append((level << 56) + (row["block"] << 16) + k if keep else None)
                        out["offset"].append(at)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return genomes.mapInArrow(run, "row_id long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: bytes, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, log: list | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    (id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty
    text is one piece of the end id. Repeated rows are packed as rows of their
    own; null ids stay null; other columns are ignored; no rows give no rows. log:
    see pack().
    """
    store = Written(docs.sparkSession)
    pieces = store.write(piece_documents(docs, tokenizer, capacity=capacity, id_col=id_col, text_col=text_col))
    places = pack(pieces.select("row_id", "length"), store, capacity=capacity, block=block, log=log)
    return pieces.join(places, "row_id").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_bytes())
