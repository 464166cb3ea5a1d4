"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The weights
maximise the likelihood that, of a pair of labelled documents of different
quality, the better one is preferred: logistic loss on feature differences.
The cut is a quantile of the training scores: the share of low-quality ones.
A monotone map puts the cut at CUT and strengths between 0 and 1.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, map_rows, map_texts, read

#: Score from which on a document counts as good.
CUT = 0.3
#: Labelled rows that are learned from at most (those with the smallest hashes), and pairs of them.
SAMPLE, PAIRS = 20_000, 200_000
FEATURES = ("log_words", "letters", "upper", "digits", "spaces", "pipes", "bangs", "marks", "stops", "brackets", "quotes", "newlines", "other", "distinct_words", "word_chars", "long_words", "repeated_lines", "words_a_line", "run_share")


def features(text: str | None) -> list[float]:
    """Features of a whole text; an empty or null one has zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return [0.0] * len(FEATURES)
    n, counts = len(raw), np.bincount(raw, minlength=256)
    share = lambda chars: sum(int(counts[ord(c)]) for c in chars) / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    k = max(1, len(words))
    lower, upper, high = int(counts[97:123].sum()), int(counts[65:91].sum()), int(counts[128:].sum())
    letters = lower + upper + high
    same = int((raw[1:] == raw[:-1]).sum())
    return [
        math.log1p(len(words)), letters / n, upper / max(1, letters), int(counts[48:58].sum()) / n, share(" "), share("|"), share("!"), share("#$%&*@^~"), share(".,;:?"), share("(){}[]<>"), share("\"'`"), share("\n"),
        share("\\/_=+-"), len(set(words)) / k, letters / k / 10, sum(len(w) > 20 for w in words) / k, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(k / max(1, len(lines))), same / n,
    ]


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, seed: int = 0) -> dict:
    """Model from features x and labels y (0 or 1). One class only: every score is its share."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"constant": float(len(good) > 0 or not len(y))}
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / pairs - 1e-3 * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + 1e-3 * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile of all scores below which the share of bad labels lies; between the neighbours there.
    order, k = np.sort(s), len(bad)
    cut = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * (s - cut), -30, 30)))
        g, h = float(((y - p) * (s - cut)).sum()) - 1e-2 * slope, float((p * (1 - p) * (s - cut) ** 2).sum()) + 1e-2
        slope = max(1e-3, slope + max(-1.0, min(1.0, g / h)))
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist(), "cut": cut, "slope": slope}


def fit_all(rows: DataFrame, bins: int = 128) -> dict:
    """fit() of rows (y, x) of any number, over all pairs, in passes of which only sums reach the driver.

    A step of Newton needs sums over pairs of functions of their scores'
    difference: those of rows of each class in narrow ranges of the score give
    them, with a range's mean as the score of its rows.
    """
    import pyarrow as pa

    def total(make) -> np.ndarray:
        def run(batches):
            out = None
            for b in batches:
                if b.num_rows:
                    v = make(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("y").to_numpy())
                    out = v if out is None else out + v
            if out is not None:
                yield pa.RecordBatch.from_pydict({"v": pa.array([out.astype("<f8").tobytes()], pa.binary())})

        # At most 64 tasks, of less than a MB each for the driver.
        return sum(np.frombuffer(r.v) for r in rows.coalesce(64).mapInArrow(run, "v binary").collect())

    first = total(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    n, n_good = int(first[0]), int(first[1])
    if n_good in (0, n):
        return {"constant": float(n_good > 0)}
    mean = first[2:] / n
    scale = np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / n)
    scale[scale < 1e-9] = 1.0
    d, pairs = len(mean), n_good * (n - n_good)
    unit = lambda x: np.clip((x - mean) / scale, -8, 8)

    def binned(s: np.ndarray, y: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
        return y * k + np.clip((s - low) / (high - low) * k, 0, k - 1).astype(int)

    w = np.zeros(d)
    for _ in range(30):

        def moments(x, y, w=w):
            z = unit(x)
            at = binned(z @ w, y, -8, 8, bins)
            out = np.zeros((2 * bins, 1 + d + d * d))
            for b in np.unique(at):
                some = z[at == b]
                out[b] = np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
            return out

        m = total(moments).reshape(2, bins, -1)
        count, z, zz = m[:, :, 0], m[:, :, 1 : d + 1], m[:, :, d + 1 :].reshape(2, bins, d, d)
        mid = (z @ w) / np.maximum(count, 1)
        p = 1 / (1 + np.exp(-np.clip(mid[1][:, None] - mid[0][None, :], -30, 30)))
        c, h = 1 - p, p * (1 - p)
        grad = ((c @ count[0]) @ z[1] - (count[1] @ c) @ z[0]) / pairs - 1e-3 * w
        cross = z[1].T @ h @ z[0]
        hess = (np.tensordot(h @ count[0], zz[1], 1) + np.tensordot(count[1] @ h, zz[0], 1) - cross - cross.T) / pairs + 1e-3 * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    # The k-th smallest score, k bad labels, by ever narrower ranges.
    low, below, k = -8 * float(np.abs(w).sum()) - 1, 0, n - n_good
    high = -low
    for _ in range(3):

        def shares(x, y, low=low, high=high):
            s = unit(x) @ w
            s = s[(s >= low) & (s < high)]
            return np.bincount(binned(s, np.zeros(len(s), int), low, high, 1024), minlength=1024).astype(float)

        counts = below + np.cumsum(total(shares))
        b = min(int(np.searchsorted(counts, k)), 1023)
        below = int(counts[b - 1]) if b else below
        low, high = low + (high - low) * b / 1024, low + (high - low) * (b + 1) / 1024
    cut, far = float(high), 8 * float(np.abs(w).sum()) + 1

    def around(x, y):
        s = unit(x) @ w - cut
        at = binned(s, y, -2 * far, 2 * far, 2048)
        return np.concatenate([np.bincount(at, minlength=4096), np.bincount(at, s, minlength=4096)]).astype(float)

    count, s = total(around).reshape(2, 4096)
    s, y = s / np.maximum(count, 1), np.arange(4096) >= 2048
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * s, -30, 30)))
        g, h = float((count * (y - p) * s).sum()) - 1e-2 * slope, float((count * p * (1 - p) * s**2).sum()) + 1e-2
        slope = max(1e-3, slope + max(-1.0, min(1.0, g / h)))
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist(), "cut": cut, "slope": slope}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = np.clip((x - np.array(model["mean"])) / np.array(model["scale"]), -8, 8)
    s = model["slope"] * (z @ np.array(model["w"]) - model["cut"]) + math.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def held_out(id_col: str):
    """Whether crc32 of the id as text is divisible by 5; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = SAMPLE) -> dict:
    """Learn from labelled rows that aren't held out: at most sample labels, by smallest hash of the id, or all if sample is None.

    All rows are learned from by fit() up to SAMPLE of them, else by fit_all().
    The sample is bounded whatever the input is; ids in it are sent to all
    executors, and its features to the driver. Rows with null labels or ids are
    left out; an id with several labels or texts counts with each, and of these
    rows, too, at most sample are learned from, by smallest hash of id and text.
    Without any, every score is 1.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = known if sample is None else F.broadcast(known.orderBy(F.xxhash64("id"), "id", "y").limit(sample))
    rows = texts.join(some, "id")
    # An id may have any number of rows: then the smallest hashes bound what is learned from.
    if sample is not None and rows.select("id").count() > sample:
        rows = rows.withColumn("place", F.xxhash64("id", "text", "y"))
        rows = rows.where(F.col("place") <= rows.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0])

    def make():
        return lambda rows: {"id": rows["id"], "y": rows["y"], "x": [features(t) for t in rows["text"]]}

    if sample is None:
        # Features first: whole texts are not shuffled.
        plain = lambda: lambda rows: {"id": rows["id"], "x": [features(t) for t in rows["text"]]}
        learned = map_rows(texts, plain, "id long, x array<double>", "text").join(known, "id").select("id", "y", "x")
        store = Written(docs.sparkSession)
        try:
            learned = store.write(learned)
            if learned.count() > SAMPLE:
                return fit_all(learned)
            found = learned.collect()
        finally:
            store.close()
    else:
        found = map_rows(rows.select("id", "y", "text"), make, "id long, y int, x array<double>", "text").collect()
    found = sorted((r.id, r.y, r.x) for r in found)
    if not found:
        return {"constant": 1.0}
    return fit(np.array([r[2] for r in found]), np.array([r[1] for r in found]))


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row; null and empty texts get the score of no features."""

    def make():
        return lambda rows: {"id": rows["id"], "score": scores(model, np.array([features(t) for t in rows["text"]]).reshape(-1, len(FEATURES))).tolist()}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_rows(rows, make, "id long, score double", "text")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """Rows of docs, unchanged, whose score is CUT or more. Null texts count as empty."""
    import pyarrow as pa

    def run(batch):
        x = np.array([features(t) for t in batch.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(scores(model, x) >= CUT))

    return map_texts(docs, run, docs.schema, text_col)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels"), sample=None))
