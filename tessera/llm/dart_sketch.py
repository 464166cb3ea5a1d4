"""Word shingles of texts, and DartMinHash signatures of weighted sets.

Darts are thrown at a plane for each element: weight to the right, rank
upwards, one dart for each unit of area on average, all fixed by hashes. The
weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) ...; in each piece darts
come by exponential gaps of rank. An element of weight w owns the darts left of
w. Each dart has a random coordinate; a signature keeps, for each coordinate,
the owned dart of the smallest rank. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Ranks are followed up to a
limit that gives every coordinate a dart at once in most cases, so a signature
takes time in proportion to elements + k log k; where a coordinate stays empty,
the limit is doubled.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash

#: Signature length and the bands it is cut into; words of a shingle.
K, BANDS, WORDS = 128, 32, 5
_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = x + _A
    for shift, factor in ((np.uint64(30), _B), (np.uint64(27), _C)):
        x ^= x >> shift
        x *= factor
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: 64 bits of a word; quicker than a look into a memo.
word_hash = xxhash.xxh3_64_intdigest


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[str], hashes=word_hash, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n words as 64-bit hashes, sorted, and their counts.

    Fewer than n words, but some, are one shingle.
    """
    return shingle_sets([words], hashes, n)[0]


def shingle_sets(texts: list[list[str]], hashes=word_hash, n: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """shingles() of several texts, hashed together."""
    h = np.fromiter(map(hashes, itertools.chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))
    full, out, at = _windows(h, n), [], 0
    for words in texts:
        k = len(words)
        x = full[at : at + k - n + 1] if k >= n else _windows(h[at : at + k], k) if k else full[:0]
        out.append(_counted(x))
        at += k
    return out


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n hashes in a row."""
    x = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for i in range(n):
        x = mix(x ^ h[i : i + len(x)])
    return x


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their counts."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]]))
    return x[at], np.diff(at, append=len(x))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """k darts (64-bit integers) for each set (x: 64-bit integers, w: weights > 0); zeros for empty sets."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, spare = [i for i, (x, _) in enumerate(sets) if len(x)], 2.0
    while todo:
        sizes = np.array([len(sets[i][0]) for i in todo])
        x, w = np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo])
        at = np.repeat(np.arange(len(todo)), sizes)
        limit = k * (math.log(k) + spare) / np.bincount(at, weights=w)
        owner, ranks, darts = _throw(x, w, at, limit)
        slot = owner * k + (mix(darts ^ _C) % np.uint64(k)).astype(np.int64)
        least, best = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        np.minimum.at(least, slot, ranks)
        first = ranks == least[slot]
        best[slot[first]] = darts[first]
        done = np.isfinite(least).reshape(-1, k).all(1)
        out[np.array(todo)[done]] = best.reshape(-1, k)[done]
        todo, spare = [i for i, ok in zip(todo, done) if not ok], 2 * spare + math.log(k)
    return out


def _throw(x: np.ndarray, w: np.ndarray, at: np.ndarray, limit: np.ndarray):
    """Owned darts of all elements up to the rank limits of their sets: (set, rank, dart)."""
    owner, ranks, darts = [], [], []
    low, width = 0.0, 1.0
    while (own := w > low).any():
        base, weight, of = mix(x[own] ^ np.uint64(round(low * 2) + 1)), w[own], at[own]
        r, most = np.zeros(len(base)), limit[of]
        # An element's darts come by their number: 1, 2, 4 ... at once, alike for every set, so that ranks are rounded alike.
        n, some = 0, 1
        while len(base):
            e = mix(base[:, None] + np.arange(n, n + some, dtype=np.uint64) * _D)
            if n == 0:
                # Most elements of a long text have no dart below the limit: they go before logarithms are taken, with room for rounding.
                some_near = _unit(e[:, 0]) >= np.exp(-most * width) * (1 - 1e-9)
                e, r, base, weight, of, most = e[some_near], r[some_near], base[some_near], weight[some_near], of[some_near], most[some_near]
            rank = r[:, None] - np.cumsum(np.log(_unit(e)), axis=1) / width
            hit = near = rank <= most[:, None]
            # An element of weight 1 or more owns all of [0, 1).
            if low > 0 or len(weight) and weight.min() < 1:
                hit = near & (low + width * _unit(mix(e ^ _B)) < weight[:, None])
            owner.append(of[np.nonzero(hit)[0]])
            ranks.append(rank[hit])
            darts.append(e[hit])
            on = near[:, -1]
            r, base, weight, of, most = rank[on, -1], base[on], weight[on], of[on], most[on]
            n, some = n + some, min(2 * some, 256)
        low, width = (1.0, 1.0) if low == 0 else (low * 2, low * 2)
    return np.concatenate(owner), np.concatenate(ranks), np.concatenate(darts)


def signature(x: np.ndarray, w: np.ndarray, k: int = K) -> np.ndarray:
    return signatures([(x, w)], k)[0]


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of a signature, or of each of several; differs by band."""
    rows = sig.reshape(*sig.shape[:-1], bands, -1)
    x = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[-1]):
        x = mix(x ^ rows[..., i])
    return x.view(np.int64)


def weighed(x: np.ndarray, counts: np.ndarray, weights: str = "counts") -> tuple[np.ndarray, np.ndarray]:
    """Shingles with their weights: "distinct" (1), "counts" (how often), or "log" (1 + ln of that, a fraction)."""
    if weights == "distinct":
        return x, np.ones(len(x), np.int64)
    if weights == "log":
        return x, 1 + np.log(counts)
    if weights != "counts":
        raise ValueError(f"unknown weights: {weights}")
    return x, counts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights). Equal sets have 1 whatever the rounding."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][i], b[1][j]).sum(), np.maximum(a[1][i], b[1][j]).sum()
    total = high + (a[1].sum() - a[1][i].sum()) + (b[1].sum() - b[1][j].sum())
    return float(low / total) if total else 0.0


def similarities(a: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """similarity() of a set to several others at once, but for rounding; none is empty."""
    x, w = (np.concatenate(v) for v in zip(*others))
    starts = np.cumsum([0, *(len(v) for v, _ in others[:-1])])
    at = np.minimum(np.searchsorted(a[0], x), len(a[0]) - 1)
    low = np.add.reduceat(np.where(a[0][at] == x, np.minimum(a[1][at], w), 0), starts)
    return low / (a[1].sum() + np.add.reduceat(w, starts) - low)
