"""Operators on texts against libraries, plain patterns and brute force, with odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import bestfit_packing as pack
from tessera.llm import dart_sketch as dart
from tessera.llm import minhash_neardup as near
from tessera.llm import pii_spans as pii
from tessera.llm import quality_classifier as quality
from tessera.llm import sentencepiece_codec as sp
from tessera.llm import substring_dedup as sub
from tessera.llm.common import Written

SCHEMA = "doc_id long, text string, source string, label string, node long"
ODD = [None, "", " ", "\n", "a", "  two  spaces\n\n and\tmore ", "x" * 30_000, "日本語 ½ 😀", "same text here twice over again", "same text here twice over again"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "s", "l", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "ur"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_sentencepiece_equals_the_library_and_decodes(spark):
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), random.Random(1)
    texts = [*ODD, *(prose(rng, 50) for _ in range(10)), "".join(rng.choice("ab é\n.1") for _ in range(3000))]
    got = sorted(sp.encode_documents(frame(spark, texts), sp.model_bytes()).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts):
        assert r.ids == lib.encode(t or "") and r.round_trip and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sp.encode_documents(frame(spark, [], []), sp.model_bytes()).count() == 0
    back = {r.doc_id: r.text for r in sp.decode_documents(sp.encode_documents(frame(spark, texts), sp.model_bytes()), sp.model_bytes()).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    odd = spark.createDataFrame([(1, None), (None, []), (2, [-1, 10**6, None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode_documents(odd, sp.model_bytes()).collect()} == {1: "", None: "", 2: lib.decode([0, 0, 0])[1:] if lib.decode([0, 0, 0])[:1] == " " else lib.decode([0, 0, 0])}


def test_streaming_commits_early_and_unigram_paths_are_best():
    codec = sp.Codec(sp.model_bytes())
    runs = list(codec.stream("▁" + "abcdef" * 2000))
    assert len(runs) > 50 and max(map(len, runs)) < 100

    def message(pieces):
        field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
        body = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, t])) for p, s, t in pieces)
        return body + field(2, b"\x18\x01") + field(3, b"\x18\x00\x20\x00")

    pieces = [("<unk>", 0, 2), *((c, -4.0, 1) for c in "abc"), ("ab", -5.0, 1), ("bc", -4.5, 1), ("abc", -9.5, 1), ("ca", -6.0, 1)]
    unigram, rng = sp.Codec(message(pieces)), random.Random(0)
    score = {p: s for p, s, t in pieces if t == 1}
    for _ in range(50):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        best = [0.0]
        for i in range(1, len(s) + 1):
            best.append(max(best[i - n] + score[s[i - n : i]] for n in (1, 2, 3) if n <= i and s[i - n : i] in score))
        ids = [x for run in unigram.stream(s) for x in run]
        assert "".join(unigram.model.pieces[i] for i in ids) == s and abs(sum(unigram.model.scores[i] for i in ids) - best[-1]) < 1e-4


def test_packing_is_whole_gapless_and_close_to_the_bound(spark):
    from tokenizers import Tokenizer

    rng, lib = random.Random(2), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, "it's <|endoftext|> we'd", *(prose(rng, rng.randint(1, 700)) for _ in range(60))]
    got = pack.pack_documents(frame(spark, texts, [0] * 2 + list(range(2, len(texts)))), pack.tokenizer_bytes(), capacity=256, block=25).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        if i < 2:
            continue
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.length for r in parts] == [(len(ids) - 1) % 256 + 1, *[256] * ((len(ids) - 1) // 256)] and [r.piece for r in parts] == list(range(len(parts)))
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by[0]) == 2 and len(seqs) <= -(-sum(r.length for r in got) // 256) + 2


def plain_bound(sizes, capacity):
    """Volume, and for each k: large pieces need a bin each, small ones only fit beside those below capacity - k."""
    best = -(-sum(sizes) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = [x for x in sizes if x > capacity - k]
        middle = [x for x in sizes if capacity // 2 < x <= capacity - k]
        small = [x for x in sizes if k <= x <= capacity // 2]
        best = max(best, len(alone) + len(middle) + max(0, -(-(sum(small) - (len(middle) * capacity - sum(middle))) // capacity)))
    return best


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 19) for _ in range(rng.randint(0, 12))]
        assert pack.bound(sizes, 20) == (plain_bound(sizes, 20) if sizes else 0) <= len(pack.best_fit(sizes, 20))


@pytest.mark.parametrize("kind", ["triples", "uniform"])
def test_evolution_gains_bins_over_best_fit(kind):
    rng, sizes = random.Random(3), []
    while len(sizes) < 240:
        a = rng.randint(780, 1000)
        b = rng.randint(500, (2048 - a) // 2)
        sizes += [a, b, 2048 - a - b] if kind == "triples" else [rng.randint(500, 900) for _ in range(3)]
    first = pack.best_fit(sizes, 2048)
    pool, crossings = pack.evolve(sizes, 2048, 2, [first], generations=60)
    best = pool[0]
    assert sorted(i for b in best for i in b) == list(range(240)) and all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert len(best) <= 0.95 * len(first) and len(best) >= pack.bound(sizes, 2048) and crossings > 10


def test_islands_beat_best_fit_and_levels_are_few(spark):
    rng, store, log = random.Random(4), Written(spark), []
    rows = [(i, rng.randint(500, 900)) for i in range(600)]
    got = pack.pack(spark.createDataFrame(rows, "row_id long, length long"), store, block=200, log=log)
    assert got.count() == 600 and log[0]["bins"] < log[0]["best_fit"] and log[0]["crossovers"] > 50 and max(x["largest"] for x in log) <= 200
    log = []
    got = pack.pack(spark.range(64).selectExpr("id AS row_id", "1100L AS length"), store, block=8, log=log)
    assert got.select("sequence_id").distinct().count() == 64 and len(log) <= 5 and max(x["largest"] for x in log) <= 8


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for k, p in PLAIN.items():
        spans = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or k == "phone" and 8 <= len(digits) <= 15:
                spans.append(m.span())
        out[k] = spans
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    fixed = ["4111 1111 1111 1111", "a@b.c_d@e.f @x.y z@w", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+1 (017) 555-7713", "٣.1.2.3.4", "a@b..c", "+1 2"]
    for t in [*fixed, *("".join(rng.choice("1234a@..-_ +()é") for _ in range(50)) for _ in range(3000))]:
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 200_000 + "a" * 200_000)["ip"] == []


def plain_candidates(text, base):
    """Candidates beyond the base spans, by trying every place against every span."""
    taken, out = [x for spans in base.values() for x in spans], []
    free = lambda s, e: all(e <= x or y <= s for x, y in taken)
    out += [("email", m.start(), m.end()) for m in re.finditer(r"\S+", text) if "@" in m[0] and free(*m.span())]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        n = len(re.sub("[^0-9]", "", m[0]))
        if n >= 8 and free(*m.span()):
            out.append(("card" if n >= 13 else "phone", m.start(), m.end()))
    out += [("secret", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_\-/+=]{20,}", text) if re.search("[0-9]", m[0]) and not m[0].isdigit() and free(*m.span())]
    return sorted(out)


def test_candidates_equal_plain_ones():
    rng = random.Random(14)
    bits = ["4111 1111 1111 1111", "a@b.com", "x@y", "@", "10.0.0.1", "+45 12 34 56 78", "12345678", "0123456789abcdef0123", "token=", " ", "\n", "\u00a0", "é", "word", "sk-" + "a1" * 12]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        base = pii.base_spans(t)
        known = {(k, *x) for k, spans in base.items() for x in spans}
        assert sorted(x[:3] for x in pii.candidates(t, base) if x[:3] not in known) == plain_candidates(t, base), t


def test_long_texts_take_linear_time():
    model = pii.fit({})
    began = time.monotonic()
    text = "mail a@mail.example.com or x@y, card 4111 1111 1111 1111, call +45 12 34 56 78; " * 50_000
    assert len(pii.find_spans(text, model)[1]) >= 150_000
    for text in ("a@" * 500_000, "@" * 1_000_000, "9" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "1.2.3." * 200_000):
        pii.find_spans(text, model)
    assert time.monotonic() - began < 60
    local = "a" * 100
    assert [x[1:3] for x in pii.candidates(f"to {local}@host now", {k: [] for k in pii.BASE})] == [(3, 108)]


def test_supervision_adds_secrets_and_keeps_base(spark):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    texts = [*ODD, *(f"say {secret} and mail a{i}@mail.example.com now 12345678" for i in range(8)), "x@y"]
    docs = frame(spark, texts)
    model = pii.train(docs)
    got = sorted(pii.detect(docs, model).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(texts) and got[10].spans == "email:64:83,secret:13:53" and got[10].n_email == 1 and got[0].spans == "" and got[-1].n_email == 0
    masked = sorted(pii.mask(docs, model).collect(), key=lambda r: r.doc_id)
    assert masked[0].text is None and masked[10].text == 'say token = "<secret>" and mail <email> now 12345678' and masked[10].source == "s"


def test_quality_ranks_held_out_documents(spark):
    rng = random.Random(5)
    texts = [*ODD, *(prose(rng, 80) if i % 4 else " | ".join(prose(rng, 80).split()) for i in range(200))]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int((i - 10) % 4 > 0), 0) for i in range(10, 210)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i].predicted == int((i - 10) % 4 > 0) for i in range(10, 210))
    assert quality.keep_good(docs, model).where("doc_id >= 10").count() == 150
    assert quality.train(docs, labels.limit(0)) == {"constant": 1.0}


WEIGHTS = {"distinct": lambda n: 1, "counts": lambda n: n, "log": lambda n: 1 + math.log(n)}


def jaccard(a, b, weights="counts"):
    """Weighted Jaccard similarity of two texts' shingles of five words."""
    of = WEIGHTS[weights]
    s = [{k: of(n) for k, n in Counter(zip(*[w[k:] for k in range(5)]) if len(w) >= 5 else [tuple(w)] if w else []).items()} for w in (t.lower().split() for t in (a or "", b or ""))]
    total = sum(max(s[0].get(k, 0), s[1].get(k, 0)) for k in s[0].keys() | s[1].keys())
    return sum(min(n, s[1][k]) for k, n in s[0].items() if k in s[1]) / total if total else 0.0


@pytest.mark.parametrize("weights", WEIGHTS)
def test_shingles_and_similarities_of_several_texts_equal_those_of_one(weights):
    rng = random.Random(9)
    texts = [[rng.choice("abc") for _ in range(n)] for n in (0, 1, 4, 5, 6, 90, 0, 300)]
    sets = [dart.shingles(t) for t in texts]
    for (x, n), (y, m), t in zip(sets, dart.shingle_sets(texts), texts):
        assert (x == y).all() and (n == m).all() and n.sum() == (max(1, len(t) - 4) if t else 0)
    some = [dart.weighed(*x, weights) for x in sets if len(x[0])]
    for a in some:
        assert np.abs(dart.similarities(a, some) - [dart.similarity(a, b) for b in some]).max() < 1e-12


@pytest.mark.parametrize("scale", [1.0, 0.37, 0.05])
def test_signatures_estimate_weighted_similarity(scale):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 400) * scale, rng.integers(1, 9, 400) * scale
    a, b = dart.signatures([(x, wa), (x[:300], wb[:300])], 512)
    true = np.minimum(wa[:300], wb[:300]).sum() / (np.maximum(wa[:300], wb[:300]).sum() + wa[300:].sum())
    assert abs((a == b).mean() - true) < 0.08 and (dart.signature(x, wa, 512) == a).all()
    assert abs(dart.similarity((np.sort(x), wa[np.argsort(x)]), (np.sort(x[:300]), wb[:300][np.argsort(x[:300])])) - true) < 1e-12


@pytest.mark.parametrize("weights", WEIGHTS)
def test_repeats_weigh_as_asked(spark, weights):
    """A text that repeats a passage is like its plain form by distinct shingles, and less so by their counts."""
    rng = random.Random(17)
    parts = [prose(rng, 30) for _ in range(4)]
    texts = [" ".join(parts), " ".join(parts + [parts[0]] * k) if (k := 6) else "", " ".join(parts + parts[:1])]
    same = {(i, j) for i in range(3) for j in range(i) if jaccard(texts[i], texts[j], weights) >= 0.8}
    got = [r.class_id for r in sorted(near.near_duplicates(frame(spark, texts), weights=weights, slack=1)[0].collect(), key=lambda r: r.id)]
    assert got[2] == (0 if (2, 0) in same else 2) and got[1] == (0 if (1, 0) in same or {(2, 0), (2, 1)} <= same else 1)
    assert (got == [0, 0, 0]) == (weights == "distinct")


@pytest.mark.parametrize("weights", WEIGHTS)
def test_near_duplicates_equal_brute_force(spark, weights):
    rng = random.Random(7)
    texts = list(ODD[:-2])
    for g in range(4):
        source = prose(rng, 120).split()
        for _ in range(9):  # chains: edits of edits
            texts.append(" ".join(source))
            source = list(source)
            source[rng.randrange(len(source))] = "edit%d" % rng.randrange(1000)
            source += source[:7] if len(texts) % 4 == 0 else []
    texts += [texts[10], texts[10].upper(), "same text here", "same text  here", "Same text"]
    got = {r.id: r for r in near.near_duplicates(frame(spark, texts), chunk=4, rounds=1, weights=weights)[0].collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j], weights) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[i].class_id for i in range(len(texts))] == root and all(r.kept == (r.class_id == i) for i, r in got.items())
    kept = near.keep_one(frame(spark, texts), weights=weights)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == ["doc_id", "text", "source", "label", "node"]


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_are_not_lost_to_the_estimate(spark, rounds):
    """Pairs of similarity 0.8 of whose 128 darts only 81 to 83 agree, by pivots and by blocks."""
    words = [[f"w{seed}x{i}" for i in range(14)] for seed in (13053, 4054, 44799, 18404)]
    sigs = dart.signatures([dart.shingles(w[:n], dart.word_hash) for w in words for n in (14, 12)])
    assert [int((a == b).sum()) for a, b in zip(sigs[::2], sigs[1::2])] == [81, 82, 82, 83]
    texts = [" ".join(w[:n]) for w in words for n in (14, 12)]
    got = {r.id: r.class_id for r in near.near_duplicates(frame(spark, texts), rounds=rounds)[0].collect()}
    assert [got[i] for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]


def test_repeated_passages_go_and_the_rest_stays(spark):
    rng = random.Random(8)
    line = lambda: ". ".join(prose(rng, 12).capitalize() for _ in range(6)) + "."
    passage = line()
    texts = [*ODD, f"{line()}\n{passage}\n{line()}", f"{line()} {passage} {line()}", f"tail words {passage} more words", line(), f"{passage}\n{passage}"]
    got = {r.doc_id: r for r in sub.dedup(frame(spark, texts), spans_col="removed").collect()}
    assert [got[i].text for i in range(10)] == ODD and got[10].text == texts[10] and got[13].text == texts[13] and got[14].text == ""
    for i in (11, 12):
        assert passage not in got[i].text and got[i].removed
        spans = [tuple(map(int, x.split(":"))) for x in got[i].removed.split(",")]
        assert sub.without(texts[i], spans) == got[i].text and sum(e - s for s, e in spans) >= 0.7 * len(passage)
    assert got[12].text.startswith("tail words") and got[12].text.endswith("more words")
    assert sub.dedup(frame(spark, [], [])).count() == 0


def test_short_repeated_lines_and_unspaced_text_go(spark):
    hot, title, para = "Licensed under the Mit License", "The Great Wall Of China", "one two\nthree four\nfive"
    han = "我们在这里写一句相当长的话。" * 2 + "".join(chr(0x4E00 + 37 * k) for k in range(40)) + "！"
    thai = " ".join("".join(chr(0x0E01 + (7 * k + 3 * j) % 46) for k in range(20)) for j in range(6))
    texts = [
        f"first text alone\n{hot}\nmore of it", f"second\n{hot}\nmore of that", f"third\n( {hot.upper()}.\nend", "great\nwall\nof\nchina\nthe", f"fifth\n{title}\nstays", f"sixth\n{title}\ngoes",
        f"a\n\n{para}\n\nb", f"c\n\n{para}\n\nd", f"甲{chr(10)}{han}", f"乙在前。{han}丙在後。", f"{thai}", f"ก {thai} ข", "短い行です、繰り返し\n x", "y\n短い行です、繰り返し",
    ]
    got = {r.doc_id: r.text for r in sub.dedup(frame(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == "second\nmore of that" and got[2] == "third\nend", "a short line goes in later texts"
    assert got[4] == texts[4] and got[5] == "sixth\ngoes", "words that each stand elsewhere do not make a line repeated"
    assert got[6] == texts[6] and got[7] == "c\n\nd" and got[8] == texts[8] and got[9] == "乙在前。丙在後。"
    assert got[10] == thai and got[11] == "ก ข" and got[12] == texts[12] and got[13] == "y"


@pytest.mark.parametrize("text", ["A b. C d!\nE f", "", "  \n x", "ab\n\n\nCd. e"])
def test_units_cover_all_words(text):
    assert " ".join(text[s:e] for s, e in sub.units(text)).split() == text.split()
