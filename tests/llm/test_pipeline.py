"""The pipeline and its stages against plain Python on small corpora, with odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from tessera.llm import bestfit_packing as pack
from tessera.llm import common
from tessera.llm import pii_spans as pii
from tessera.llm import quality_classifier as quality
from tessera.llm import substring_dedup as sub

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, stays boolean, __row int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "ur"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def corpus():
    """(doc_id, text): prose and junk, copies and near copies, shared lines, personal data, odd texts and repeated rows."""
    rng = random.Random(21)
    shared = [prose(rng, 30) for _ in range(3)]
    texts = []
    for k in range(60):
        parts = [prose(rng, rng.randint(15, 40)) for _ in range(3)]
        if k % 4 == 0:
            parts.insert(rng.randrange(3), shared[k % 3])
        if k % 5 == 0:
            parts.append(f"Write to user{k}@mail.example.com or call +45 12 34 56 {k:02d}.")
        if k % 7 == 0:
            parts = ["|".join(p.split()) + "!!! ###" for p in parts]
        texts.append("\n".join(parts))
    texts += [texts[1], texts[2].replace(".", "!"), texts[3] + " Tail", texts[8].upper(), None, "", " ", "x" * 5000, "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], (None, "A text without an id stands here for once, and is rather short.")]


def shingles(text):
    w = (text or "").lower().split()
    out = {}
    for k in zip(*[w[i:] for i in range(5)]) if len(w) >= 5 else [tuple(w)] if w else []:
        out[k] = out.get(k, 0) + 1
    return out


def plain_keep_one(rows):
    sets = [shingles(t) for _, t in rows]
    order = [(i is None, i or 0) for i, _ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            total = sum(max(sets[a].get(k, 0), sets[b].get(k, 0)) for k in sets[a].keys() | sets[b].keys())
            if total and sum(min(n, sets[b].get(k, 0)) for k, n in sets[a].items()) / total >= 0.8:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    best = {}
    for k in range(len(rows)):
        best[root[k]] = min(best.get(root[k], (order[k], k)), (order[k], k))
    stays = {rows[k][0] for _, k in best.values()}
    return [r for r in rows if r[0] in stays]


def plain_dedup(rows, min_words=sub.MIN_WORDS):
    """Removed spans and texts of (id, text), by a dict of normalised passages; null ids come last."""
    first, found = {}, []
    for i, t in rows:
        spans = sub.units(t or "")
        marks = [(3 * k, sub.normal(t[s:e])) for k, (s, e) in enumerate(spans)]
        for kind, ranges in enumerate(sub.blocks(t or "", spans), 1):
            marks += [(3 * a + kind, sub.normal(t[spans[a][0] : spans[b - 1][1]])) for a, b in ranges if len(sub._core(t, spans, a, b)) > 1]
        found.append((i, t, spans, marks))
        for at, x in marks:
            place = (i is None, i or 0, at)
            first[x] = min(first.get(x, place), place)
    out = []
    for i, t, spans, marks in found:
        runs = sub.repeated_runs(t, spans, [at for at, x in marks if first[x] < (i is None, i or 0, at)], min_words) if t else []
        out.append((i, sub.without(t, runs) if runs else t, ",".join(f"{s}:{e}" for s, e in runs)))
    return out


def plain_mask(rows):
    counts = {}
    for _, t in rows:
        for kind, _, _, votes in pii.candidates(t, pii.base_spans(t)) if t else ():
            counts[kind, votes] = counts.get((kind, votes), 0) + 1
    model = pii.fit(counts)
    return [(i, None if t is None else pii.mask_text(t, model)) for i, t in rows]


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "", row[1] is None)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 1) for i, t in rows], SCHEMA)


def tables(spark, path, rows, labels):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_equal_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    labels = [(k, int(k % 7 > 0), 0) for k in range(60)]
    sf = tables(spark, tmp_path / "in", rows, labels)
    model = quality.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    left = [r for r in rows if float(quality.scores(model, np.array([quality.features(r[1])]))[0]) >= quality.CUT]
    assert 8 <= len(rows) - len(left) <= 14 and all(k % 7 for k in (i for i, _ in left) if k is not None and k < 60)
    steps = [left, plain_keep_one(left)]
    steps.append([(i, t) for i, t, _ in plain_dedup(steps[-1])])
    steps.append(plain_mask(steps[-1]))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
        assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(steps[k], key=key), name
        assert all(r.n_chars == len(r.text or "") or r.text is None for r in got) and all(r.source == "s" for r in got)
    assert len(steps[0]) > len(steps[1]) and steps[1] != steps[2] != steps[3] and any("<email>" in (t or "") for _, t in steps[3])
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = []
    for i, t in steps[3]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        cut = (len(ids) - 1) % 2048 + 1
        for p, start in enumerate([0, *range(cut, len(ids), 2048)]):
            part = ids[start : cut if p == 0 else start + 2048]
            expected.append((i, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), corpus_pipeline.run(spark, sf).collect()):
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(expected, key=str)
        ends = {}
        for r in sorted(out, key=lambda r: r.offset):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 2048 and len(ends) <= pack.bound([r.length for r in out], 2048) + 1


def test_pipeline_of_no_documents_and_of_none_labelled(spark, tmp_path):
    sf = tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    sf = tables(spark, tmp_path / "odd", [(1, None), (1, None), (None, ""), (2, "Some words of text stand here.")], [])
    with common.scope():
        assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == [0, 1, 1, 2]
    bare = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(r.doc_id for r in stage(spark, bare, sf).collect()) == [1, 2]


def test_intermediates_go_with_their_scope(spark, tmp_path):
    import glob

    shared = common.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{shared}/*"))
    sf = tables(spark, tmp_path / "in", corpus()[:20], [])
    with common.scope():
        corpus_pipeline.run(spark, sf).write.parquet(str(tmp_path / "out"))
        assert set(glob.glob(f"{shared}/*")) > before
    assert set(glob.glob(f"{shared}/*")) == before and spark.read.parquet(str(tmp_path / "out")).count() >= 10


def test_repeated_passages_equal_a_dict_of_passages(spark):
    rng = random.Random(31)
    for trial in range(3):
        pool = [prose(rng, rng.randint(1, 14)) for _ in range(25)]
        glue = ["\n", "\n\n", " ", "\n"]
        rows = [(rng.choice([None, *range(25)]), "".join(rng.choice(pool) + rng.choice(glue) for _ in range(rng.randint(0, 9)))) for _ in range(40)] + [(3, None), (4, "")]
        docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, Removed string")
        got = sub.dedup(docs, min_words=8, spans_col="removed").collect()
        assert sorted(((r.doc_id, r.text, r.removed) for r in got), key=lambda r: (key(r), r[2])) == sorted(plain_dedup(rows, 8), key=lambda r: (key(r), r[2]))
        assert sum(bool(r.removed) for r in got) > 10


def test_weights_are_where_the_loss_of_pairs_is_least():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0]) + rng.normal(size=300) > 0.8).astype(int)
    model = quality.fit(x, y, pairs=5000, seed=4)
    z = np.clip((x - np.array(model["mean"])) / np.array(model["scale"]), -8, 8)
    draw = np.random.default_rng(4)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[draw.choice(good, 5000)] - z[draw.choice(bad, 5000)]
    loss = lambda w: float(np.log1p(np.exp(-diff @ w)).mean() + 5e-4 * w @ w)
    w = np.array(model["w"])
    for step in np.vstack([np.eye(5), -np.eye(5)]) * 1e-2:
        assert loss(w) < loss(w + step)
    share = (quality.scores(model, x) < quality.CUT).mean()
    assert abs(share - (y == 0).mean()) < 0.01, "the cut is the quantile of the share of bad labels"


def test_a_repeated_id_does_not_grow_what_is_learned_from(spark, monkeypatch):
    one, two, three = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5][:3]
    docs = spark.createDataFrame([(one, f"text {k}") for k in range(500)] + [(two, "|||"), (three, "more text")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1, 0), (two, 0, 0), (three, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, labels, sample=50)
    quality.train(docs, labels)
    assert seen == [50, 502]


def test_all_labels_are_learned_from(spark, monkeypatch):
    """Above SAMPLE rows, too: weights, cut and slope are those of fit() on all rows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 3))
    y = (x @ np.array([1.5, -1.0, 0.0]) + rng.normal(size=4000) > 0.5).astype(int)
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y.tolist(), x.tolist()))], "id long, y int, x array<double>")
    got, plain = quality.fit_all(rows), quality.fit(x, y)
    assert np.allclose(got["mean"], plain["mean"]) and np.allclose(got["scale"], plain["scale"])
    assert np.abs(np.array(got["w"]) - plain["w"]).max() < 0.05 and abs(got["slope"] - plain["slope"]) < 0.05
    s = np.clip((x - np.array(got["mean"])) / np.array(got["scale"]), -8, 8) @ np.array(got["w"])
    assert (s < got["cut"]).sum() == (y == 0).sum()
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, "good text" if k % 3 else "| | !") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in ids], "doc_id long, quality int, toxic int")
    seen, whole = [], quality.fit_all
    monkeypatch.setattr(quality, "SAMPLE", 50)
    monkeypatch.setattr(quality, "fit_all", lambda rows: seen.append(rows.count()) or whole(rows))
    model = quality.train(docs, labels, sample=None)
    assert seen == [len(ids)] and quality.keep_good(docs, model).count() == sum(k % 3 > 0 for k in ids)
