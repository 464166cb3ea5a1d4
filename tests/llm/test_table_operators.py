"""Operators on pages, conversations and vectors, and the pipeline, with odd rows."""

import os
import random
import time
from collections import Counter

import numpy as np

from tessera.llm import chat_quotes as chat
from tessera.llm import embedding_neardup as emb
from tessera.llm import topk_search as topk
from tessera.llm import url_filter as url
from tessera.llm.common import Written, connected_components

NAN, INF = float("nan"), float("inf")


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)] + [(7, None), (300, 300)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Written(spark)).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "u string, v string"), Written(spark)).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<html><LINK REL="canonical" href="{}"></html>'
    pages = [
        (1, "http://Sub.Example.ORG/es/x?y#z", None), (2, "https://example.org/en/1x", ""), (3, "http://a.org/", "x"), (4, "http://a.com/de/1", link.format("http://b.net/1")), (5, "http://b.net/1#f", "x"),
        (6, "http://c.net/2", '<meta http-equiv="refresh" content="0; url=/3">'), (7, "http://c.net/3", link.format("http://d.com/fr/1")), (8, "http://e.net/4", link.format("//a.com/de/9")), (9, None, "x"), (10, "no scheme", None),
        (11, "http://d.org", "x"), (12, "http://myexample.org/es/1", "x"), (8, "http://e.net/4", link.format("//a.com/de/9")), (13, "://x.org/a", None), (14, "http://c.net/2?q", link.format("http://e.net/4")), (15, "http://c.net/2?q", link.format("http://c.net/3")),
    ]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, component string, node long")
    got = {r.page_id: r for r in url.filter_urls(df).collect()}
    shown = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert shown[1] == ("sub.example.org", "/es/x", "example.org/es/", "block") and shown[2] == ("example.org", "/en/1x", "example.org/en/1", "block") and shown[3] == ("a.org", "/", "org/", "allow")
    assert shown[4][3] == "block" and shown[5] == ("b.net", "/1", None, "block"), "a block decision reaches the alias"
    assert shown[6][3] == shown[7][3] == "allow" and shown[8][3] == "allow", "an allowed alias goes before a blocked one"
    assert shown[9] == shown[10] == ("", "", None, "allow") and shown[11] == ("d.org", "", None, "allow") and shown[12][2] == "org/" and shown[13] == ("x.org", "/a", "org/", "allow")
    assert url.filter_urls(df).count() == len(pages) and url.filter_urls(df.limit(0)).count() == 0


def test_links_of_any_length_relative_or_with_entities(spark):
    page, long = "http://a.net/d/e/p.html?q=1#f", "http://b.net/" + "x" * 3000
    cases = {
        long: long, "page.html": "http://a.net/d/e/page.html", "?x=1": "http://a.net/d/e/p.html?x=1", "../up": "http://a.net/d/up", "./": "http://a.net/d/e/", "../../../..": "http://a.net/", "/r/../s?u=http://t/../z": "http://a.net/s?u=http://t/../z",
        "http://b.net/?a=1&amp;b=2": "http://b.net/?a=1&b=2", "?a&#38;b&#x26;c&amp;amp;d&eacute;&nix;": "http://a.net/d/e/p.html?a&b&c&amp;d\u00e9&nix;", "&#x1F600;": "http://a.net/d/e/\U0001f600", "//c.net/z": "http://c.net/z", "mailto:x@y": None, "#top": None,
    }
    for kind in ('<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'):
        df = spark.createDataFrame([(page, kind.format(t)) for t in cases], "url string, html string")
        assert sorted(r.v for r in url.link_edges(df).collect()) == sorted(v for v in cases.values() if v)
    df = spark.createDataFrame([("http://a.net", kind.format("p")), ("no scheme", kind.format("p"))], "url string, html string")
    assert [tuple(r) for r in url.link_edges(df).collect()] == [("http://a.net", "http://a.net/p")]


def test_pages_whose_links_were_lost_or_made_up(spark):
    long = "http://a.com/de/" + "x" * 3000
    pages = [
        (1, "http://q.net/1", f'<link rel="canonical" href="{long}">'), (2, "http://q.net/login/2", '<link rel=canonical href="/login?u=http://z.com/de/1">'), (3, "http://a.com/de/dir/p", "x"), (4, "http://q.net/d/4", '<link rel="canonical" href="other.html">'),
        (5, "http://q.net/d/other.html", '<link rel="canonical" href="http://b.com/de/5">'), (6, "http://q.net/d/e/6", '<link rel="canonical" href="../other.html">'), (7, "http://q.net/7", '<link rel="canonical" href="?v">'), (8, "http://q.net/7?v", '<meta http-equiv=refresh content="0;url=http://b.com/de/8">'),
        (9, "http://q.net/9", '<link rel="canonical" href="#top">'), (10, "http://q.net/10?a=1&b=2", '<link rel="canonical" href="http://b.com/de/10">'), (11, "http://q.net/11", '<link rel="canonical" href="http://q.net/10?a=1&amp;b=2">'),
    ]
    got = {r.page_id: r.verdict for r in url.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: "allow" if k in (2, 9) else "block" for k in range(1, 12)}


def test_equal_rules_block_and_the_longest_wins(spark):
    rules = spark.createDataFrame([("a.net", "/x", "allow"), ("a.net", "/x", "block"), ("net", "/", "block"), ("a.net", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/x/y", None), (2, "http://a.net/y", None), (3, "http://b.net/", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url.filter_urls(pages, rules).collect()} == {1: ("a.net/x", "block"), 2: ("a.net/", "allow"), 3: ("net/", "block")}


def test_verdicts_equal_union_find(spark):
    """Made-up links with a hub, chains and cycles; rules decide on some pages only."""
    rng = random.Random(11)
    hosts = ["a.org", "b.com", "c.net", "d.net", "sub.example.org"]
    paths = ["/fr/", "/de/", "/x/", "/es/", "/en/1"]
    urls = [f"http://{rng.choice(hosts if k % 3 else hosts[2:4])}{rng.choice(paths)}{k}" for k in range(300)]
    links = [(k, rng.randrange(300)) for k in range(0, 300, 4)] + [(k, 7) for k in range(100, 180)] + [(k, k + 1) for k in range(200, 240)]
    html: dict[int, str] = {}
    for a, b in links:
        html[a] = html.get(a, "") + f'<link rel="canonical" href="{urls[b]}">'
    redirects = [(urls[260], urls[261]), (urls[261], urls[262]), (urls[262], urls[260])]
    root = list(range(300))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links + [(260, 261), (261, 262)]:
        root[max(find(a), find(b))] = min(find(a), find(b))

    def own(u):
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), v) for h, p, v in url.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    decided: dict[int, set] = {}
    for k, u in enumerate(urls):
        decided.setdefault(find(k), set()).add(own(u))
    expected = {k: own(u) or min(decided[find(k)] - {None}, default="allow") for k, u in enumerate(urls)}
    pages = spark.createDataFrame([(k, u, html.get(k)) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = url.filter_urls(pages, redirects=spark.createDataFrame(redirects, "u string, v string")).collect()
    assert {r.page_id: r.verdict for r in got} == expected and {"allow", "block"} == set(expected.values())
    comps = {r.page_id: r.component for r in got}
    size = Counter(find(k) for k in range(300))
    assert all((comps[k] is None) == (size[find(k)] == 1) for k in range(300))
    assert len({c for c in comps.values() if c}) == sum(n > 1 for n in size.values())


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nIn Python."), (1, 1, "assistant", "Use sorted()."), (1, 2, "user", "> use  SORTED()\n\nAnd back?"), (1, 3, "assistant", ">> How do I sort?\n>> In Python.\n> Use sorted().\nThat first."),
        (2, 0, "user", "> Use sorted().\nElse?"), (2, 1, "user", "> unknown\n5 > 3"), (None, None, None, None), (3, 0, "user", ""), (1, 1, "assistant", "Use sorted()."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, uid string")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id or -1, r.place))
    one = [(r.place, r.turn, r.text, r.reply_to_turn, r.max_level) for r in got if r.conv_id == 1]
    assert one == [(0, 0, "How do I sort?\nIn Python.", None, 0), (1, 1, "Use sorted().", None, 0), (2, 1, "Use sorted().", None, 0), (3, 2, "And back?", 1, 1), (4, 3, "That first.", 1, 2)]
    two = [(r.text, r.reply_to_conv, r.reply_to_turn, r.n_quotes) for r in got if r.conv_id == 2]
    assert two == [("Else?", 1, 1, 1), ("5 > 3", None, None, 1)]
    assert len(got) == len(rows) and got[0].formatted == "<|user|>\n\n<|end|>\n" and chat.format_chats(df.limit(0)).count() == 0


def test_excerpts_link_by_their_parts(spark):
    long = "The first sentence is of some length. The second one goes on for a while!"
    rows = [
        (1, 0, "Hi,\nalpha beta gamma\ndelta epsilon\nzeta eta"), (1, 1, "Alpha beta gamma"), (1, 2, long), (1, 3, ">\n> delta epsilon"), (1, 4, "> Bob wrote:\n> ...\n> zeta eta\n> changed"),
        (1, 5, "> The first sentence is of\n> some length. The second one\n> goes on"), (1, 6, "> Hi,\n> only elsewhere, a line of words\n> and another"), (2, 0, "Top\nonly elsewhere, a line of words\nand another\nend"),
        (3, 0, "> kept twice in here"), (3, 1, "kept twice in here"), (4, 2, "kept twice in here"), (5, 0, "kept twice in here"), (6, 1, "one two\nthree four\nfive six"), (5, 1, "one two"), (5, 2, "three four"), (7, 0, "> one two\n> three four\n> lost"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv, r.turn): (r.reply_to_conv, r.reply_to_turn) for r in chat.link_quotes(df)[0].collect()}
    assert got[1, 3] == (1, 0) and got[1, 4] == (1, 0), "an empty first line, an attribution, an ellipsis and an edit"
    assert got[1, 5] == (1, 2) and got[1, 6] == (2, 0) and got[7, 0] == (6, 1), "a passage wrapped anew; the longest match, not the first"
    assert got[3, 0] == (4, 2), "the earliest other conversation, though its own is the earliest of all"


def plain_chat(rows):
    """Rows (turn, parent turn or None) of a conversation of unique turns, in reply order."""
    below = {}
    for t, p in sorted(rows):
        below.setdefault(p, []).append(t)
    out, todo = [], below.get(None, [])[::-1]
    while todo:
        out.append(todo.pop())
        todo += below.get(out[-1], [])[::-1]
    return out


def test_replies_stand_in_the_order_of_their_trees(spark):
    """Three levels and more, a hub that most rows quote, a long chain, nested quotes, and a turn of several rows."""
    rng, rows, expected = random.Random(5), [], {}
    says = lambda c, t: f"conversation {c} says this in turn {t}."
    for c in range(4):
        parents = {0: None}
        for t in range(1, 40):
            parents[t] = {0: rng.choice([None, *range(t)]), 1: 0 if t % 3 else None, 2: t - 1, 3: None}[c]
        for t, p in parents.items():
            quote = "" if p is None else f"> {says(c, p)}\n" + (f">> {says(c, parents[p])}\n" if parents[p] is not None else "")
            rows.append((c, t, "user", quote + says(c, t)))
        expected[c] = plain_chat(parents.items())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id, r.place))
    for c in range(4):
        mine = [r for r in got if r.conv_id == c]
        assert [r.turn for r in mine] == expected[c] and [r.place for r in mine] == list(range(40)) and all(r.text == says(c, r.turn) and r.n_rows == 40 for r in mine)
    twins = spark.createDataFrame([(1, 0, "a", "first words here"), (1, 0, "b", "first words here"), (1, 1, "a", "else"), (1, 2, "a", "> first words here\nreply")], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.role, r.text) for r in sorted(chat.format_chats(twins).collect(), key=lambda r: r.place)] == [(0, "a", "first words here"), (0, "b", "first words here"), (2, "a", "reply"), (1, "a", "else")]


def test_long_quoted_texts_take_linear_time(spark):
    lines = [f"line {k} of a long message" for k in range(40_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(f"{'>' * (k // 100 % 3 + 1)} {x}" for k, x in enumerate(lines)) + "\nI see.")]
    began = time.monotonic()
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].text == "I see." and got[1].reply_to_turn == 0 and got[1].max_level == 3 and got[1].n_quotes == 400 and time.monotonic() - began < 60


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, node int, k1 int")


def sample(seed, n=400, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[rng.integers(0, 5, n - n // 2)] + rng.normal(size=(n - n // 2, d)) * 0.12
    x[10] = x[11] = x[12]
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


ODD = [(1000, None), (1001, [NAN] * 8), (1002, [0.0] * 8), (1003, [1.0, None]), (1004, [INF] * 8), (1005, [])]


def test_topk_equals_brute_force(spark):
    rows = sample(1)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(vectors(spark, rows + ODD[:5] + [(1000 + 50, None)])).collect()}
    m = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    expected = {}
    for q in range(0, len(rows), 50):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(len(rows)) if i != q)[:5]
        expected |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected
    few = topk.search(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0]), (None, [3.0])])).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 1, 65536)] and topk.search(vectors(spark, ODD[:1])).count() == 0


def test_blocks_are_pruned_only_below_the_kth_score(spark):
    rows = sample(2, 3000)
    found = topk.search(vectors(spark, rows), every=500).collect()
    m = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    for r in found:
        s = m[r.query_id] @ m.T
        assert s[r.vec_id] == r.score and sum(s[i] > r.score for i in range(len(rows)) if i != r.query_id) < r["rank"]


def test_searches_write_no_copy_of_a_query_for_each_shard(spark, monkeypatch):
    for name, value in {"BLOCK": 16, "SHARD": 1, "CHUNK": 2400, "TILE": 70, "HELD": 50}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    x = np.random.default_rng(3).normal(size=(3000, 16))
    x[2500:] = x[7]  # a large group of copies
    m = np.floor(256 * x.astype(np.float32)).astype(int)
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)] + [(9001, [3e17] * 16), (9002, [-3e17] * 16)]
    shared, log = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), {}
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(shared) for f in fs)
    before = size()
    found = topk.search(vectors(spark, rows), every=10, log=log).where("vec_id < 9000 and query_id < 9000").collect()
    written = size() - before
    # One of the two far vectors is each query's best: it is scored in whole numbers.
    for q in range(0, 3000, 10):
        got = [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        s = m @ m[q]
        assert got == sorted((-int(y), i) for i, y in enumerate(s) if i != q)[: len(got)] and len(got) == 4
    assert log["scored"] <= log["visited"] <= log["all"] and written < 1_500_000, written


def test_embedding_links_equal_brute_force(spark):
    rows = sample(3)
    got = {r.vec_id: r for r in emb.near_duplicates(vectors(spark, rows + ODD), chunk=60, sample=50).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(hit, root[None, :], len(x)).min(1))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum(), root[i], root[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in ODD) and hit.sum() > 1000
    assert emb.near_duplicates(vectors(spark, ODD[:2])).count() == 2 and emb.near_duplicates(vectors(spark, [])).count() == 0
