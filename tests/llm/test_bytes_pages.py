"""Substring de-duplication, URL filter and page extraction against plain Python."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import linkgraph, sitetree, suffix
from emberlake.llm.shared import table
from tests.llm.common import docs_frame, odd_texts, rows


# ---- substring de-duplication
def brute_substrings(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def check_substrings(spark, texts, length, hot, ids=None):
    docs = docs_frame(spark, texts, ids)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in rows(suffix.deduplicated(docs, length, hot).withColumn("sha", F.sha2("kept", 256)))]
    want = [(i, *w) for i, w in zip(ids or range(len(texts)), brute_substrings(texts, length), strict=True)]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("hot", [5000, 2])
@pytest.mark.parametrize("length", [12, 60, 400])
def test_substrings_random(spark, length, hot):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    body = lambda n: " ".join(word() for _ in range(n))
    passages = [body(rng.randrange(3, 200)) for _ in range(6)]
    texts = [t if len(t or "") < 6000 else t[:6000] for t in odd_texts()] + ["".join(rng.choice([body(rng.randrange(1, 60)), rng.choice(passages)]) + " " for _ in range(5)) for _ in range(25)]
    texts += ["z" * 450, "zy" * 300, texts[-1], None, "", "é" * 250]
    ids = [None if k == 30 else 7 if k in (8, 9, 31) else k for k in range(len(texts))]
    check_substrings(spark, texts, length, hot, ids)


def test_substrings_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in rows(suffix.op2_suffix(table(spark, sf_dir, "documents")))}
    docs = sorted((r["doc_id"], r["text"]) for r in rows(table(spark, sf_dir, "documents")))
    want = brute_substrings([t for _, t in docs], 400)
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, _ in docs] == want
    assert sum(w[1] for w in want) > 0


def test_substrings_of_long_texts_in_pieces(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("ab ") for _ in range(3000))
    texts = [text, text[1000:1400] + "x", "y" + text[200:2900], "z" * 900, text[2500:]]
    got = {}
    for chunk in (64, 1 << 21):
        spans = suffix.repeated_windows(docs_frame(spark, texts), 60, chunk=chunk)
        got[chunk] = {(r["doc_id"], p) for r in rows(spans) for p in range(r["lo"], r["hi"])}
    assert got[64] == got[1 << 21] and len(got[64]) > 3000


@pytest.mark.parametrize("hot", [5000, 2])
def test_passages(spark, hot):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    shared = [[word() for _ in range(rng.randrange(4, 30))] for _ in range(5)]
    texts = []
    for _ in range(30):
        words = [w for _ in range(4) for w in (rng.choice(shared) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 20))])]
        texts.append("".join(rng.choice([w, w.title()]) + rng.choice([" ", "\n", "  "]) for w in words))
    texts += [None, "", "ab " * 40]
    lists = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 12]) for w in lists for i in range(len(w) - 11))
    want = {(d, i) for d, w in enumerate(lists) for i in range(len(w) - 11) if seen[tuple(w[i : i + 12])] > 1}
    assert {(r["doc_id"], p) for r in rows(suffix.passages(docs_frame(spark, texts), 12, hot)) for p in range(r["lo"], r["hi"])} == want and len(want) > 50
    covered = Counter(d for d, _ in {(d, j) for d, i in want for j in range(i, i + 12)})
    assert {r["doc_id"]: r["n_passage_words"] for r in rows(suffix.deduplicated(docs_frame(spark, texts), hot=hot, words=12))} == {d: covered[d] for d in range(len(texts))}


def test_crowded_buckets_of_both_ways_agree():
    """Numbers of pointers by rank and by hash split the same windows."""
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(4000)).encode(), np.uint8)
    begin, count = np.arange(0, 4000, 100), np.full(40, 90)
    symbols = np.concatenate([data[b : b + 101] for b in begin[:39]] + [data[:101]])
    ranked = suffix.refine(symbols, np.arange(40) * 101, count, 12)
    pairs = [p for k in range(40) for p in zip(*(suffix.numbered(symbols[k * 101 : k * 101 + 101], 12, suffix.BYTES, w).tolist() for w in (0, 1)))]
    times = Counter(pairs)
    assert ranked.tolist() == [times[p] > 1 for p in pairs] and 0 < ranked.sum() < len(ranked)


def test_substrings_empty(spark):
    assert suffix.op2_suffix(docs_frame(spark, [])).count() == 0
    assert rows(suffix.op2_suffix(docs_frame(spark, [None])))[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


# ---- URL filter
PAGES = "page_id long, url string, html string, host string, trust double"


def pages_frame(spark, pairs):
    return spark.createDataFrame([(i, u, h, "clash", 1.0) for i, (u, h) in enumerate(pairs)], PAGES)


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, says in linkgraph.RULES:
        domain, _, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


URLS = [None, "", "x", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.example.org/en/12#x", "https://a.example.org/en/2?q=://b.com/fr/", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/a", "http://xcom/de/a", "ftp://B.É.Com/fr/?a", "http://h.net?x/y", "http://h.net#/org/", "a://b://c/d", "http://org\n.com/fr/"]


def test_url_rules(spark, sf_dir):
    got = {r["page_id"]: r for r in rows(linkgraph.op1_url_filter(pages_frame(spark, [(u, None) for u in URLS])))}
    for i, u in enumerate(URLS):
        host, path, best = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0]), u
        assert got[i]["verdict"] == (best[1] if best else got[i]["verdict"])
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in rows(linkgraph.op1_url_filter(pages))}
    for r in rows(pages):
        host, path, best = brute_url(r["url"])
        assert (got[r["page_id"]]["host"], got[r["page_id"]]["path"], got[r["page_id"]]["rule"]) == (host, path, best and best[0])


def test_link_propagation(spark):
    link = lambda *to: "".join(f'<p><a class=x href="{t}">y</a>' for t in to)
    pages = [
        ("http://good.org/", link("http://Mid.net/a", "/self", "//far.net")), ("http://good.org/b", link("http://mid.net/z")),
        ("http://mid.net/x", link("https://leaf.net/")), ("http://leaf.net/1", ""), ("http://far.net/", None),
        ("http://bad.com/de/", link("http://innocent.net")), ("http://farm.net/", link("http://bad.com/de/", "http://bad.com/de/2")), ("http://feeder.net/", link("http://farm.net/")), ("http://innocent.net/", ""),
    ]
    got = {r["host"]: r for r in rows(linkgraph.op1_url_filter(pages_frame(spark, pages)))}
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"bad.com", "farm.net", "feeder.net"}
    # the same by dense matrices
    hosts = sorted(got)
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b, n in [("good.org", "mid.net", 2), ("good.org", "far.net", 1), ("mid.net", "leaf.net", 1), ("bad.com", "innocent.net", 1), ("farm.net", "bad.com", 2), ("feeder.net", "farm.net", 1)]:
        w[at[a], at[b]] = n
    seed = {"trust": np.eye(len(hosts))[at["good.org"]], "distrust": np.eye(len(hosts))[at["bad.com"]]}
    for kind, m in (("trust", w), ("distrust", w.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        v = seed[kind]
        for _ in range(linkgraph.ROUNDS):
            v = 0.15 * seed[kind] + 0.85 * v @ share
        assert [got[h][kind] for h in hosts] == pytest.approx(v.tolist(), abs=1e-5)
    assert linkgraph.op1_url_filter(pages_frame(spark, pages).limit(0)).count() == 0


def test_long_chains_and_cycles_converge(spark):
    hosts = [f"h{k}.net" for k in range(24)] + ["bad.com"]
    pages = [(f"http://{a}/de/", f'<a href="http://{b}/">x</a>') for a, b in zip(hosts, hosts[1:], strict=False)] + [("http://bad.com/de/", "")]
    got = {r["host"]: r for r in rows(linkgraph.op1_url_filter(pages_frame(spark, pages)))}
    assert got["h0.net"]["verdict"] == "block" and got["h0.net"]["distrust"] == pytest.approx(0.15 * 0.85**24)
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    ranks = {r["host"]: r["value"] for r in rows(linkgraph.propagate(edges, spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, value double")))}
    assert ranks == pytest.approx({"a": 1 / 1.85, "b": 0.85 / 1.85}, abs=1e-5)


# ---- pages
def test_parse_cases():
    text = lambda h: "\n".join(sitetree.kept(sitetree.parse(h)))
    assert text("") == ""
    assert text("plain &amp; simple") == "plain & simple"
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- c --><div class="ad">buy</div><article><h1>H &lt;1&gt;</h1><p><b>One.<br><p>Two\n  three &copy;</p><div class="comments"><p>first!</p></div></article><footer>f</footer></body></html>'
    assert text(page) == "H <1>\nOne.\nTwo three ©"
    assert text("<body><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>1<td>2</table>e") == "a\nb\nc\nd\n1 2\ne"
    assert text("<div id='sidebar-2'><p>no</p></div><div class='story' title='a>b'>yes</div><aside>no</aside><form><p>no</p></form>") == "yes"
    assert text("<main><header><h2>Title</h2><p>by me</p></header><p>x <span hidden>secret</span>y</p></main><p>out</p>") == "Title\nx y"
    assert text("<p>a</b></div>b<script>never") == "ab"
    assert text("<p>x &am; &amp &#65;&#x42; < 5") == "x &am; & AB < 5"
    assert text("<head><title>t</title><p>q") == "q"


@pytest.mark.parametrize("page, want", [
    ('<div class="content has-sidebar"><p>x</p></div>', "x"), ('<div class="long-form story"><p>x</p></div>', "x"), ('<main class="no-sidebar"><p>x</p></main>', "x"), ('<article class="social-science"><p>x</p></article>', "x"),
    ("<form id=page><main><p>x</p></main><p>no</p></form>", "x"), ('<div class="site-footer">no</div><p>x', "x"), ('<div id="comments"><article class="comment"><p>no</p></article></div><p>x', "x"), ('<div class="post-header"><h1>x</h1></div>', "x"),
    ('<div class="cookie-banner">no</div>x', "x"), ('<div class="widget widget-ads">no</div><div role="navigation">no</div>x', "x"), ("<p>a<hr>b<div>c<p>d", "a\nb\nc\nd"), ("a <b <c", "a <b <c"), ("<p title='a>b' class=\"x>y\">z", "z"),
])
def test_names(page, want):
    assert "\n".join(sitetree.kept(sitetree.parse(page))) == want


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a " * 300_000 + ">", "<abc " * 200_000, '<div class="c">' * 100_000 + "x", "<a \"'>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<div>" * 50_000 + "<head><p>" * 50_000, "<!--" * 200_000, "<li><b><dt><td>" * 50_000, "<script>" * 100_000, "<p><b>x" * 100_000, "&amp;" * 200_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    sitetree.kept(sitetree.parse(page))
    assert time.process_time() - began < 20


def test_importance_by_brute_force(spark):
    rng = random.Random(4)
    page = lambda: "<body>" + "".join(f'<div class="{rng.choice("ab")}">{"<p>" + rng.choice(["Same", "Same", "Same", "One", "Two"]) + "</p>" if rng.random() < 0.9 else "own " + rng.choice("xy")}{rng.choice(["", "<i>k</i>", "<br>"])}</div>' for _ in range(rng.randrange(1, 4)))
    pairs = [(f"http://h{k % 3}.com/{k}", page()) for k in range(60)]
    every = sitetree.style_nodes(pages_frame(spark, pairs + pairs[:9]))
    got = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in rows(sitetree.node_importance(every))}
    hosts = {r["url"]: r["host"] for r in rows(pages_frame(spark, pairs).select("url", F.xxhash64(linkgraph.host_of(F.col("url"))).alias("host")))}
    shows, texts, on = {}, {}, {}
    for url, html in {(u.rsplit("/", 1)[0], h): (u, h) for u, h in pairs}.values():  # distinct pages of each host
        own = {}
        for b in sitetree.parse(html):
            own.setdefault(b.node, []).append(b)
        for node, blocks in own.items():
            key = hosts[url], node
            shows.setdefault(key, []).append(tuple(b.shape for b in blocks))
            texts.setdefault(key, []).append(tuple(b.text for b in blocks))
            for leaf in {sitetree.own_node(b) for b in blocks}:
                on.setdefault((key[0], leaf), []).append(key)

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(c / m * np.log(c / m) / np.log(m) for c in Counter(values).values())

    want = {k: (len(v), 0.9 * entropy(texts[k]) + 0.1 * entropy(shows[k])) for k, v in shows.items()}
    for leaf, keys in on.items():
        if len(keys) > 1:
            m, k = len(shows[keys[0]]), len(keys)
            want[leaf] = (k, entropy(["it"] * k + list(range(m - k))))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 20
    assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()], abs=1e-9)


def test_branches_go_whole(spark):
    page = lambda i: f'<body><div class="box">Head<div class="in"><p>Sub</p><ul><li>a<li>b</ul></div></div><div class="text">Intro<p>Body {i}</p></div></body>'
    got = rows(sitetree.op7_html(pages_frame(spark, [(f"http://h.com/{i}", page(i)) for i in range(9)])))
    assert sorted(r["text"] for r in got) == [f"Body {i}" for i in range(9)]


def test_site_tree_removes_repeated_branches(spark):
    page = lambda i: f'<body><div class="top"><p>Welcome to our site</p></div><div class="x{i}"><p>Body {i} alpha</p><p>tail {i * 7}</p></div><div class="legal">All rights reserved</div></body>'
    pairs = [(f"http://h.com/{i}", page(i)) for i in range(12)] + [("http://one.com/", page(1)), ("http://h.com/0", page(0)), (None, None), ("http://e.com", "")]
    got = {r["page_id"]: r for r in rows(sitetree.op7_html(pages_frame(spark, pairs)))}
    assert len(got) == len(pairs)
    for i in range(12):
        assert got[i]["text"] == f"Body {i} alpha\ntail {i * 7}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[12]["text"] == "Welcome to our site\nBody 1 alpha\ntail 7\nAll rights reserved"  # one page shows no pattern
    assert (got[14]["text"], got[15]["text"], got[14]["n_chars"]) == ("", "", 0)


def test_site_tree_judges_texts_of_a_marked_article(spark):
    page = lambda i: f"<body><article><h1>Head {i}</h1>" + "".join(f"<p>Body {i} {k}</p>" for k in range(i % 4)) + f"<p>Sign up today</p><p>Body {i} end</p><ul><li>Point {i}</li><li>Buy now</li></ul></article></body>"
    pairs = [(f"http://h.com/{i}", page(i)) for i in range(12)] + [("http://one.com/", page(2)), ("http://h.com/only", "<article><p>Buy now</article>")]
    got = {r["page_id"]: r["text"].split("\n") for r in rows(sitetree.op7_html(pages_frame(spark, pairs)))}
    for i in range(12):
        assert got[i] == [f"Head {i}", *(f"Body {i} {k}" for k in range(i % 4)), f"Body {i} end", f"Point {i}"]
    assert got[12] == ["Head 2", "Body 2 0", "Body 2 1", "Sign up today", "Body 2 end", "Point 2", "Buy now"] and got[13] == ["Buy now"]


def test_site_tree_cleans_every_section_of_a_host(spark):
    letter = "abcdefghijklmnopqrst"
    page = lambda s, i: f'<body><div class="all"><p>Body {s} {i}</p></div><div class="x{letter[s]}">Legal text {letter[s]}</div></body>'
    pairs = [(f"http://h.com/{s}/{i}", page(s, i)) for s in range(20) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in rows(sitetree.op7_html(pages_frame(spark, pairs)))}
    assert [got[k] for k in range(120)] == [f"Body {s} {i}" for s in range(20) for i in range(6)]


def test_pages_of_test_data(spark, sf_dir):
    import re
    from html import unescape

    got = {r["page_id"]: r for r in rows(sitetree.op7_html(table(spark, sf_dir, "pages")))}
    for r in rows(table(spark, sf_dir, "pages")):
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        want = [" ".join(unescape(re.sub(r"<[a-z/][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in want if b)
    assert sitetree.op7_html(table(spark, sf_dir, "pages").limit(0)).count() == 0
