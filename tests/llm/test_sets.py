"""Near duplicates, decontamination and quality against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlake.llm import components as cc
from emberlake.llm import decontaminate, kernels, neardup, quality, shared
from emberlake.llm.shared import table
from tests.llm.common import docs_frame, odd_texts, rows

lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)


# ---- kernels
def test_kernels_match_plain_python():
    texts = [t or "" for t in odd_texts()] + ["A b C d E", "a b c d e", "a b c", "x"]
    for blocks in (1 << 20, 50):
        names, sets = {}, {}
        data, offs = kernels.utf8(pa.array(texts))
        k = 0
        for lo, hi, d, o in kernels.blocks(data, offs, blocks):
            word, _, at = kernels.words(d, o, kernels.WORD_NOT_SPACE)
            sh, so = kernels.shingles(word, at, 4)
            for i in range(hi - lo):
                want = re.findall(r"[^\x20\x09-\x0D]+", lower(texts[k]))
                mine = word[at[i] : at[i + 1]].tolist()
                assert len(mine) == len(want)
                for h, w in zip(mine, want, strict=True):
                    assert names.setdefault(h, w) == w
                runs = [tuple(want[j : j + 4]) for j in range(len(want) - 3)] or ([tuple(want)] if want else [])
                got = sh[so[i] : so[i + 1]].tolist()
                assert len(got) == len(runs)
                for h, r in zip(got, runs, strict=True):
                    assert sets.setdefault(h, r) == r
                k += 1
        assert len(set(names.values())) == len(names) and len(set(sets.values())) == len(sets)


# ---- near duplicates
def brute_components(pairs_of_id_text, n=4, percent=85):
    sets = []
    for _, t in pairs_of_id_text:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs_of_id_text):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is not None, d or 0), len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(pairs_of_id_text))


def check_components(spark, pairs):
    docs = docs_frame(spark, [t for _, t in pairs], [i for i, _ in pairs])
    got = rows(neardup.op9_near_duplicates(docs))
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in got) == brute_components(pairs)


def near_group(rng, size, words=80, edits=7):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_random(spark):
    rng = random.Random(5)
    texts = odd_texts() + [t for _ in range(4) for t in near_group(rng, 40)] + near_group(rng, 30, 12, 2) + near_group(rng, 25, 20, 3)
    ids = [None if k == 20 else k // 2 if k < 8 else k for k in range(len(texts))]
    check_components(spark, list(zip(ids, texts, strict=True)))


def test_near_duplicates_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in rows(docs)]
    got = rows(neardup.op9_near_duplicates(docs))
    want = brute_components(pairs)
    assert sorted(((True, r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == want
    assert any(c != d for (_, d), _, c in want)


def test_near_duplicates_edges(spark):
    assert neardup.op9_near_duplicates(docs_frame(spark, [])).count() == 0
    check_components(spark, [(3, None), (2, ""), (1, " ")])
    docs = docs_frame(spark, ["a b c d e", "A B C d e", "", "", None, "q"], [5, 4, 1, 2, 3, 4])
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"  # the session is as before
    assert sorted(r["doc_id"] for r in rows(kept)) == [1, 2, 3, 4, 4]  # two rows share doc_id 4, but no component


def test_drop_keeps_one_row_of_each_component(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    texts = [f"t{k} u{k} v{k} w{k} x{k} y{k}" for k in range(12)] + [near, near + " 1", "only one", "ONLY one", "q", "q", "", "", near]
    ids = [None] * 12 + [50, 51, 51, 52, 60, 60, None, None, None]
    kept = rows(neardup.drop_near_duplicates(docs_frame(spark, texts, ids)))
    want = [(None, t) for t in texts[:12]] + [(50, near), (51, "only one"), (60, "q"), (None, ""), (None, "")]
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept)) == sorted((i or 0, t) for i, t in want)
    twins = [near + f" {k}" for k in range(30)]  # near copies without any doc_id
    assert len(rows(neardup.drop_near_duplicates(docs_frame(spark, [*twins, *texts[:12]], [None] * 42)))) == 13


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 250), (250, 400)]
    got = {(r["u"], r["v"]) for r in rows(cc.components(spark.createDataFrame(links, "u long, v long")))}
    assert got == {(i, 0) for i in range(1, 61)} | {(200, 100), (300, 250), (400, 250)}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- decontamination
def brute_hits(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    where = {}
    for item, t in items:
        w = words(t)
        if item is not None:
            for i in range(max(1, len(w) - width + 1) if w else 0):
                where.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    lengths = {len(k) for k in where}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in where:
                    hit |= set(range(i, i + n))
                    found |= where[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


FIELDS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute_hits([(r["doc_id"], r["text"]) for r in rows(docs)], [(r["item_id"], r["text"]) for r in rows(items)])
    assert sorted(tuple(r[f] for f in FIELDS) for r in rows(decontaminate.op5_decontaminate(docs, items))) == sorted(want)
    assert any(x[-1] for x in want)
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in rows(clean)} == {x[0] for x in want if not x[-1]}


def test_decontamination_edges(spark):
    items = [(1, "the of x"), (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "the"), (3, None), (None, "word"), (4, "..."), (10, "the of x"), (5, "a a a a a a a a a a a")]
    texts = odd_texts() + ["One, two-three four five six seven eight nine ten eleven TWELVE. the of", "a " * 40, "the", "of the of x the", "the of x", "the of x", None]
    ids = [*range(len(texts) - 4), None, 77, 77, None]
    want = brute_hits(list(zip(ids, texts, strict=True)), items)
    found = decontaminate.phrase_matches(docs_frame(spark, texts, ids), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["n_words"], len(r["hits"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["hits"])) for r in rows(found)]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_decontamination_of_repeated_rows_without_ids(spark):
    texts = ["the of x"] * 3000 + [f"word {k % 50}" for k in range(3000)]
    items = spark.createDataFrame([(1, "the of x")], "item_id long, text string")
    got = rows(decontaminate.op5_decontaminate(docs_frame(spark, texts, [None] * 6000), items))
    assert sorted(r["n_hit"] for r in got) == [0] * 3000 + [3] * 3000
    assert decontaminate.drop_contaminated(docs_frame(spark, texts, [None] * 6000), items).count() == 3000


def shuffled_bytes(spark):
    """Written by all shuffles of the session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_decontamination_leaves_clean_texts_where_they_are(spark, monkeypatch):
    rng = random.Random(4)
    leak = " ".join(f"leak{k}" for k in range(12))
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(400)) + (f" {leak}" if k % 100 == 0 else "") for k in range(600)]
    docs = docs_frame(spark, texts).localCheckpoint()
    items = spark.createDataFrame([(1, leak)], "item_id long, text string").localCheckpoint()
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as if more documents were contaminated than Spark broadcasts
    try:
        start = shuffled_bytes(spark)
        kept = rows(decontaminate.drop_contaminated(docs, items))
        moved = shuffled_bytes(spark) - start
        monkeypatch.setattr(shared, "MARK_BITS", 64)  # full: every row is compared
        same = rows(decontaminate.drop_contaminated(docs, items))
    finally:
        spark.conf.set(name, before)
    want = [(k, t) for k, t in enumerate(texts) if k % 100]
    assert sorted((r["doc_id"], r["text"]) for r in kept) == want == sorted((r["doc_id"], r["text"]) for r in same)
    assert moved < 0.1 * sum(map(len, texts))


def test_decontamination_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in rows(decontaminate.op5_decontaminate(docs_frame(spark, ["a b", None]), items))] == [0, 0]
    assert decontaminate.op5_decontaminate(docs_frame(spark, []), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_frame(spark, ["alpha beta x gamma delta", "alpha beta gamma delta", "delta gamma beta alpha", "alpha beta x y z gamma delta"])
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in rows(decontaminate.phrase_matches(docs, items))}
    assert got == {0: ([], ["1"]), 1: (["1"], ["1"]), 2: ([], []), 3: ([], [])}


# ---- quality
def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in rows(quality.op3_quality(docs, labels))}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    unseen = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in rows(labels) if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in unseen]) >= 0.95 and len(unseen) > 50


def test_quality_by_brute_force(spark, sf_dir):
    """The sparse fit against a dense one, and the votes against plain loops over all cosines."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = {}
    for r in rows(labels.where("quality is not null")):
        marks.setdefault(r["doc_id"], []).append(r["quality"])
    learnt = sorted(i for i in marks if zlib.crc32(str(i).encode()) % 4 != 2)
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    parts = list(quality.features(pa.array([texts[i] for i in learnt], pa.string())))
    terms, extra = np.concatenate([t for t, _ in parts]), np.concatenate([x for _, x in parts])
    label = np.array([float(np.mean(marks[i]) >= 0.5) for i in learnt])
    idf = (np.log((1 + len(learnt)) / (1 + (terms > 0).sum(axis=0))) + 1).astype(np.float32)
    dense = quality._weighted(terms, extra, idf).astype(np.float64)
    start = np.random.default_rng(7)
    used = np.concatenate([terms.any(axis=0), extra.any(axis=0)])
    q = np.linalg.qr(start.standard_normal((used.sum(), min(quality.DIMENSIONS, used.sum(), len(learnt)))))[0]
    for _ in range(8):
        q = np.linalg.qr(dense[:, used].T @ (dense[:, used] @ q))[0]
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    sample = unit(dense[:, used] @ q)
    model = quality.fit(docs, labels)
    assert np.allclose(model.vectors @ model.vectors.T, sample @ sample.T, atol=1e-2) and model.labels.tolist() == label.tolist()
    got = {r["doc_id"]: r["score"] for r in rows(quality.score(docs, model))}
    for t, x, i in zip(*map(np.concatenate, zip(*quality.features(pa.array(list(texts.values()), pa.string())), strict=True)), texts, strict=True):
        mine = model.latent(t[None], x[None])[0]
        near = sorted(((float(mine @ v), y, c) for v, y, c in zip(model.vectors, model.labels, model.counts, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(cos, 1e-6) * c, y) for cos, y, c in near]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if t.sum() else 0.0
        assert got[i] == pytest.approx(want, abs=0.02), i


def test_quality_edges(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    train = table(spark, sf_dir, "documents")
    model = quality.fit(train, labels)
    docs = docs_frame(spark, odd_texts(), [None, None, *range(2, 15)])
    got = rows(quality.score(docs, model))
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in got][:2] == [0.0, 0.0]
    none = quality.fit(train, labels.limit(0))
    assert {r["score"] for r in rows(quality.score(docs, none))} == {0.0, 0.5}
    assert quality.op3_quality(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels.withColumn("extra", F.lit(1)))
    assert kept.columns == docs.columns and kept.count() <= 15


def test_quality_scores_do_not_move_with_the_sample(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB01 .,!-") for _ in range(60)) for _ in range(1500)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.85)) for i in range(1500)], "doc_id long, quality int")  # the label does not depend on the text
    mean = lambda sample: np.mean([r["score"] for r in rows(quality.score(docs, quality.fit(docs, labels, sample)))])
    whole, cut = mean(2048), mean(150)
    assert abs(whole - 0.85) < 0.08 and abs(cut - whole) < 0.08


@pytest.mark.parametrize("good, bad", [("able also back been call came", "jail kill lose mess nope ouch"), ("дом лес мир сад сон мёд", "ад яд зло суд бой вор"), ("你好世界山水花鸟风月", "坏假骗毒死鬼恶贼脏臭")])
def test_quality_reads_words(spark, good, bad):
    rng = random.Random(9)
    parts = [x.split() if " " in x else list(x) for x in (bad, good)]
    blank = " " if " " in good else ""
    wanted = [k % 2 for k in range(400)]
    docs = docs_frame(spark, [blank.join(rng.choice(parts[y]) for _ in range(40)) for y in wanted])
    got = {r["doc_id"]: r for r in rows(quality.op3_quality(docs, spark.createDataFrame(list(enumerate(wanted)), "doc_id long, quality int")))}
    assert np.mean([got[i]["predicted"] == y for i, y in enumerate(wanted) if got[i]["held_out"]]) >= 0.95
