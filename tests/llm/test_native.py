"""The native operators against plain Python."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from emberlake.llm import chat, fingerprint, mixing, pii
from emberlake.llm.shared import table
from tests.llm.common import docs_frame, odd_texts, rows

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- personal data
def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    text = text or ""
    out = []
    for kind, pat, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out.append([(kind, m.start(), m.end()) for m in re.finditer(pat, text) if ok(m.group())])
    return out


IBANS = {"DE": 22, "GB": 22, "AT": 20, "FR": 27, "NO": 15}


def brute_added(text):
    """The spans that the method adds: a check, and words within 40 characters, up to the next proposal."""
    text, out = text or "", []
    iban = lambda m: len(c := m.replace(" ", "")) == IBANS[c[:2]] and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1
    for kind, pat, ok, least, words, off in (
        ("iban", "|".join(rf"(?<![A-Za-z0-9]){k}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for k, n in IBANS.items()), iban, False, "iban|account|bank|konto|compte", "example|sample"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: True, True, "ssn|social security", "order|invoice|part no"),
        ("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}", lambda m: re.search("[0-9]", m) and re.search("[A-Za-z]", m), True, "token|secret|passw|api.?key|access.?key|private.?key|auth|bearer|credential", "sha256|checksum|commit|digest"),
    ):
        found = list(re.finditer(pat, text))
        for k, m in enumerate(found):
            before = text[max(found[k - 1].end() if k else 0, m.start() - 40) : m.start()]
            after = text[m.end() : min(found[k + 1].start() if k + 1 < len(found) else len(text), m.end() + 40)]
            around = f"{before} {after}".lower()
            good, bad = re.search(words, around), re.search(off, around)
            if ok(m.group()) and (good and not bad if least else good or not bad):
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    "mail a.b+c@d-e.co.uk, x@y.z@w.v a@b.c_x@d.com @ a@b 😀 q@r.st.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9x 0000300.1.1.1 1.2.3.4",
    "4785380592391139 4785-3805 9239-1139 4111 1111 1111 1111 4111111111111112 0000000000000 12345",
    "+1 (415) 555-0199 +4930123456, +12, +1-2, ++33 1 23 45 67 89 00 +123456789012345678",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE88370400440532013000. ssn 123-45-6789; 123-45-6789",
    "AT61 1904 3002 3457 3201 BIC BKAUATWW, AT61 1904 3002 3457 3202, a sample: FR1420041010050500013M02606; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
    "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 " + "x " * 60 + "api-key: abcdefghijklmnopqrst, api_key=abcdefghij0123456789== 078-05-1120",
    "+1 4111 1111 1111 1111 and 4111 1111 1111 1111@x.com 10.0.0.1@h.org",
]


def test_pii(spark, sf_dir):
    texts = PII + odd_texts()
    got = {r["doc_id"]: r for r in rows(pii.op4_pii(docs_frame(spark, texts)))}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [len(w) for w in want], t
        text = ",".join(f"{k}:{s}:{e}" for w in want for k, s, e in w)
        assert got[i]["base_sha256"] == sha(text), (t, text, got[i]["spans"])
        added = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_added(t))
        assert got[i]["spans"] == ",".join(x for x in (text, added) if x), t
        assert got[i]["n_spans"] == len([x for x in got[i]["spans"].split(",") if x]) == len([x for x in got[i]["scores"].split(",") if x])
    assert got[4]["spans"].count("iban:") == 2 and got[4]["spans"].count("ssn:") == 1  # context ends at the match before
    assert "secret" in got[5]["spans"] and "iban" in got[5]["spans"]
    docs = table(spark, sf_dir, "documents")
    want = {r["doc_id"]: ",".join(f"{k}:{s}:{e}" for w in brute_pii(r["text"]) for k, s, e in w) for r in rows(docs)}
    for r in rows(pii.op4_pii(docs)):
        assert r["base_sha256"] == sha(want[r["doc_id"]])
    assert any(want.values())


def test_pii_context_moves_scores(spark):
    texts = ["call +1 415 555 0199 now", "invoice +1 415 555 0199 now", "+1 415 555 0199"]
    got = [r["spans"][0]["score"] for r in sorted(rows(pii.find_pii(docs_frame(spark, texts))), key=lambda r: r["doc_id"])]
    assert got == pytest.approx([0.9, 0.3, 0.5])
    assert [len(r["spans"]) for r in sorted(rows(pii.find_pii(docs_frame(spark, texts), 0.4)), key=lambda r: r["doc_id"])] == [1, 0, 1]


def test_pii_many_matches(spark):
    n = 100_000
    docs = docs_frame(spark, ["a@b.co x " * n])
    r = rows(pii.op4_pii(docs))[0]
    assert r["n_email"] == n and r["spans"].endswith(f"email:{9 * n - 9}:{9 * n - 3}")
    assert rows(pii.mask_pii(docs))[0]["text"] == "[EMAIL] x " * n


def test_pii_long_runs(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1." * 50_000, "a@" * 50_000, "+1" * 50_000, "a.b@c." * 20_000]
    assert pii.op4_pii(docs_frame(spark, texts)).count() == 6


def test_mask(spark):
    docs = docs_frame(spark, ["call +1 415 555 0199 or a@b.co!", None, "", "clean", "😀 1.2.3.4 😀"])
    out = pii.mask_pii(docs)
    assert out.columns == docs.columns
    assert [(r["text"], r["n_chars"]) for r in sorted(rows(out), key=lambda r: r["doc_id"])] == [("call [PHONE] or [EMAIL]!", 24), (None, 0), ("", 0), ("clean", 5), ("😀 [IP] 😀", 8)]
    assert all("@" not in (r["text"] or "") for r in rows(pii.mask_pii(docs_frame(spark, PII[7:]))))
    clash = docs.withColumns({c: F.lit("own") for c in ("_pii_text", "_own_text", "_own_email", "spans", "_OWN_NEW")})
    out = pii.mask_pii(clash)
    assert out.columns == clash.columns and all(r[c] == "own" for r in rows(out) for c in ("_pii_text", "_own_text", "_own_email", "spans", "_OWN_NEW"))


# ---- mixing
def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_mixing_matches_sql(spark, sf_dir):
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows(mixing.op6_mixing(table(spark, sf_dir, "documents"))))
    assert got == sorted(duck(sf_dir, mixing.OP6_SQL))


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), (None, 500), ("a", 500)], "source string, size long")
    got = {r["source"]: r for r in rows(mixing.source_targets(sizes))}
    want, left, free = {}, 2010.0, {"a": (1500, 1), "b": (10, 2), "c": (0, 3), None: (500, 1)}
    while free:  # share, cap, share again
        level = left / sum(w for _, w in free.values())
        over = [k for k, (s, w) in free.items() if level * w > 3 * s]
        if not over:
            want |= {k: level * w for k, (s, w) in free.items()}
            break
        for k in over:
            want[k] = 3.0 * free.pop(k)[0]
            left -= want[k]
    assert {k: r["target"] for k, r in got.items()} == pytest.approx(want)


def test_mixing_edges(spark):
    docs = docs_frame(spark, odd_texts(), [None, 1, 2, 3, 3, 3, *range(6, 15)])
    plan = rows(mixing.plan_mix(docs))
    assert len(plan) == 15 and all(0 <= r["copies"] <= 3 for r in plan)
    assert {(r["doc_id"], r["size"], r["copies"]) for r in plan} == {(r["doc_id"], r["size"], r["copies"]) for r in rows(mixing.plan_mix(docs))}
    anonymous = docs_frame(spark, [f"w{k} x" for k in range(3000)], [None] * 3000)
    taken = {}
    for r in rows(mixing.plan_mix(anonymous)):
        taken.setdefault(r["source"], []).append((r["copies"] * r["size"], r["target"]))
    assert all(abs(sum(a for a, _ in x) / x[0][1] - 1) < 0.15 for x in taken.values())
    clash = docs.withColumns({c: F.lit("own") for c in ("_mix_rate", "_own_rate", "_own_source", "rate", "copies")})
    assert mixing.mix(clash).columns == clash.columns and {r["_own_rate"] for r in rows(mixing.mix(clash))} == {"own"}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.op6_mixing(docs.limit(0)).count() == 0
    assert rows(mixing.op6_mixing(docs_frame(spark, [None, ""])))[0]["taken"] == 0


# ---- fingerprints
def test_edited_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    order = sorted((r["doc_id"], r["text"] or "") for r in rows(docs))
    want = {}
    for k, (i, t) in enumerate(order):
        n, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
        want[i] = (len(t), sha(t[: len(t) - n] + nxt[:n]))
    got = rows(fingerprint.op8_fingerprint(docs))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want


def test_sketch_estimates(spark):
    texts = odd_texts()
    docs = docs_frame(spark, texts, [None, 4, 4, 4, *range(5, 16)])
    got = rows(fingerprint.op8_fingerprint(docs))
    lone = [r["near_next"] for r in rows(fingerprint.op8_fingerprint(docs_frame(spark, ["a b c d e f g"] * 3 + ["x y z x y z x"], [None, None, None, 5])))]
    assert sorted(lone) == [0.0, 0.0, 1.0, 1.0]  # equal rows follow each other
    assert len(got) == len(texts) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["fingerprint"] == by_id[7]["fingerprint"] != "" and by_id[6]["near_next"] == 1.0
    assert by_id[None]["fingerprint"] == "" and fingerprint.op8_fingerprint(docs.limit(0)).count() == 0
    assert rows(fingerprint.op8_fingerprint(docs_frame(spark, ["only one text here now"])))[0]["near_next"] == 1.0


def test_sketches_by_brute_force(spark, sf_dir):
    """fingerprint, near_edited and near_next from all shingles, with Spark's own hash of each."""
    order = sorted((r["doc_id"], r["text"] or "") for r in rows(table(spark, sf_dir, "documents")))
    texts = {i: t for i, t in order}
    edited = {i: t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4] for k, (i, t) in enumerate(order)}
    runs = lambda t: [w[j : j + 5] for j in range(len(w) - 4)] if len(w := re.findall(r"[^\x20\x09-\x0D]+", t)) >= 5 else [[" ".join(w)]] if w else []
    all_runs = sorted({tuple(r) for t in [*texts.values(), *edited.values()] for r in runs(t)})
    frame = spark.createDataFrame([(list(r),) for r in all_runs], "w array<string>").select("w", F.when(F.size("w") == 5, F.xxhash64(*(F.col("w")[j] for j in range(5)))).otherwise(F.xxhash64(F.col("w")[0], F.lit(0))).alias("h"))
    value = {tuple(r["w"]): r["h"] for r in frame.collect()}
    smallest = lambda t: sorted({value[tuple(r)] for r in runs(t)})[:128]
    text = lambda s: "".join(f"{h % 2**64:016x}" for h in s)

    def near(a, b):
        union = sorted(set(a) | set(b))[:128]
        return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)

    got = {r["doc_id"]: r for r in rows(fingerprint.op8_fingerprint(table(spark, sf_dir, "documents")))}
    for k, (i, t) in enumerate(order):
        mine, other, after = smallest(t), smallest(edited[i]), smallest(order[(k + 1) % len(order)][1])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (text(mine), text(other))
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((near(mine, other), near(mine, after)))


def test_rows_without_ids_are_spread(spark):
    texts = [f"w{k} x y z a b c" for k in range(5000)]
    docs = docs_frame(spark, [*texts, *["same text"] * 5000], [None] * 10000)
    got = rows(fingerprint.op8_fingerprint(docs))
    assert len(got) == 10000 and sum(r["near_next"] == 1.0 for r in got) >= 4999


def test_sketch_algebra(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000, 5000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"), fingerprint.sketch(F.concat_ws(" ", "a", "b")).alias("ab"))
    row = df.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_count(F.col("a")).alias("n"), fingerprint.merge(F.col("a"), F.col("b")).alias("m"), "ab").first()
    assert abs(row["j"] - 0.6) < 0.15 and abs(row["c"] - 0.75) < 0.2 and abs(row["n"] / 3996 - 1) < 0.3
    assert len(set(row["m"]) ^ set(row["ab"])) <= 6  # the joint adds four shingles


# ---- conversations
def test_chat_round_trip(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    extra = [(900001, 0, None, None), (900001, 1, "tool", "[/ROLE] ] \\ [x]"), (900002, 0, "assistant", "</s>"), (900002, 0, "assistant", "</s>"), (None, 3, "user", "<s>"), (900003, None, "a]b[\\", "\\"), (900004, 0, "assistant", ""), (900004, 1, "assistant", "x\ny")]
    conv = conv.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    turns = {}
    for r in rows(conv):
        turns.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), (r["role"] is not None, r["role"] or ""), (r["text"] is not None, r["text"] or "")))
    turns[-1] = [((True, 0), (True, "user"), (True, chat.PROBE)), ((True, 1), (True, "assistant"), (True, chat.PROBE))]
    got = rows(chat.op10_chat(conv))
    assert len(got) == len(turns)
    for r in got:
        seq = [(a[1], b[1]) for _, a, b in sorted(turns[r["conv_id"]])]
        loss = "".join(t for role, t in seq if role == "assistant")
        assert r["n_turns"] == len(seq)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in seq))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.op10_chat(conv.limit(0)).count() == 1


def test_chat_targets():
    out = list(chat.expand([("user", "a"), ("assistant", "b<"), ("user", "c"), ("assistant", "d"), ("user", "e")]))
    assert [text[s:e] if s is not None else None for text, s, e in out] == ["b\\<", "d", None]
    assert [len(chat.parse(t)) for t, _, _ in out] == [2, 4, 5]
    assert chat.parse(out[2][0])[1] == ("assistant", "b<")
