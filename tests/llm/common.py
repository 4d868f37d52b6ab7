"""Small tables for edge cases, shared by the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, word string"


def docs_frame(spark, texts, ids=None):
    """documents with two extra columns whose names operators also use."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), k, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(seed=1):
    """Null, empty, blank, one word, repeats, a very long one, characters beyond the first plane."""
    rng = random.Random(seed)
    vocab = ["the", "of", "Étion", "größe", "x", "word", "😀", "a-b", "1999", "İst"]
    body = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    one = body(60)
    return [None, "", " \t\n", "one", "a b c", one, one, one + " tail", "z" * 5000, "7" * 3000, body(20000), "😀" * 50 + " " + body(30), " lead", body(5), body(4)]


def rows(df):
    return [r.asDict() for r in df.collect()]
