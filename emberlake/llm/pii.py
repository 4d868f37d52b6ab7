r"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Native DataFrame operations only; no shuffle. A pattern's matches and the pieces
between them give the positions: the running sum of their lengths, in code points.
Running sums go over chunks of about the square root of their number, as appending
copies an array; work is nearly in proportion to text and matches.

Base kinds, always found when they pass their check: email, ip (parts at most 255),
card (13 to 19 digits, Luhn), phone (9 to 15 digits). Added kinds, found when their
score reaches ``MIN_SCORE``: iban (its country's length, mod 97), ssn and secret (a long
token of letters and digits); the last two need a word nearby that speaks for them.
Words that speak against a span (as in "order no. 4111...") lower its score, base kinds
included; ``min_score`` lets callers of ``find_pii`` and ``mask_pii`` drop those too.

The patterns are written so that a long run of digits or letters is scanned once:
a match may only begin where a run begins, or where the match before it ended
(``\G``), and runs are possessive. That changes no match.

Defined results: a null or empty text has no spans; other columns are ignored by
``find_pii`` and kept by ``mask_pii``, whatever their names; repeated rows give
repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.shared import let, own_names

#: An added kind is reported from this score on.
MIN_SCORE = 0.6
#: Code points looked at before and after a span for context words, up to the next match of the kind.
CONTEXT = 40
#: What words for and against a span add and take.
FOR, AGAINST = 0.4, 0.2
#: Code points of the pieces that a text is cut into to be masked.
PIECE = 1024

# Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?=[A-Za-z0-9_+/-]{16})(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]++={0,2}+"

#: kind: (pattern, a literal that any match contains or None, base kind, score before context, words for it, words against it)
KINDS = {
    "email": (EMAIL, "@", True, 0.5, "mail|contact|write|@", "example|sample"),
    "ip": (IP, ".", True, 0.5, "ip|address|host|server", "version|section|release"),
    "card": (CARD, None, True, 0.5, "card|visa|master|amex|credit|payment", "order|invoice|serial|isbn|tracking"),
    "phone": (PHONE, "+", True, 0.5, "phone|tel|call|mobile|fax", "order|invoice|serial"),
    "iban": (IBAN, None, False, 0.7, "iban|account|bank|konto|compte", "example|sample"),
    "ssn": (SSN, "-", False, 0.3, "ssn|social security", "order|invoice|part no"),
    "secret": (SECRET, None, False, 0.3, "token|secret|passw|api.?key|access.?key|private.?key|auth|bearer|credential", "sha256|checksum|commit|digest"),
}

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,value:string>"


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN by 97, letters counting 10 to 35."""
    turned = let(F.translate(value, " ", ""), lambda v: F.split(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4)), ""))
    step = lambda acc, ch: F.when(ch == "", acc).when(ch.between("0", "9"), (acc * 10 + (F.ascii(ch) - 48)) % 97).otherwise((acc * 100 + (F.ascii(ch) - 55)) % 97)
    return F.aggregate(turned, F.lit(0), lambda acc, ch: step(acc, ch).cast("int"))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return F.length(F.translate(value, " ", "")).between(15, 34) & (_mod97(value) == 1)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _proposals(text: Column, kind: str) -> tuple[Column, Column]:
    """Matches of the kind's pattern, and the pieces around them."""
    pattern, needs = KINDS[kind][:2]
    nothing = F.array().cast("array<string>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(needs), hits).otherwise(nothing) if needs else hits, F.split(text, pattern, -1)


def running(values: str, join: str = "{} + {}") -> str:
    """SQL for what the elements of a long array come to, by ``join``, up to each of them, in two levels; starts at 0."""
    both = join.format("s.at", "v")
    each = "aggregate({}, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), (s, v) -> named_struct('at', " + both + ", 'out', concat(s.out, array(" + both + "))), s -> s.out)"
    parts = f"transform(sequence(0, n - 1), c -> {each.format('slice(x, c * n + 1, n)')})"
    ends = each.format("transform(parts, p -> coalesce(try_element_at(p, -1), 0L))")
    added = f"flatten(transform(parts, (p, c) -> {_let('coalesce(get(ends, c - 1), 0L)', 'base', f'transform(p, v -> {join.format("base", "v")})')}))"
    return _let(values, "x", _let("greatest(1, cast(ceil(sqrt(size(x))) AS int))", "n", _let(parts, "parts", _let(ends, "ends", added))))


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _spans(kind: str, hits: str, pieces: str, min_score: float | None) -> Column:
    """Confirmed spans in order of their start, from the columns of a pattern's matches and of the pieces around them."""
    _, _, base, score, near, off = KINDS[kind]
    size = lambda x: F.length(x).cast("long")

    ends = F.expr(running(f"transform({hits}, (v, i) -> cast(length(get({pieces}, i)) + length(v) AS bigint))"))
    around = lambda i: F.concat(F.right(F.get(F.col(pieces), i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(F.col(pieces), i + 1), F.lit(CONTEXT)))
    found = let(ends, lambda e: F.filter(F.transform(F.col(hits), lambda v, i: F.struct(F.get(e, i).alias("end"), v.alias("value"), around(i).alias("around"))), lambda x: _confirmed(kind, x["value"])))
    rated = F.transform(found, lambda x: let(F.lower(x["around"]), lambda words: F.struct(
        F.lit(kind).alias("kind"), (x["end"] - size(x["value"])).alias("start"), x["end"].alias("end"),
        F.least(F.lit(1.0), F.lit(score) + F.when(words.rlike(near), FOR).otherwise(0.0) - F.when(words.rlike(off), AGAINST).otherwise(0.0)).alias("score"), x["value"].alias("value"))))
    least = min_score if min_score is not None else None if base else MIN_SCORE
    kept = rated if least is None else F.filter(rated, lambda x: x["score"] >= least)
    return F.when(F.size(hits) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _with_spans(docs: DataFrame, names: dict[str, str], min_score: float | None) -> DataFrame:
    """``docs`` and the text (null as empty), and one array column for each kind."""
    text = F.col(names["text"])
    out = docs.withColumn(names["text"], F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumns({names[f"hits_{k}"]: _proposals(text, k)[0] for k in KINDS})
    out = out.withColumns({names[f"pieces_{k}"]: F.when(F.size(names[f"hits_{k}"]) > 0, _proposals(text, k)[1]) for k in KINDS})
    return out.withColumns({names[k]: _spans(k, names[f"hits_{k}"], names[f"pieces_{k}"], min_score) for k in KINDS})


def _names(docs: DataFrame) -> dict[str, str]:
    return own_names(docs, "text", "all", "new", *KINDS, *(f"{what}_{k}" for k in KINDS for what in ("hits", "pieces")), "reach")


def find_pii(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """doc_id, a column of spans for each kind, and spans: array of (kind, start, end, score, value), by kind, then start; code points, end exclusive."""
    rows = docs.select("doc_id", "text")
    names = _names(rows)
    return _with_spans(rows, names, min_score).select("doc_id", *(F.col(names[k]).alias(k) for k in KINDS), F.concat(*(F.col(names[k]) for k in KINDS)).alias("spans"))


def mask_pii(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; n_chars, where there, is that of the new text.

    Overlapping spans are merged and take the name of the one that starts first.
    """
    names = _names(docs)
    found = _with_spans(docs, names, min_score)
    found = found.withColumn(names["all"], F.sort_array(F.transform(F.concat(*(F.col(names[k]) for k in KINDS)), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind")))))

    def part(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b of a text in pieces."""
        first = F.floor(a / PIECE).cast("int")
        inside = F.array_join(F.slice(blocks, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, inside.substr((a % PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def masked(spans: Column, reach: Column, blocks: Column) -> Column:
        """The pieces before each span that starts a run of overlapping ones, with the run's name, and the rest."""
        heads = F.filter(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")).alias("before"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["before"])
        named = F.array_join(F.transform(heads, lambda x: F.concat(part(blocks, x["before"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), "")
        return F.concat(named, part(blocks, F.get(reach, F.size(reach) - 1), F.length(names["text"]).cast("long")))

    blocks = F.regexp_extract_all(F.col(names["text"]), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    some = F.size(names["all"]) > 0
    found = found.withColumn(names["reach"], F.when(some, F.expr(running(f"transform({names['all']}, x -> -x.back)", "greatest({}, {})"))))
    found = found.withColumn(names["new"], F.when(some, let(blocks, lambda b: masked(F.col(names["all"]), F.col(names["reach"]), b))).otherwise(F.col("text")))
    new = {"text": F.col(names["new"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(names["new"]).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def op4_pii(docs: DataFrame) -> DataFrame:
    joined = lambda *kinds: F.array_join(F.transform(F.concat(*(F.col(k) for k in kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [k for k, v in KINDS.items() if v[2]]
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 1)), ",")
    return find_pii(docs).select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(*base), 256).alias("base_sha256"), joined(*KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))
