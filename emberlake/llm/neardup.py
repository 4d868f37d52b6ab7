"""N-gram Jaccard join: components of documents whose shingle sets are alike.

1. Count shingles in a vector of ``1 << CELL_BITS`` cells; a shingle's cell count
   orders it, rare first. (Any one order gives exact results; rare first gives small
   groups. The vector's length is fixed, so it can be broadcast.)
2. A document's set is kept as its size, a 128-bit hash, and its prefix: the rarest
   n - ceil(t n) + 1 shingles. Documents with equal sets are one class from here on.
   Two sets with Jaccard similarity t or more share a shingle of their prefixes.
3. Classes that share a prefix shingle are candidates, if their sizes (length filter),
   what can follow the shared position (positional filter) and the parities of their
   shingle counts in 256 parts of the hash space (suffix filter: each part that differs
   holds a shingle that only one of them has) allow t.
4. A pair is verified once, on the exact sets. In groups of up to ``SMALL`` classes all
   candidates are. As results are components, a pair within one component needs no
   test, so in larger groups every member is first paired with a few members (the same
   few for the whole group), links are contracted, and so again with others; what then
   is still in different components is tested in full. Thus a group of near copies
   costs rows in proportion to its size.

Defined results: a null or blank text has an empty set and links with nothing; fewer
than ``N`` words make one shingle; repeated rows and equal sets are linked; a null
doc_id never is a component's name, unless no member has an id; other columns are
not read. Rows that repeat a doc_id, or have none, are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm import kernels as K
from emberlake.llm.components import components
from emberlake.llm.counts import count_vector
from emberlake.llm.shared import cut, drop, let, marked, sized, sliced

N = 5
#: Similarity at which documents link, as a share of 100.
PERCENT = 80
CELL_BITS = 20
#: Classes of a group whose pairs are all looked at; four pairs a class at most.
SMALL = 8
#: Members that every other member of a group is paired with, by round; then all that is left.
LEADERS = (2, 8, 32)
#: Pairs that a task verifies at least, if there are as many.
PAIRS = 200
_U = np.uint64


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CELL_BITS)).astype(np.int64)


def _sets(column, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offs = K.utf8(column)
    for lo, hi, d, o in K.blocks(data, offs):
        word, _, at = K.words(d, o, K.WORD_NOT_SPACE)
        sh, so = K.shingles(word, at, n)
        for i in range(hi - lo):
            yield np.unique(sh[so[i] : so[i + 1]])


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a = K.mix(s + _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = K.mix(s ^ _U(0x3C3C3C3C3C3C3C3C)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """256 bits: whether the set has an odd number of shingles in each part of the hash space."""
    part = ((s >> _U(20)) & _U(255)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=256).astype(np.uint8) & 1).view(np.int64)


def _key(of: str = "", text: Column | None = None) -> Column:
    """What tells a row's text from others: its doc_id and the hash of the text."""
    return F.struct(F.coalesce(F.col(f"{of}doc_id").cast("long"), F.lit(-(2**63))).alias("id"), (F.col(f"{of}text_hash") if text is None else text).alias("text"))


def _profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, s1, s2, parity, prefix (rare first) of each row."""
    spark = docs.sparkSession

    def count(batch: pa.RecordBatch, vector: np.ndarray) -> None:
        data, offs = K.utf8(batch.column(0))
        for _, _, d, o in K.blocks(data, offs):
            word, _, at = K.words(d, o, K.WORD_NOT_SPACE)
            vector += np.bincount(_cells(K.shingles(word, at, n)[0]), minlength=len(vector))

    rarity = spark.sparkContext.broadcast(np.minimum(count_vector(docs.select("text"), 1 << CELL_BITS, count), 2**32 - 1).astype(np.uint32))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("parity", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rarity.value
        for batch in sliced(batches):
            sizes, a, b, parities, prefixes = [], [], [], [], []
            for s in _sets(batch.column(2), n):
                size = len(s)
                keep = size - -(-percent * size // 100) + 1 if size else 0
                sizes.append(size)
                h = _set_hash(s)
                a.append(h[0])
                b.append(h[1])
                parities.append(_parity(s))
                prefixes.append(s[np.lexsort((s, freq[_cells(s)]))[:keep]].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(parities, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), values)], schema=schema)

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(profile, "doc_id long, text_hash long, n long, s1 long, s2 long, parity array<long>, prefix array<long>"), "profiles")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter on structs with n and pos."""
    n1, n2, p1, p2 = (F.col(f"{x}.{f}") for f in ("n", "pos") for x in (a, b))
    most = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


def _may_overlap(a: str, b: str, percent: int) -> Column:
    """Suffix filter on structs with n and parity."""
    odd = sum((F.bit_count(F.col(f"{a}.parity")[k].bitwiseXOR(F.col(f"{b}.parity")[k])) for k in range(4)), F.lit(0))
    return (100 + percent) * odd <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verified(pairs: DataFrame, many: int, classes: DataFrame, repeated: bool, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v, link) of the pairs, from the texts of one document of each class; ``repeated``: rows may share doc_id and text."""
    info = classes.select("cid", _key("best.").alias("_key"), "s1")
    at = lambda c: info.select(F.col("cid").alias(c), F.col("_key").alias(f"key_{c}"), F.col("s1").alias(f"s_{c}"))
    placed = cut(sized(pairs.join(at("u"), "u").join(at("v"), "v"), many), "placed")
    own = docs.select(_key(text=F.xxhash64("text")).alias("_key"), "text")
    texts = marked(own, placed.select(F.col("key_u").alias("_key")).union(placed.select("key_v"))).where("_marked").select("_key", "text")
    if repeated:
        texts = texts.groupBy("_key").agg(F.first("text").alias("text"))
    side = lambda c: texts.select(F.col("_key").alias(f"key_{c}"), F.col("text").alias(f"text_{c}"))
    joined = sized(placed.join(side("u"), "key_u").join(side("v"), "key_v"), many, PAIRS).select("u", "v", "s_u", "s_v", "text_u", "text_v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            u, v, su, sv = (batch.column(k).to_pylist() for k in range(4))
            keep, link = [], []
            for k, (a, b) in enumerate(zip(_sets(batch.column(4), n), _sets(batch.column(5), n), strict=True)):
                if _set_hash(a)[0] != su[k] or _set_hash(b)[0] != sv[k]:
                    continue  # another text with the same key
                keep.append(k)
                link.append(_linked(a, b, percent))
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64()), pa.array(link, pa.bool_())], names=["u", "v", "link"])

    return cut(sized(joined.mapInArrow(verify, "u long, v long, link boolean").distinct(), many), "verified")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the exact similarity is reached."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _pair(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v"))


def _labelled(live: DataFrame, stars: DataFrame | None) -> DataFrame:
    if stars is None:
        return live.withColumn("label", F.col("cid"))
    return live.join(stars.select(F.col("u").alias("cid"), F.col("v").alias("_root")), "cid", "left").withColumn("label", F.coalesce("_root", "cid")).drop("_root")


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of every row; (s1, s2, component_id, best) of every set that is not empty, best being the row that stands for the component."""
    profiles = _profiles(docs, n, percent)
    full = profiles.where("n > 0")
    repeated = bool(full.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").take(1))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    grouped = full.groupBy("s1", "s2", "n").agg(least.alias("best"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "sh"))
    shared = members.groupBy("sh").agg(F.count("*").alias("size")).where("size > 1")
    groups = cut(members.join(shared, "sh"), "members")
    size = groups.count()
    live, stars, tested, salt = groups.where(F.col("size") > SMALL).drop("size"), None, None, 0
    for turn, leaders in enumerate((*LEADERS, None)):
        group = _labelled(live, stars)
        mixed = group.groupBy("sh").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("sh")
        left = cut(sized(group.join(mixed, "sh"), size), "open")  # groups that are one component are done
        size = left.count()
        if turn and not size:
            break
        fields = ["cid", "n", "pos", "label"]
        me = F.struct(*fields)
        differ = F.col("a.label") != F.col("b.label")
        if leaders:
            stats = left.groupBy("sh").agg(*(F.min_by(me, F.xxhash64("cid", F.lit(salt + k))).alias(f"l{k}") for k in range(leaders)))
            other = stats.select(F.col("sh").alias("_sh"), F.explode(F.array_distinct(F.array(*(F.col(f"l{k}") for k in range(leaders))))).alias("b"))
            met = left.select("sh", me.alias("a")).join(other, (F.col("sh") == F.col("_sh")) & differ & _may_link("a", "b", percent))
            salt += leaders
        else:
            me = F.struct(*fields, "parity")
            known = left.join(classes.select("cid", "parity"), "cid")
            other = known.select(F.col("sh").alias("_sh"), me.alias("b"))
            met = known.select("sh", me.alias("a")).join(other, (F.col("sh") == F.col("_sh")) & (F.col("a.label") < F.col("b.label")) & _may_link("a", "b", percent) & _may_overlap("a", "b", percent))
        pairs = _pair(met)
        if not turn:
            few = groups.where(F.col("size") <= SMALL).groupBy("sh").agg(F.collect_list(F.struct("cid", "n", "pos")).alias("all"))  # SMALL at most
            twos = let(F.col("all"), lambda x: F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
            met = few.select(F.inline(twos)).where(_may_link("a", "b", percent))
            pairs = pairs.union(_pair(met))
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["u", "v"], "left_anti")
        pairs = cut(sized(pairs, size if turn else groups.count()), "pairs")
        if leaders:
            raw, found = pairs, pairs.count()
            signs = marked(classes.select(F.col("cid").alias("_key"), "n", "parity"), raw.select(F.col("u").alias("_key")).union(raw.select("v"))).where("_marked")
            sign = lambda c: signs.select(F.col("_key").alias(c), F.struct("n", "parity").alias(f"_{c}"))
            pairs = cut(sized(raw.join(sign("u"), "u").join(sign("v"), "v").where(_may_overlap("_u", "_v", percent)).select("u", "v"), found), "pairs")
            drop(raw)
        if many := pairs.count():
            now = _verified(pairs, many, classes, repeated, docs, n, percent)
            links = now.where("link").select("u", "v")
            stars = components(links if stars is None else links.union(stars))
            tested = now.select("u", "v") if tested is None else tested.union(now.select("u", "v"))
        drop(pairs, *([live] if hasattr(live, "_shared_path") else []))
        live = left.drop("label")
        live._shared_path = left._shared_path
    named = _labelled(classes.select("cid", "s1", "s2", "best"), stars)
    names = named.groupBy("label").agg(F.min("best").alias("best"))
    return profiles, named.drop("best").join(names, "label").select("s1", "s2", F.col("best.doc_id").alias("component_id"), "best")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    profiles, sets = _components(docs, n, percent)
    found = sets.drop("best")
    p = profiles.select("doc_id", "n", F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    out = p.join(found, (F.col("n") > 0) & (F.col("_s1") == F.col("s1")) & (F.col("_s2") == F.col("s2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the doc_id it is named after, and every row with an empty set; all columns."""
    profiles, sets = _components(docs, n, percent)
    judged = profiles.where("n > 0").join(sets.select("s1", "s2", "best"), ["s1", "s2"]).select(_key().alias("_key"), (_key() == _key("best.")).alias("stays"))
    found = judged.groupBy("_key").agg(F.count("*").alias("rows"), F.first("stays").alias("stays")).where("not stays or rows > 1")
    found = cut(found, "judged")
    drop(profiles)
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), _key(text=F.xxhash64("text")).alias("_key"))  # packed: no column's name can clash
    seen = marked(own, found)
    unsure = seen.where("_marked").join(found.select("_key"), "_key", "left_anti").select("_row")
    twice = found.where("stays").select("_key")  # equal doc_id and text: one row is taken before they are moved
    once = marked(own, twice).where("_marked").groupBy("_key").agg(F.first("_row").alias("_row")).join(twice, "_key", "left_semi").select("_row")
    return seen.where("not _marked").select("_row").union(unsure).union(once).select("_row.*")


def op9_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, n=4, percent=85)
