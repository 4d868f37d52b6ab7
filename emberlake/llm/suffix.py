"""Exact substring de-duplication by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.
Full suffix sorting would move every suffix of the corpus; here a suffix only moves
if its string may repeat:

1. Each window of LENGTH symbols has an anchor, the leftmost start of its least q-gram
   hash. Equal windows have equal anchors at equal distances. Windows of a document
   that share an anchor make a run; about two runs come from every LENGTH symbols.
2. Runs go into buckets by the q-gram at their anchor. A run alone in its bucket has
   no repeated window. Runs with equal symbols are one class; all windows of a class
   with two runs or more repeat.
3. Buckets with several classes are refined: suffixes of one run of each class start
   in buckets of q-grams; a refinement sorts by (own bucket, bucket ``k`` symbols
   later), the new bucket numbers serve at once as later-offset pointers for the next,
   doubling the depth to LENGTH (the last step overlaps). Windows that share their
   last bucket are equal. All windows of a bucket are in one task, except where a
   bucket has more than ``HOT`` classes: there buckets are numbered by a hash of the
   pair of pointers instead of its rank, so that the same steps need no common task,
   and the windows are dealt by their last number.
4. Covered bytes are removed from each document.

Equality in steps 2 and in hot buckets is that of two 64-bit hashes with bases and
symbol values of their own, besides the anchor's. Texts are handled in overlapping
pieces of ``CHUNK`` symbols; a run that a cut divides is refined like any other.

The symbols are bytes. The same steps over words find long passages that differ in
their white space or case (``passages``); these are reported, not removed.

Strings are judged on the input, overlaps count, and matches never cross documents.
Defined results: a null text is empty; documents shorter than LENGTH keep all bytes;
repeated rows remove each other wherever they have LENGTH bytes; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import kernels as K
from emberlake.llm.shared import cut, drop, sliced

LENGTH = 400
#: Words of a passage that is reported.
PASSAGE = 50
#: Classes of a bucket from which it is dealt over tasks.
HOT = 5000
#: Bytes refined together at least, if there are as many; whole buckets.
BUFFER = 1 << 20
#: Symbols of a long text handled at once.
CHUNK = 1 << 21

_U = np.uint64
_LOW = 28  # bits for a position inside a block or chunk


@dataclass(frozen=True)
class Unit:
    """What strings are made of. anchor: symbols of the q-grams that place the anchors; start: of the first buckets of the refinement."""

    words: bool
    anchor: int
    start: int

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts, and where each text's begin."""
        if not self.words:
            return data, offs
        word, _, at = K.words(data, offs, K.WORD_NOT_SPACE)
        return word, at

    def values(self, symbols: np.ndarray, which: int = 0) -> np.ndarray:
        if self.words:
            return K.mix(symbols + _U(0x51ED270B)) if which else symbols
        return (K._BYTE2 if which else K._BYTE)[symbols]

    def read(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint64 if self.words else np.uint8)


BYTES, WORDS = Unit(False, 32, 50), Unit(True, 8, 13)


def rolling(values: np.ndarray, q: int, which: int = 0) -> np.ndarray:
    """Hash of the q symbols from each position."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    place = np.arange(n)
    return K.run_hashes(K.prefix_sums(values, which), place, place + q, which)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_FIELDS = ("doc", "start", "count", "key", "rel", "s1", "s2")


def runs_of(symbols: np.ndarray, offs: np.ndarray, length: int = LENGTH, unit: Unit = BYTES) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: document, first window, number of windows, anchor hash, anchor's distance from the first window, two hashes of the symbols."""
    q = min(unit.anchor, length)
    if len(symbols) < length:
        return {k: np.zeros(0, np.int64) for k in _FIELDS}
    gram = rolling(unit.values(symbols), q)
    tagged = ((gram >> _U(_LOW)) << _U(_LOW)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_sliding_least(tagged, length - q + 1) & _U((1 << _LOW) - 1)).astype(np.int64)
    place = np.arange(len(anchor))
    doc = np.searchsorted(offs, place, "right") - 1
    inside = np.flatnonzero(place + length <= offs[doc + 1])
    anchor, doc = anchor[inside], doc[inside]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(inside) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(inside)))
    start, anchor, doc = inside[first], anchor[first], doc[first]
    hashes = [K.run_hashes(K.prefix_sums(unit.values(symbols, which), which), start, start + count + length - 1, which).view(np.int64) for which in (0, 1)]
    return dict(zip(_FIELDS, (doc, start - offs[doc], count, gram[anchor].view(np.int64), anchor - start, *hashes), strict=True))


def _runs_of_block(symbols: np.ndarray, offs: np.ndarray, length: int, unit: Unit, chunk: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of a block of whole documents; one long document in pieces that share length - 1 symbols."""
    if len(offs) > 2 or len(symbols) <= chunk + length:
        yield runs_of(symbols, offs, length, unit)
        return
    for lo in range(0, len(symbols) - length + 1, chunk):
        piece = symbols[lo : lo + chunk + length - 1]
        got = runs_of(piece, np.array([0, len(piece)]), length, unit)
        yield got | {"start": got["start"] + lo}


_RUN = "key long, rel int, count int, s1 long, s2 long, doc_id long, text_hash long, start long"


def _runs(batches: Iterator[pa.RecordBatch], length: int, unit: Unit, chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        data, offs = K.utf8(batch.column(2))
        ids, hashes = batch.column(0), batch.column(1)
        for lo, _, d, o in K.blocks(data, offs):
            for r in _runs_of_block(*unit.symbols(d, o), length, unit, chunk):
                who = pa.array(r["doc"] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(r["key"], pa.int64()), pa.array(r["rel"].astype(np.int32)), pa.array(r["count"].astype(np.int32)), pa.array(r["s1"], pa.int64()), pa.array(r["s2"], pa.int64()), ids.take(who), hashes.take(who), pa.array(r["start"], pa.int64())], names=["key", "rel", "count", "s1", "s2", "doc_id", "text_hash", "start"])


def refine(symbols: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int = LENGTH, unit: Unit = BYTES) -> np.ndarray:
    """For each window start of segments (``count`` windows from ``begin``): whether its window occurs at two of them or more.

    Buckets of START-grams are refined to twice the depth by sorting on the bucket that
    many symbols later, until the depth is ``length``.
    """
    depth = min(unit.start, length)
    left = np.zeros(len(symbols), np.int64)  # symbols to the end of the own segment
    for b, c in zip(begin.tolist(), count.tolist(), strict=True):
        left[b : b + c + length - 1] = np.arange(c + length - 1, 0, -1)
    spots = np.flatnonzero(left >= depth)
    bucket = np.full(len(symbols), -1, np.int64)
    bucket[spots] = np.unique(rolling(unit.values(symbols), depth)[spots], return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        spots = spots[left[spots] >= depth + step]
        pair = bucket[spots] * np.int64(len(symbols) + 1) + bucket[spots + step]
        fresh = np.full(len(symbols), -1, np.int64)
        fresh[spots] = np.unique(pair, return_inverse=True)[1]
        bucket, depth = fresh, depth + step
    window = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count, strict=True)]) if len(begin) else np.zeros(0, np.int64)
    mine = bucket[window]
    return np.bincount(mine, minlength=1)[mine] > 1 if len(mine) else np.zeros(0, bool)


def numbered(symbols: np.ndarray, length: int, unit: Unit, which: int) -> np.ndarray:
    """The last bucket of each window of one segment, by the steps of ``refine``, but numbered by hashes of the pairs of pointers."""
    depth = min(unit.start, length)
    bucket = rolling(unit.values(symbols, which), depth, which)
    while depth < length:
        step = min(depth, length - depth)
        bucket, depth = K.mix(bucket[:-step] * _U(0x9E3779B97F4A7C15) + K.mix(bucket[step:] + _U(depth + which))), depth + step
    return bucket.view(np.int64)


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


_SPAN = "doc_id long, text_hash long, lo long, hi long"
_NAMES = ["doc_id", "text_hash", "lo", "hi"]


def _refined(batches: Iterator[pa.RecordBatch], length: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    """Segments sorted by bucket: (key, count, alone, doc_id, text_hash, start, symbols) to spans of repeated window starts, of classes with one run."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        symbols = unit.read(b"".join(h[6] for h in held))
        begin = np.cumsum([0] + [len(unit.read(h[6])) for h in held[:-1]])
        count = np.array([h[1] for h in held])
        again = refine(symbols, begin, count, length, unit)
        rows, at = [], 0
        for key, c, alone, doc, text, start, _ in held:
            if alone:
                for lo, hi in zip(*_intervals(again[at : at + c]), strict=True):
                    rows.append((doc, text, start + int(lo), start + int(hi)))
            at += c
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=_NAMES)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and size >= BUFFER and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield flush()


def _segments(batches: Iterator[pa.RecordBatch], length: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    """(text, runs) to one row for each run, with its symbols. A run of a hot bucket comes as its windows, with the two numbers of their last buckets."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), _SEGMENT_TYPES, strict=True)], names=["key", "key2", "count", "alone", "doc_id", "text_hash", "start", "symbols"])

    for batch in sliced(batches):
        data, offs = K.utf8(batch.column(2))
        out: list[tuple] = []
        held = 0
        for i in range(batch.num_rows):
            d, _ = unit.symbols(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
            doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for r in batch.column(3)[i].as_py():
                s, c = r["start"], r["count"]
                run = d[s : s + c + length - 1]
                if r["hot"]:
                    one, two = (numbered(run, length, unit, which).tolist() for which in (0, 1))
                    out += [(a, b, 1, r["alone"], doc, text, s + p, None) for p, (a, b) in enumerate(zip(one, two, strict=True))]
                else:
                    out.append((r["key"], None, c, r["alone"], doc, text, s, run.tobytes()))
                held += (c + length) * (64 if r["hot"] else 1)
                if held > 8 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)


_SEGMENT = "key long, key2 long, count int, alone boolean, doc_id long, text_hash long, start long, symbols binary"
_SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT, unit: Unit = BYTES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, lo, hi): spans of window starts whose window occurs elsewhere too."""
    rows = _rows(docs)
    runs = cut(rows.mapInArrow(lambda b: _runs(b, length, unit, chunk), _RUN), "runs")
    both = F.struct("s1", "s2")
    buckets = runs.groupBy("key").agg(F.count("*").alias("_runs"), F.min(both).alias("_a"), F.max(both).alias("_b")).where("_runs > 1").select("key", (F.col("_a") != F.col("_b")).alias("mixed"))
    buckets = cut(buckets, "buckets")  # else the join below would take over the partitions of this sum, and Spark could not split a hot bucket
    many = cut(runs.join(buckets, "key"), "repeats")  # a run alone in its bucket ends here
    drop(runs, buckets)
    span = [F.col("start").alias("lo"), (F.col("start") + F.col("count")).alias("hi")]
    pure = many.where("not mixed").select("doc_id", "text_hash", *span)
    same = ["key", "s1", "s2", "rel", "count"]
    classes = cut(many.where("mixed").groupBy(*same).agg(F.count("*").alias("_times"), F.min(F.struct("doc_id", "text_hash", "start")).alias("one")), "classes")
    twice = classes.where("_times > 1").select(*same)
    whole = many.where("mixed").join(twice, same).select("doc_id", "text_hash", *span)
    crowd = classes.groupBy("key").agg(F.count("*").alias("_classes"), F.min("_times").alias("_least")).where("_classes > 1 and _least = 1").select("key", (F.col("_classes") > hot).alias("hot"))
    wanted = classes.join(crowd, "key").select(F.col("one.doc_id").alias("_doc"), F.col("one.text_hash").alias("_text"), F.struct("key", "count", F.col("one.start").alias("start"), (F.col("_times") == 1).alias("alone"), "hot").alias("run"))
    by_doc = wanted.groupBy("_doc", "_text").agg(F.collect_list("run").alias("runs"))  # at most a document's own runs
    once = _joined(rows, by_doc, "inner").select("doc_id", "text_hash", "text", "runs")
    segments = cut(once.mapInArrow(lambda b: _segments(b, length, unit), _SEGMENT), "segments")
    cold = segments.where("key2 is null").select("key", "count", "alone", "doc_id", "text_hash", "start", "symbols")
    refined = cold.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _refined(b, length, unit), _SPAN)
    warm = segments.where("key2 is not null").select("key", "key2", "alone", "doc_id", "text_hash", "start")
    often = warm.groupBy("key", "key2").agg(F.count("*").alias("_times")).where("_times > 1").select("key", "key2")
    split = warm.where("alone").join(often, ["key", "key2"]).select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + 1).alias("hi"))
    found = cut(pure.union(whole).union(refined).union(split), "spans")
    drop(many, classes, segments)
    return found


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _joined(rows: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    return rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["_doc"]) & (rows["text_hash"] == by_doc["_text"]), how)


def _removed(text: np.ndarray, spans: list | None, length: int) -> np.ndarray:
    """Covered bytes."""
    edge = np.zeros(len(text) + 1, np.int64)
    for s in spans or ():
        edge[s["lo"]] += 1
        edge[s["hi"] + length - 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def passages(docs: DataFrame, words: int = PASSAGE, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, lo, hi): spans of first words of passages of so many words that occur elsewhere too."""
    return repeated_windows(docs, words, hot, WORDS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_passage_words", pa.int64()), ("kept", pa.binary())])


def deduplicated(docs: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage_words (words in passages of ``words`` that occur elsewhere too), kept (the remaining bytes) of every document."""
    spans = passages(docs, words, hot).withColumn("word", F.lit(True)).union(repeated_windows(docs, length, hot).withColumn("word", F.lit(False)))
    by_doc = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).agg(F.collect_set(F.struct("word", "lo", "hi")).alias("spans"))
    joined = _joined(_rows(docs), by_doc, "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offs = K.utf8(batch.column(1))
            out: list[tuple] = []
            held = 0
            for i, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                d, spans = data[offs[i] : offs[i + 1]], spans.as_py() or ()
                gone = _removed(d, [s for s in spans if not s["word"]], length)
                said = [s for s in spans if s["word"]]
                again = int(_removed(np.zeros(max((s["hi"] for s in said), default=0) + words), said, words).sum())
                out.append((doc, len(d), int(gone.sum()), len(_intervals(gone)[0]), again, d[~gone].tobytes()))
                held += len(d)
                if held > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), _KEPT, strict=True)], schema=_KEPT)
                    out, held = [], 0

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary")


def op2_suffix(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
