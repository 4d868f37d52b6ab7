"""Benchmark decontamination over a distributed positional inverted index.

Nothing of the benchmark or the corpus is gathered on the driver or broadcast, but for
bit sets of fixed length; both sides may grow.

1. The index is stored: for each training document its terms with their positions, of
   the words that the benchmark may have (a bit set of hash cells says which). Counted
   over all documents it gives every term's corpus frequency.
2. Every benchmark item gives its windows of ``WINDOW`` words (a shorter item is one
   window); a window's terms are put in order of rarity. One that has a term without
   any posting is out.
3. The lists of the windows' two rarest terms are intersected where they are stored, at
   the distance that their offsets call for (a bit set of such pairs keeps all others
   from being sent); what they share is dealt by the pair and joined with the windows:
   each posting of the rarest term, less its offset, proposes a start.
4. Documents with proposals get their own stored lists back, and the proposals are
   intersected with the offset-adjusted lists of the other terms, the next rarest first.
   What survives all terms is an exact phrase match; what survives if each further term
   may stand up to ``SLOP`` words off is a proximity match.

Only few documents' lists are shuffled, those with a proposal. A hot pair's postings are
split by Spark's skew handling, as the join needs no key's rows together. A bit that
several terms or pairs share costs postings, never matches.

Defined results: null or wordless texts have no words and no hits; benchmark rows
with a null item_id or without words are ignored; rows of one item_id count as one
item; repeated documents give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import kernels as K
from emberlake.llm.counts import bit_set, cells_of, unpacked
from emberlake.llm.shared import cut, drop, marked, sliced

WINDOW = 10
#: Words that each further term of a proximity match may stand off.
SLOP = 1
#: Bits of the set of terms, and of the set of pairs of a window's rarest terms.
CELLS, PAIR_CELLS = 1 << 20, 1 << 23

_INDEX = "doc_id long, text_hash long, n_words long, terms binary, ends binary, positions binary"
#: What tells one document's text from others, null ids included.
_DOC = ("doc", "text_hash")


def _pair(rarest: np.ndarray, second: np.ndarray, distance: np.ndarray | int) -> np.ndarray:
    """A key of two terms and how far the second stands from the first; of a term alone with 0 and 0."""
    return K.mix(rarest.view(np.uint64) + K.mix(second.view(np.uint64) ^ K.mix(np.asarray(distance, np.int64).astype(np.uint64)))).view(np.int64)


def _flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a binary column, and the lists' ends among them."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind) if offs[-1] > offs[0] else np.zeros(0, kind)
    return values, (offs - offs[0]) // values.itemsize


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The other way round."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, window): the distinct windows of each item, as arrays of term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            word, _, at = K.words(*K.utf8(batch.column(1)), K.WORD_ALNUM)
            terms, count = word.view(np.int64), np.diff(at)
            many = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
            owner = np.repeat(np.arange(len(many)), many)
            begin = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            size = np.minimum(width, count[owner])
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = terms[np.repeat(begin, size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int64()))], names=["item", "window"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, window array<long>").distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: for each document its terms (sorted hashes) of those in ``terms`` (one long column), the ends of their lists, and the positions."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_set(terms, CELLS))  # CELLS bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = unpacked(wanted.value)
        for batch in sliced(batches):
            data, offs = K.utf8(batch.column(2))
            for lo, hi, d, o in K.blocks(data, offs):
                word, _, at = K.words(d, o, K.WORD_ALNUM)
                seen = np.flatnonzero(maybe[cells_of(word, CELLS)])
                term, doc = word[seen].view(np.int64), np.searchsorted(at, seen, "right") - 1
                order = np.lexsort((term, doc))  # stable: positions stay in order
                seen, term, doc = seen[order], term[order], doc[order]
                last = np.flatnonzero(np.append((doc[1:] != doc[:-1]) | (term[1:] != term[:-1]), True)) if len(doc) else np.zeros(0, np.int64)
                row = np.arange(hi - lo + 1)
                edge, lists = np.searchsorted(doc, row), np.searchsorted(doc[last], row)
                ends = (last + 1 - edge[doc[last]]).astype("<i4")
                cut_ = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([cut_.column(0), cut_.column(1), pa.array(np.diff(at), pa.int64()), _binary(term[last], lists), _binary(ends, lists), _binary((seen - at[doc]).astype("<i4"), edge)], names=["doc_id", "text_hash", "n_words", "terms", "ends", "positions"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return cut(rows.mapInArrow(build, _INDEX), "postings")


class Lists:
    """The stored lists of a batch of documents side by side: each document's words keep ``gap`` empty places after them."""

    def __init__(self, n_words, terms, ends, positions, gap: int):
        self.n_words = n_words.to_numpy().astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words + gap)]) + gap
        self.terms, self.of = _flat(terms, "<i8")
        ends, _ = _flat(ends, "<i4")
        place, edge = _flat(positions, "<i4")
        doc = np.repeat(np.arange(len(self.n_words)), np.diff(self.of))
        first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
        self.sizes = ends - np.where(first, 0, np.concatenate([[0], ends[:-1]])) if len(doc) else np.zeros(0, np.int64)
        self.place = place + np.repeat(self.base[:-1], np.diff(edge))
        self.doc = np.repeat(np.arange(len(self.n_words)), np.diff(edge))
        self.term = np.repeat(self.terms, self.sizes)
        self.at = np.zeros(self.base[-1] + gap, np.int64)  # the term at each place
        self.at[self.place] = self.term


def corpus_frequencies(index: DataFrame) -> DataFrame:
    """(term, n): postings of each term in the whole corpus; each task sends a row for each term it has in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(*batch.columns, gap=0)
            term, of = np.unique(lists.terms, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.bincount(of, lists.sizes, len(term)).astype(np.int64), pa.int64())], names=["term", "n"])

    return index.select("n_words", "terms", "ends", "positions").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def ordered_windows(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(wid, window, terms, offsets): the distinct windows that may occur, with their terms in order of rarity."""
    windows = items.select("window").distinct()
    spread = windows.select("window", F.posexplode("window").alias("offset", "term")).join(frequencies, "term")
    ranked = spread.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("ranked"))  # WINDOW at most
    whole = ranked.where(F.size("ranked") == F.size("window"))
    return whole.select(F.monotonically_increasing_id().alias("wid"), "window", F.col("ranked.term").alias("terms"), F.col("ranked.offset").alias("offsets"))


def _leads(windows: DataFrame, slop: int) -> DataFrame:
    """(pair, wid, offset, size): the keys of each window's two rarest terms, one for each distance that ``slop`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, offsets = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            begin = np.concatenate([[0], np.cumsum([len(x) for x in batch.column(1)])]).astype(np.int64)
            size = np.diff(begin)
            alone, own = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
            first = begin[own]
            rows, keys = [alone], [_pair(terms[begin[alone]], np.zeros(len(alone), np.int64), 0)]
            for shift in range(-slop, slop + 1):
                rows.append(own)
                keys.append(_pair(terms[first], terms[first + 1], offsets[first + 1] - offsets[first] + shift))
            who = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), batch.column(0).take(pa.array(who)), pa.array(offsets[begin[who]], pa.int32()), pa.array(size[who], pa.int32())], names=["pair", "wid", "offset", "size"])

    return windows.select("wid", "terms", "offsets").mapInArrow(run, "pair long, wid long, offset int, size int")


def _shared_postings(index: DataFrame, leads: DataFrame, width: int, slop: int) -> DataFrame:
    """(pair, doc, text_hash, n_words, position): places of a term with another at a distance, for the pairs that windows may start from."""

    wanted = index.sparkSession.sparkContext.broadcast(bit_set(leads.select("pair"), PAIR_CELLS))  # PAIR_CELLS bits
    gap = width + slop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = unpacked(wanted.value)
        for batch in sliced(batches, 200):
            lists = Lists(*batch.columns[2:], gap=gap)
            rows, keys = [], []
            for distance in range(-gap + 1, gap):
                other = lists.at[lists.place + distance] if distance else np.zeros(len(lists.place), np.int64)
                some = np.flatnonzero((other != 0) | (distance == 0))
                pair = _pair(lists.term[some], other[some], distance)
                hit = maybe[cells_of(pair, PAIR_CELLS)]
                rows.append(some[hit])
                keys.append(pair[hit])
            who = np.concatenate(rows)
            doc = lists.doc[who]
            mine = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), *(batch.column(c).take(mine) for c in range(3)), pa.array((lists.place[who] - lists.base[doc]).astype(np.int32))], names=["pair", *_DOC, "n_words", "position"])

    return index.mapInArrow(run, "pair long, doc long, text_hash long, n_words long, position int")


def intersect(lists: Lists, doc: np.ndarray, start: np.ndarray, terms: np.ndarray, offsets: np.ndarray, size: np.ndarray, begin: np.ndarray, slop: int) -> np.ndarray:
    """Which proposals (a document and a start) have all terms of their window, those from ``begin`` on, up to ``slop`` words off; the next rarest term first."""
    left = np.arange(len(doc))
    for k in range(1, int(size.max(initial=1))):
        more = left[size[left] > k]
        spot = lists.base[doc[more]] + start[more] + offsets[begin[more] + k]
        found = np.zeros(len(more), bool)
        for shift in range(-slop, slop + 1):
            found |= lists.at[spot + shift] == terms[begin[more] + k]
        keep = np.ones(len(doc), bool)
        keep[more[~found]] = False
        left = left[keep[left]]
    return left


_FOUND = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("hits", pa.list_(pa.int32())), ("near", pa.list_(pa.int32())), ("found", pa.list_(pa.struct([("wid", pa.int64()), ("exact", pa.bool_())])))])


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index; (doc, text_hash, hits, near, found) of the documents with a match, ``found`` being (wid, exact); (item, wid)."""
    items = cut(windows_of(benchmark, width), "windows")
    index = build_index(docs, items.select(F.explode("window")))
    keyed = index.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), *index.columns[1:])
    frequencies = cut(corpus_frequencies(index), "frequencies")  # else the join with the windows would take over the partitions of this sum, and Spark could not split a hot term
    windows = cut(ordered_windows(items, frequencies), "ranked")
    drop(frequencies)
    leads = _leads(windows, slop)
    start = (F.col("position") - F.col("offset")).cast("int")
    met = _shared_postings(keyed, leads, width, slop).join(leads, "pair").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    by_window = met.groupBy(*_DOC, "wid").agg(F.collect_set(start).alias("starts"))
    proposed = by_window.join(windows.select("wid", "terms", "offsets"), "wid")
    by_doc = cut(proposed.groupBy(*_DOC).agg(F.collect_list(F.struct("wid", "starts", "terms", "offsets")).alias("proposed")), "proposed")
    asked = marked(keyed.withColumn("_key", F.struct(*_DOC)), by_doc.select(F.struct(*_DOC).alias("_key"))).where("_marked").drop("_key", "_marked")
    once = asked.join(by_doc, list(_DOC)).dropDuplicates(list(_DOC)).select(*_DOC, "n_words", "terms", "ends", "positions", "proposed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            lists = Lists(*batch.columns[2:6], gap=width + slop)
            mine = batch.column(6)
            of_window = np.repeat(np.arange(batch.num_rows), np.diff(mine.offsets.to_numpy()))
            window = mine.flatten()
            wid, starts, terms, offsets = (window.field(k) for k in range(4))
            size = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            many = np.diff(starts.offsets.to_numpy())
            which = np.repeat(np.arange(len(window)), many)
            doc, start = of_window[which], starts.flatten().to_numpy().astype(np.int64)
            begin = (np.cumsum(size) - size)[which]
            cover, found = [], [set(), set()]
            for k, off in enumerate((0, slop)):
                left = intersect(lists, doc, start, terms.flatten().to_numpy(), offsets.flatten().to_numpy(), size[which], begin, off)
                at = lists.base[doc[left]] + start[left]
                edge = np.zeros(len(lists.at) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size[which[left]], -1)
                cover.append(np.cumsum(edge)[:-1] > 0)
                found[k] = set(which[left].tolist())
            spans = []
            for c in cover:
                spots = np.flatnonzero(c)
                edges = np.searchsorted(spots, lists.base)
                spans.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((spots - np.repeat(lists.base[:-1], np.diff(edges))).astype(np.int32))))
            names = wid.to_numpy()
            per_doc: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for w in sorted(found[1]):
                per_doc[of_window[w]].append({"wid": int(names[w]), "exact": w in found[0]})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *spans, pa.array(per_doc, _FOUND.field("found").type)], schema=_FOUND)

    hit = cut(once.mapInArrow(run, "doc long, text_hash long, hits array<int>, near array<int>, found array<struct<wid: long, exact: boolean>>").where(F.size("near") > 0), "hits")
    drop(by_doc)
    return index, hit, items.join(windows.select("wid", "window"), "window").select("item", "wid")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, text_hash, n_words, hits (word positions inside an exact match), items, near_hits, near_items (proximity matches, exact ones included) of every document."""
    index, hit, items = matches(docs, benchmark, width, slop)
    found = hit.select(*_DOC, F.inline("found")).join(items, "wid")
    named = lambda which: F.sort_array(F.collect_set(which))
    by_doc = found.groupBy(*_DOC).agg(named(F.when(F.col("exact"), F.col("item"))).alias("items"), named(F.col("item")).alias("near_items"))
    result = hit.select(*_DOC, "hits", "near").join(by_doc, list(_DOC)).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text"), "hits", "items", "near", "near_items")
    rows = index.select("doc_id", "text_hash", "n_words").join(result, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_doc")) & (F.col("text_hash") == F.col("_text")), "left")
    or_none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return rows.select("doc_id", "text_hash", "n_words", or_none("hits", "int").alias("hits"), or_none("items", "string").alias("items"), or_none("near", "int").alias("near_hits"), or_none("near_items", "string").alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents in which no benchmark window occurs. Only rows that a bit set of the contaminated ones marks are shuffled."""
    index, hit, _ = matches(docs, benchmark, slop=0)
    key = lambda doc, text: F.struct(doc.alias("doc"), text.alias("text")).alias("_key")
    found = hit.where(F.size("hits") > 0).select(key(F.col("doc"), F.col("text_hash")))
    drop(index)
    doc, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))), F.xxhash64(docs["text"])
    seen = marked(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), key(doc, text)), found)  # packed: no column's name can clash
    unsure = seen.where("_marked").join(found, "_key", "left_anti").select("_row")
    return seen.where("not _marked").select("_row").union(unsure).select("_row.*")


def op5_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return phrase_matches(docs, benchmark).select("doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), size("near_hits").alias("n_near_hit"), size("near_items").alias("n_near_items"))
