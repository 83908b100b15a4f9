r"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments and writes, per segment, the
postings of every term (ascending positions in the segment) and the place of
every document. A query joins the terms of the benchmark items with the postings,
so only the lists of those terms leave the index. Within a segment a phrase is
found from its rarest term, by document frequency over the whole index: the
list of that term, shifted to the phrase's start, is intersected with the
shifted list of the next rarer term, and so on; an empty intersection ends the
search. Proximity matches take the rarest term's positions and keep those
with every other term within the given distance.

Words are the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z. The
windows of an item are its runs of ``window`` words (or the whole item, if
shorter).

Items are handled in blocks of ``ITEMS_PER_BLOCK``, so neither a task nor a
broadcast grows with the benchmark. A frequent term gives one row per segment
and block, never one group.

Defined results: null texts have no words; an item without words matches
nothing; items with a null id mark the documents they occur in but are neither
counted nor listed; repeated rows of either table are rows of their own (an id
is counted once); extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.session import materialize

from .texts import mixed, text_buffers, text_key, tidy

#: Bytes of text in a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 8 << 20
SEGMENT_DOCS = 50_000
ITEMS_PER_BLOCK = 1_000

_WORD = np.ones(256, bool)
_WORD[:0x30] = False
_WORD[0x3A:0x61] = False
_WORD[0x7B:0x80] = False
_WORD[65:91] = True  # lower-cased first
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word, first word of each row and the end) of lower-cased ``data``.

    The hash only groups equal words of one segment; terms are stored as strings.
    """
    parts = []
    begin, stop_at = int(offsets[0]), int(offsets[-1])
    while begin < stop_at:
        stop = min(begin + _PIECE, stop_at)
        if stop < stop_at:
            gaps = np.flatnonzero(~_WORD[data[begin:stop]])
            stop = begin + int(gaps[-1]) + 1 if len(gaps) else stop_at
        piece = data[begin:stop]
        word = _WORD[piece]
        new = np.empty(len(piece), bool)
        new[0] = True
        np.not_equal(word[1:], word[:-1], out=new[1:])
        new[offsets[(offsets >= begin) & (offsets < stop)] - begin] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=len(piece))
        place = np.arange(len(piece)) - np.repeat(starts, lengths)
        powers = np.full(int(lengths.max()), _BASE)
        powers[0] = np.uint64(1)
        np.multiply.accumulate(powers, out=powers)
        sums = np.add.reduceat(piece * powers[place], starts)
        keep = word[starts]
        parts.append((mixed(sums[keep] + lengths[keep].astype(np.uint64)), starts[keep] + begin, (starts + lengths)[keep] + begin))
        begin = stop
    none = np.zeros(0, np.int64)
    h, a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (none.astype(np.uint64), none, none)
    return h, a, b, np.searchsorted(a, offsets)


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, positions of all terms one after the other, end of each term, first position of each row and the end)."""
    h, a, b, first = word_table(data, offsets)
    order = np.argsort(h, kind="stable")
    grouped = h[order]
    ends = np.append(np.flatnonzero(grouped[1:] != grouped[:-1]) + 1, len(h)) if len(h) else np.zeros(0, np.int64)
    heads = order[np.append(0, ends[:-1])] if len(h) else order
    raw = data.tobytes()
    terms = [raw[s:e] for s, e in zip(a[heads].tolist(), b[heads].tolist())]
    return terms, order.astype("<i4"), ends, first


# kind "term": positions and n (documents) of a term; "segment": the first position of each
# document and the end; "doc": first position and n (words) of a document.
_INDEX = "kind string, segment long, term string, positions binary, n long, ordinal long, doc_id long, first long, text_key long"


def _segment_rows(number: int, ids: list, keys: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _INDEX.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 5)

    def rows(kind, size, **columns):
        columns |= {"kind": pa.array([kind]).take(pa.array(np.zeros(size, np.int64))), "segment": pa.array(np.full(size, number))}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in zip(names, types)], names=names)

    data = _LOWER[np.concatenate([d for d, _ in texts])]
    offsets = np.append(0, np.cumsum(np.concatenate([lengths for _, lengths in texts])))
    terms, positions, ends, first = postings(data, offsets)
    begins = np.append(0, ends)[:-1].astype(np.int64)
    # Documents with a term: changes of document along its list.
    doc = np.searchsorted(first, positions, side="right")
    fresh = np.append(True, doc[1:] != doc[:-1])[:len(doc)]
    fresh[begins] = True
    seen = np.append(0, np.cumsum(fresh))
    at = pa.py_buffer(np.append(0, ends * 4).astype(np.int32))
    yield rows(
        "term", len(terms), term=pa.array(terms, pa.binary()).cast(pa.string()), n=pa.array(seen[ends] - seen[begins], pa.int64()),
        positions=pa.Array.from_buffers(pa.binary(), len(terms), [None, at, pa.py_buffer(positions)]),
    )
    yield rows("segment", 1, positions=pa.array([first.astype("<i4").tobytes()], pa.binary()))
    yield rows(
        "doc", len(ids), n=pa.array(np.diff(first), pa.int64()), ordinal=pa.array(np.arange(len(ids))), first=pa.array(first[:-1], pa.int64()),
        doc_id=pa.array(ids, pa.int64()), text_key=pa.array(keys, pa.int64()),
    )


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder; see ``_INDEX`` for its rows."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, keys, texts, size = [], [], [], 0
        for batch in batches:
            data, at = text_buffers(batch.column(2))
            new_ids, new_keys, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while a < len(new_ids):
                b = int(np.searchsorted(at, at[a] + SEGMENT_BYTES - size, side="right")) - 1
                b = min(max(b, a if ids else a + 1), len(new_ids), a + SEGMENT_DOCS - len(ids))
                # A copy, since the batch's memory goes with the batch.
                texts.append((data[at[a]:at[b]].copy(), np.diff(at[a:b + 1])))
                ids, keys, size, a = ids + new_ids[a:b], keys + new_keys[a:b], size + int(at[b] - at[a]), b
                if a < len(new_ids):
                    yield from _segment_rows(number, ids, keys, texts)
                    number, ids, keys, texts, size = number + 1, [], [], [], 0
        if ids:
            yield from _segment_rows(number, ids, keys, texts)

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return materialize(narrow.mapInArrow(tidy(run), _INDEX))


def item_words(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, words) of the items that have words."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return benchmark.select(F.col("item_id").cast("long"), words.alias("words")).filter(F.size("words") > 0).distinct()


def in_blocks(items: DataFrame, per_block: int) -> DataFrame:
    """``items`` with a block number from their hash; about ``per_block`` items share a block."""
    blocks = max(1, -(-items.count() // per_block))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))


def phrase_starts(lists: dict[str, np.ndarray], weight: dict[str, int], words: list[str]) -> np.ndarray:
    """Start positions of ``words`` as consecutive terms: offset-adjusted lists from the rarest term on."""
    order = sorted(range(len(words)), key=lambda i: (weight.get(words[i], 0), len(lists.get(words[i], ())), i))
    found = None
    for i in order:
        own = lists.get(words[i])
        if own is None:
            return np.zeros(0, np.int64)
        if found is None:
            found = own - i
        else:
            place = np.minimum(np.searchsorted(own, found + i), len(own) - 1)
            found = found[own[place] == found + i]
        if not len(found):
            return found
    return found


def proximity_anchors(
    lists: dict[str, np.ndarray], weight: dict[str, int], words: list[str], distance: int, first: np.ndarray
) -> np.ndarray:
    """Positions of the rarest of ``words`` that have each other word of it in the same document, at most ``distance`` away."""
    terms = sorted(set(words), key=lambda w: (weight.get(w, 0), w))
    found = lists.get(terms[0], np.zeros(0, np.int64))
    for term in terms[1:]:
        own = lists.get(term)
        if own is None or not len(found):
            return np.zeros(0, np.int64)
        doc = np.searchsorted(first, found, side="right")
        place = np.searchsorted(own, np.maximum(found - distance, first[doc - 1]))
        last = np.minimum(found + distance, first[doc] - 1)
        found = found[(place < len(own)) & (own[np.minimum(place, len(own) - 1)] <= last)]
    return found


_MATCH = "segment long, ordinal long, item_id long, first long, last long"


def matches(index: DataFrame, items: DataFrame, window: int = 10, proximity: int | None = None) -> DataFrame:
    """(segment, ordinal, item_id, first, last): where windows of items occur, as ranges of word positions.

    Exact phrases of ``window`` words by default. With ``proximity`` an item matches
    where all words of a window lie within that many positions of its rarest word
    in one document; the range is then that word alone. Ranges of one item are
    merged per document.
    """
    items = materialize(in_blocks(items, ITEMS_PER_BLOCK))
    wanted = materialize(items.select("block", F.explode("words").alias("term")).distinct())
    terms = index.filter(F.col("kind") == "term").select("segment", "term", "positions", "n")
    # One pass over the index. Whether the written terms are small enough to broadcast is left to the planner.
    lists = materialize(terms.join(wanted.select("term").distinct(), "term", "left_semi"))
    weights = materialize(wanted.join(lists.groupBy("term").agg(F.sum("n").alias("df")), "term"))
    needed = lists.join(weights, "term").select("segment", "block", "term", "positions", "df")
    # A block's items are one value of about ITEMS_PER_BLOCK items; it goes to the segments that have any of its terms.
    packed = items.groupBy("block").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    firsts = index.filter(F.col("kind") == "segment").select("segment", F.col("positions").alias("firsts"))
    met = lists.select("segment", "term").join(weights.select("block", "term"), "term").select("segment", "block").distinct()
    asked = met.join(firsts, "segment").join(packed, "block")
    side = asked.select(F.col("segment").alias("in_segment"), F.col("block").alias("in_block"), "firsts", "items")

    def search(rows, side):
        if not len(rows) or not len(side):
            return _frame([])
        return _search(rows, side, window, proximity)

    return needed.groupBy("segment", "block").cogroup(side.groupBy("in_segment", "in_block")).applyInPandas(search, _MATCH)


def _frame(parts: list[tuple]) -> pd.DataFrame:
    """Parts of (segment, ordinals, item_id, firsts, lasts) as rows of ``_MATCH``."""
    cat = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
    sizes = [len(p[1]) for p in parts]
    ids = pd.array([p[2] for p in parts], dtype="Int64").repeat(sizes)
    segments = np.repeat(np.array([p[0] for p in parts], np.int64), sizes)
    return pd.DataFrame({"segment": segments, "ordinal": cat(1), "item_id": ids, "first": cat(3), "last": cat(4)})


def _search(rows: pd.DataFrame, side: pd.DataFrame, window: int, proximity: int | None) -> pd.DataFrame:
    lists = {t: np.frombuffer(p, "<i4").astype(np.int64) for t, p in zip(rows["term"], rows["positions"])}
    weight = dict(zip(rows["term"], rows["df"]))
    first = np.frombuffer(side["firsts"].iloc[0], "<i4").astype(np.int64)
    segment, out = int(side["in_segment"].iloc[0]), []
    for item in side["items"].iloc[0]:
        words = list(item["words"])
        k = min(window, len(words))
        absent = np.append(0, np.cumsum([w not in lists for w in words]))
        whole = np.flatnonzero(absent[k:] == absent[:-k])
        if proximity is None:
            starts = [phrase_starts(lists, weight, words[i:i + k]) for i in whole]
        else:
            starts = [proximity_anchors(lists, weight, words[i:i + k], proximity, first) for i in whole]
            k = 1
        found = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        # An empty document starts where the next one does; the last that starts there is meant.
        doc = np.searchsorted(first, found, side="right") - 1
        inside = found + k <= first[doc + 1] if len(found) else np.zeros(0, bool)  # a phrase stays within a document
        found, doc = found[inside], doc[inside]
        if not len(found):
            continue
        new = np.append(True, (doc[1:] != doc[:-1]) | (np.diff(found) > k))
        last = np.append(np.flatnonzero(new)[1:], len(found)) - 1
        base = first[doc[new]]
        out.append((segment, doc[new], item["item_id"], found[new] - base, found[last] + k - base))
    return _frame(out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    index = build_index(docs)
    found = matches(index, item_words(benchmark), window)
    places = index.filter(F.col("kind") == "doc").select("segment", "ordinal", "doc_id", "text_key", "n")
    key = ("segment", "ordinal")
    # Words hit by several items count once: sum over the ranges what lies past all earlier ends.
    ranges = found.groupBy(*key, "first").agg(F.max("last").alias("last"), F.collect_set("item_id").alias("ids"))
    per_doc = ranges.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"),
    )
    step = lambda s, r: F.struct(
        F.greatest(s["end"], r["last"]).alias("end"), (s["n"] + F.greatest(r["last"] - F.greatest(s["end"], r["first"]), F.lit(0))).alias("n")
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hits = per_doc.select(*key, F.aggregate("ranges", start, step, lambda s: s["n"]).alias("n_hit"), F.array_sort(F.col("ids").cast("array<string>")).alias("items"))
    joined = places.withColumnRenamed("n", "n_words").join(hits, list(key), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows in which a window of a benchmark item occurs."""
    found = contamination(docs, benchmark, window).filter("contaminated")
    bad = materialize(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    keyed = docs.withColumn("_text_key", text_key())
    same = keyed["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (keyed["_text_key"] == bad["_key"])
    return keyed.join(bad, same, "left_anti").drop("_text_key")
