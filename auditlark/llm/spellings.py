"""Spelling variants of a corpus vocabulary by reduced-alphabet generation.

The letters of a word are hashed to ``SYMBOLS`` symbols. Every word asks for the
full one-edit neighbourhood of its reduced form (itself, and each deletion,
insertion and replacement of a symbol), these keys meet the reduced forms of the
vocabulary in one join, and the candidates are verified on the original strings.
Two words one edit apart reduce to forms at most one edit apart, so none is lost.

A reduced form is a 64-bit polynomial of its symbols, and so is each edited form:
prefix and suffix sums give it in constant time, however long the word. Equal keys
of different forms only add candidates that the verification drops.

Keys that no word has are dropped where they are made, by a bitmap of ``SLOTS`` bits
that is built with a distributed aggregation and has the same size for every
vocabulary; a full one would only drop fewer.

Reduced forms shared by more than ``BUCKET`` words do not meet in pairs: such words,
and the words with such a form in their neighbourhood, ask once more with every
letter as its own symbol, where a key holds a single word. Both sides of
the first join then have at most ``BUCKET`` words per form, whatever the words.

Each word's most frequent near word that is at least twice as frequent is its form;
forms are followed to the root by pointer doubling (frequencies double at each
step, so 2^6 steps end every chain).

Defined results: a null or empty text has no words; a null id reads as an empty
string in the rule that drops letters; repeated rows count again; of equally
frequent near words the first in code-point order is the form; runs of any length
are words; extra columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.session import materialize

from .texts import mixed

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Symbols of the reduced alphabet, most words of a reduced form that meet in pairs, keys made at once, bits of the map of known keys.
SYMBOLS = 12
BUCKET = 256
KEYS = 1 << 19
SLOTS = 1 << 27
#: Letters that words are made of.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MAP_BITS = 32_768  # of one row of bitmap_construct_agg
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dropped_letter(doc_id: Column, run: Column, one_in: int) -> Column:
    """``run`` less one letter where ``one_in`` divides the crc32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int, min_count: int, one_in: int) -> DataFrame:
    """(word, n): words of whole texts with their occurrences."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({LETTERS})"), F.lit(1))
    words = docs.select("doc_id", F.explode(runs).alias("run")).filter(F.length("run") >= min_length)
    words = words.select(dropped_letter(F.col("doc_id"), F.col("run"), one_in).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def reduced(codes: np.ndarray, symbols: int | None) -> np.ndarray:
    """Symbols of code points, from 1 on; ``None`` keeps every letter apart."""
    return (codes % np.uint64(symbols) if symbols else codes) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE)
    p[0] = np.uint64(1)
    return np.multiply.accumulate(p, out=p)


def own_keys(words: np.ndarray, symbols: int | None) -> np.ndarray:
    """Key of each row of a matrix of code points."""
    s = reduced(words, symbols)
    return (s * _powers(s.shape[1])[None]).sum(1, dtype=np.uint64)


def neighbour_keys(words: np.ndarray, symbols: int | None) -> np.ndarray:
    """Per row the keys of the one-edit neighbourhood of its reduced form, itself included; repeats kept."""
    s = reduced(words, symbols)
    m, n = s.shape
    letters = np.unique(reduced(ALPHABET, symbols))
    powers = _powers(n + 1)
    terms = s * powers[None, :n]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    whole = before[:, -1:]
    after = whole - before  # terms from position i on
    deleted = before[:, :n] + after[:, 1:] * _INVERSE
    replaced = (whole - terms)[:, :, None] + letters[None, None] * powers[None, :n, None]
    inserted = (before + after * _BASE)[:, :, None] + letters[None, None] * powers[None, :, None]
    return np.concatenate([whole, deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], 1)


def _by_length(words: pa.Array, limit: int):
    """(rows, matrix of code points) per length, in parts of about ``limit`` letters."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        step = max(1, limit // n)
        for a in range(0, len(rows), step):
            own = rows[a:a + step]
            codes = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le"), np.uint32)
            yield own, codes.astype(np.uint64).reshape(len(own), n)


def slots(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) % np.uint64(SLOTS)).astype(np.int64)


def with_keys(words: DataFrame) -> DataFrame:
    """Add ``coarse`` and ``fine``, the keys of each word under the small and the full alphabet, and their slots."""
    names = ["coarse", "fine", "coarse_slot", "fine_slot"]

    def run(batches):
        for batch in batches:
            keys = np.zeros((2, batch.num_rows), np.uint64)
            for rows, codes in _by_length(batch.column("word"), KEYS):
                keys[0, rows], keys[1, rows] = own_keys(codes, SYMBOLS), own_keys(codes, None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys.view(np.int64)), *map(pa.array, slots(keys))], [*batch.schema.names, *names])

    return words.mapInArrow(run, "id long, word string, n long, " + ", ".join(f"{c} long" for c in names))


def key_map(known: DataFrame, slot: str) -> np.ndarray:
    """The bits of the slots in use; ``SLOTS`` / 8 bytes, whatever the rows."""
    rows = known.groupBy(F.floor(F.col(slot) / _MAP_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col(slot) % _MAP_BITS).alias("bits"))
    found = np.zeros((SLOTS // _MAP_BITS, _MAP_BITS // 8), np.uint8)
    for row in rows.toLocalIterator():
        found[row.part] = np.frombuffer(row.bits, np.uint8)
    return found.reshape(-1)


def neighbourhoods(words: DataFrame, symbols: int | None, known: np.ndarray) -> DataFrame:
    """(id, hot, key): each distinct key of the neighbourhood of each word (id, word, hot) whose slot is in use."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        bits = shared.value
        fan = 2 * len(np.unique(reduced(ALPHABET, symbols))) + 1
        for batch in batches:
            ids, hot = batch.column("id").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)
            for rows, codes in _by_length(batch.column("word"), max(1, KEYS // fan)):
                keys = neighbour_keys(codes, symbols)
                at = slots(keys)
                row, place = np.nonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1))
                key = keys[row, place].view(np.int64)
                order = np.lexsort([key, row])
                row, key = row[order], key[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                of = rows[row[first]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(hot[of]), pa.array(key[first])], ["id", "hot", "key"])

    return words.select("id", "word", "hot").mapInArrow(run, "id long, hot boolean, key long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, near, near_n): all ordered pairs of words (id, word, n) that are one edit apart."""
    keyed = with_keys(words.select("id", "word", "n"))
    sizes = keyed.groupBy("coarse").agg((F.count("*") > BUCKET).alias("hot"))
    known = materialize(keyed.join(sizes, "coarse"))
    asked = materialize(neighbourhoods(known.filter(~F.col("hot")), SYMBOLS, key_map(known, "coarse_slot")))
    member = known.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("hot").alias("near_hot"), "coarse", "fine")
    coarse = asked.join(member.filter(~F.col("near_hot")), F.col("key") == F.col("coarse")).select("id", "near_id", "near", "near_n")
    # Words that meet a crowded form, and those that have one, ask letter by letter.
    crowded = sizes.filter("hot").select(F.col("coarse").alias("key"))
    beside = asked.join(crowded, "key", "left_semi").select("id").distinct()
    askers = known.filter("hot").unionByName(known.join(beside, "id", "left_semi").select(*known.columns))
    fine = neighbourhoods(askers, None, key_map(known, "fine_slot")).join(member, F.col("key") == F.col("fine")).filter(F.col("hot") | F.col("near_hot"))
    pairs = coarse.unionByName(fine.select("id", "near_id", "near", "near_n")).filter(F.col("id") != F.col("near_id"))
    found = pairs.join(words.select("id", "word"), "id")
    return found.filter(F.levenshtein("word", "near", 1) == 1).select("id", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word reached by following forms; they must not run in circles."""
    reached = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(ahead, "root", "left")
        after = materialize(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, one_in: int = 97, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text)."""
    counted = vocabulary(docs, min_length, min_count, one_in)
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    found = words.join(near, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    found = materialize(found)
    return found.join(roots(found.filter(F.col("form").isNotNull())), "word", "left").withColumn("root", F.coalesce("root", "word"))
