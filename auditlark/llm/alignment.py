"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes; the offsets where both end a token cut them into
groups. A fragment describes any byte range of a document: the tokens up to its first
common end (they close a group that an earlier range may have opened), the closed
groups, and the tokens after its last common end, which a later range closes. Two
neighbouring fragments compose into one, and composition is associative, so the
ranges of a long document are read by different tasks and reduced as a tree.

A range may end anywhere, also inside a token: its tokens are those that end in it.
Its task gets the text from the last break before the range to the first break
after it. A break is a blank or a line end after a character that is neither; no token of
either vocabulary crosses one (checked when they are loaded), so the text between
two breaks has the same tokens alone as within its document. Such units are encoded
once, many as one text, and remembered by the task.

Every elementary interval between neighbouring token ends is one link, a pair of
tokens that overlap. Pair counts are taken per block of links (a few million) and
added over the corpus; the counts of its own pairs then return to each block, where they become
sums per unit and per document. Only distinct pairs per block are shuffled, never
single links: a pair, however frequent, has one row per block.

Defined results: texts that are null or empty, or whose tokens of either kind do not
spell a blank and the text, have no tokens: zeros and an empty digest. Ids may
be null or repeat: each row is a document of its own. Texts of any length; a unit
without a break is one task's. Extra columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.session import materialize

from .bpe import byte_symbols
from .texts import tidy

#: Bytes of a range, fragments composed at once, links of a block, units a task remembers, longest remembered unit, characters of texts read at once,
#: characters of units encoded as one text, such texts encoded at once.
CHUNK = 1 << 16
FAN = 16
BLOCK_LINKS = 1 << 22
CACHE_UNITS = 300_000
CACHED_LENGTH = 64
SLICE_CHARS = 1 << 19
JOINED_CHARS = 1 << 13
JOINED = 16

#: A blank or line end with all white space and the word behind it, up to the next break.
_UNIT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_SHIFT = 16
_DECIMALS = list(map(str, range(1 << _SHIFT)))


def default_paths() -> tuple[str, str]:
    """The public byte-level and piece vocabularies that are installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Tokens:
    """Of neighbouring units: whether both tokenizers spell them, the ids of those that are valid, how many each has, bytes."""

    valid: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    lengths: np.ndarray


class Encoders:
    """Both tokenizers of a task and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        # Spark's tasks are the parallel part.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        of = {c: i for i, c in enumerate(byte_symbols())}
        n = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self._piece(p) for p in pieces]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_file}: pieces that cross a break")
        if n > 1 << _SHIFT or len(pieces) > 1 << 15:
            raise ValueError("vocabularies too large for packed pairs")

    @staticmethod
    def _piece(piece: str) -> bytes:
        found = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def encode(self, units: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[int]], np.ndarray]:
        """(valid, ids of A, ids of B, bytes) of texts that start with a break; valid where both spell the text."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # A line end in front takes the blank that the model adds; it stays a token of its own.
        b = [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]
        raw = [u.encode() for u in units]
        spelt = zip(raw, (b"".join([self.a_bytes[i] for i in x]) for x in a), (b"".join([self.b_bytes[i] for i in x]) for x in b))
        return np.array([t == x == y for t, x, y in spelt], bool), a, b, np.array([len(t) for t in raw], np.int64)

    def tokens(self, units: list[str]) -> Tokens:
        """The tokens of texts that start with a break; those that neighbours may follow are encoded as one text."""
        cuts, size = [0], 0
        for i, unit in enumerate(units, 1):
            size += len(unit)
            if size >= JOINED_CHARS or unit[-1].isspace():
                cuts.append(i)
                size = 0
        if size:
            cuts.append(len(units))
        found: list[Tokens] = []
        for k in range(0, len(cuts) - 1, JOINED):
            own = [units[i:j] for i, j in zip(cuts[k:k + JOINED], cuts[k + 1:k + JOINED + 1])]
            texts = ["".join(p) for p in own]
            a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            b = self.b.encode(["\n" + t for t in texts], num_threads=1)
            found += [self._apart(*p) for p in zip(own, texts, a, b)]
        return Tokens(*(np.concatenate([getattr(t, f.name) for t in found]) if found else np.zeros(0, np.int64) for f in fields(Tokens)))

    def _apart(self, units: list[str], text: str, a: list[int], b: list[int]) -> Tokens:
        """The tokens of each unit from those of the units as one text; where these do not spell it, each is encoded by itself."""
        del b[:2]
        raw = text.encode()
        stops = np.cumsum(np.fromiter(map(len, units if len(raw) == len(text) else map(str.encode, units)), np.int64, len(units)))
        ids, sizes = [], []
        for own, spelt, lengths in ((a, self.a_bytes, self.a_lengths), (b, self.b_bytes, self.b_lengths)):
            if b"".join([spelt[i] for i in own]) == raw:
                x = np.array(own, np.int64)
                ends = np.cumsum(lengths[x])
                at = np.searchsorted(ends, stops, side="right")
                if (ends[at - 1] == stops).all():
                    ids.append(x)
                    sizes.append(np.diff(at, prepend=0))
        if len(ids) == 2:
            return Tokens(np.ones(len(units), bool), *ids, *sizes, np.diff(stops, prepend=0))
        valid, *lists, lengths = self.encode(units)
        lists = [[x if ok else [] for x, ok in zip(own, valid)] for own in lists]
        ids = [np.fromiter(chain.from_iterable(own), np.int64) for own in lists]
        return Tokens(valid, *ids, *(np.fromiter(map(len, own), np.int64, len(units)) for own in lists), lengths)

    def ends(self, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their byte ends, ids of B, their byte ends) of neighbouring texts."""
        x, y = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        return x, np.cumsum(self.a_lengths[x]), y, np.cumsum(self.b_lengths[y])


@dataclass
class Aligned:
    """Groups and links of tokens that start and end together: where they end, the groups as text, the linked pairs."""

    common: np.ndarray
    groups: list[str]
    ends: np.ndarray
    pairs: np.ndarray


def aligned(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Aligned:
    first = min(a_ends[0], b_ends[0])
    marked = np.zeros(max(a_ends[-1], b_ends[-1]) - first + 1, bool)
    marked[a_ends - first] = marked[b_ends - first] = True
    ends = np.flatnonzero(marked) + first
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = (a_ends[i] == ends) & (b_ends[j] == ends)
    names = []
    for ids, at in ((a, i), (b, j)):
        shown, cut = list(map(_DECIMALS.__getitem__, ids.tolist())), [0, *(at[shared] + 1).tolist()]
        names.append([shown[x] if y - x == 1 else ",".join(shown[x:y]) for x, y in zip(cut, cut[1:])])
    return Aligned(ends[shared], [f"{x}|{y}" for x, y in zip(*names)], ends, (b[j] << _SHIFT | a[i]).astype(np.int32))


def closed(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[str, int, np.ndarray]:
    """(groups as text, their number, linked pairs)."""
    found = aligned(a, a_ends, b, b_ends)
    return ";".join(found.groups), len(found.groups), found.pairs


_NONE = np.zeros(0, np.int64)


@dataclass
class Fragment:
    """A byte range of a document.

    Without a common end inside, all tokens are in ``head`` and ``cut`` is false.
    Ends are byte offsets within the document.
    """

    head: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] = (_NONE, _NONE, _NONE, _NONE)
    cut: bool = False
    body: str = ""
    n_body: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    tail: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] = (_NONE, _NONE, _NONE, _NONE)
    n_a: int = 0
    n_b: int = 0
    valid: bool = True

    @classmethod
    def of(cls, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, valid: bool = True) -> Fragment:
        """The fragment of the tokens that end in a range."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return cls(head=(a, a_ends, b, b_ends), n_a=len(a), n_b=len(b), valid=valid)
        (i, k), (j, m) = (np.searchsorted(ends, common[[0, -1]]) + 1 for ends in (a_ends, b_ends))
        body, n, pairs = closed(a[i:k], a_ends[i:k], b[j:m], b_ends[j:m]) if k > i else ("", 0, cls().pairs)
        return cls((a[:i], a_ends[:i], b[:j], b_ends[:j]), True, body, n, pairs, (a[k:], a_ends[k:], b[m:], b_ends[m:]), len(a), len(b), valid)

    def then(self, other: Fragment) -> Fragment:
        """The fragment of this range and the next one."""
        n_a, n_b, valid = self.n_a + other.n_a, self.n_b + other.n_b, self.valid and other.valid
        open_ = tuple(np.concatenate(p) for p in zip(self.tail if self.cut else self.head, other.head))
        if not self.cut:
            return Fragment(open_, other.cut, other.body, other.n_body, other.pairs, other.tail, n_a, n_b, valid)
        if not other.cut:
            return Fragment(self.head, True, self.body, self.n_body, self.pairs, open_, n_a, n_b, valid)
        groups, n, pairs = closed(*open_) if len(open_[0]) else ("", 0, np.zeros(0, np.int32))
        body = ";".join(filter(None, (self.body, groups, other.body)))
        return Fragment(self.head, True, body, self.n_body + n + other.n_body, np.concatenate([self.pairs, pairs, other.pairs]), other.tail, n_a, n_b, valid)

    def finished(self) -> Fragment:
        """The whole document: its head is its first group."""
        if not self.cut:
            return self
        return Fragment(cut=True).then(self)

    def dump(self) -> bytes:
        numbers = np.array([self.cut, self.n_body, self.n_a, self.n_b, self.valid], np.int64)
        return _pack(*self.head, *self.tail, self.pairs, numbers, np.frombuffer(self.body.encode(), np.uint8))

    @classmethod
    def load(cls, data: bytes) -> Fragment:
        p = _unpack(data)
        cut, n_body, n_a, n_b, valid = p[9].tolist()
        return cls(tuple(p[:4]), bool(cut), p[10].tobytes().decode(), n_body, p[8], tuple(p[4:8]), n_a, n_b, bool(valid))


def cut_ranges(data: bytes, chunk: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(text between breaks, its offset, range start, range end) of the ranges of a long text that starts with a break.

    Borders lie at multiples of ``chunk``; of several in one unit the first one holds.
    """
    codes = np.frombuffer(data, np.uint8)
    gap = (codes[1:] == 32) | (codes[1:] == 10)
    at = np.concatenate([[0], np.flatnonzero(gap & (codes[:-1] > 32) & (codes[:-1] < 127)) + 1, [len(codes)]])
    borders, unit = [], -1
    for b in range(chunk, len(codes), chunk):
        own = int(np.searchsorted(at, b, side="right"))
        if own != unit:
            borders.append(b)
            unit = own
    for start, end in zip([0, *borders], [*borders, len(codes)]):
        first = int(at[np.searchsorted(at, start, side="right") - 1]) if start else 0
        last = int(at[np.searchsorted(at, end)]) if end < len(codes) else len(codes)
        yield data[first:last], first, start, end


class Blocks:
    """Rows of links, each of about ``BLOCK_LINKS``: distinct pairs with counts, and how units and documents are made of them."""

    def __init__(self, task: int):
        self.task, self.made = task, 0
        self.clear()

    def clear(self) -> None:
        self.rids: list[np.ndarray] = []
        self.n_units: list[np.ndarray] = []
        self.of_doc: list[np.ndarray] = []
        self.links = 0

    def add(self, rids: np.ndarray, n_units: np.ndarray, of_doc: np.ndarray, links: int) -> None:
        """Documents as runs of numbers of units."""
        self.rids.append(rids)
        self.n_units.append(n_units)
        self.of_doc.append(of_doc)
        self.links += links

    def row(self, flat: np.ndarray, starts: np.ndarray) -> list[dict]:
        """The block of what was added; unit u has the pairs ``flat[starts[u]:starts[u + 1]]``."""
        if not self.links:
            return []
        used, of_doc = np.unique(np.concatenate(self.of_doc), return_inverse=True)
        sizes = starts[used + 1] - starts[used]
        at = np.repeat(starts[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs, rank = np.unique(flat[at], return_inverse=True)
        times = np.bincount(of_doc, minlength=len(used))
        counts = np.bincount(rank, weights=np.repeat(times, sizes).astype(np.float64), minlength=len(pairs)).astype(np.int64)
        payload = _pack(np.concatenate(self.rids), np.concatenate(self.n_units), of_doc.astype(np.int32), sizes.astype(np.int32), rank.astype(np.int32))
        row = {"block": self.task << 24 | self.made, "payload": payload, "pairs": pairs, "counts": counts}
        self.made += 1
        self.clear()
        return [row]


def _pack(*parts: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *parts)
    data = out.getvalue()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    with np.load(io.BytesIO(raw)) as parts:
        return [parts[name] for name in parts.files]


class Reader:
    """Encodes texts of a task and remembers the units it has met; unit 0 stands for those that are not valid."""

    def __init__(self, encoders: Encoders, task: int):
        self.encoders, self.blocks = encoders, Blocks(task)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups = [""]
        # Tokens of A and B, groups, and end of the pairs of each unit.
        self.sizes = np.zeros((4, 1), np.int64)
        self.flat: list[np.ndarray] = []

    def block(self) -> list[dict]:
        return self.blocks.row(np.concatenate([*self.flat, np.zeros(0, np.int32)]), np.concatenate([[0], self.sizes[3]]))

    def learn(self, units: list[str]) -> None:
        t = self.encoders.tokens(units)
        self.known |= dict.fromkeys((u for u, ok in zip(units, t.valid) if not ok), 0)
        names = units if t.valid.all() else [u for u, ok in zip(units, t.valid) if ok]
        if not names:
            return
        ends = np.cumsum(t.lengths[t.valid])
        found = aligned(t.a, np.cumsum(self.encoders.a_lengths[t.a]), t.b, np.cumsum(self.encoders.b_lengths[t.b]))
        cut = np.searchsorted(found.common, ends, side="right")
        links = np.searchsorted(found.ends, ends, side="right")
        self.known |= zip(names, range(len(self.groups), len(self.groups) + len(names)))
        self.groups += [";".join(found.groups[x:y]) for x, y in zip([0, *cut.tolist()], cut.tolist())]
        size = np.array([t.n_a[t.valid], t.n_b[t.valid], np.diff(cut, prepend=0), self.sizes[3, -1] + links])
        self.sizes = np.concatenate([self.sizes, size], 1)
        self.flat.append(found.pairs)

    def read(self, rows: list[dict]) -> list[dict]:
        """Result rows of whole documents and fragments of parts, and blocks that are complete."""
        parts = [self.part(r) for r in rows if r["part"] is not None]
        rows = [r for r in rows if r["part"] is None]
        found = [_UNIT.findall(" " + r["text"]) if r["text"] else [] for r in rows]
        known = self.known
        met = set(chain.from_iterable(found))
        new = list(met.difference(known))
        out = []
        if len(known) + len(new) > CACHE_UNITS:
            out = self.block()
            self.forget()
            known = self.known
            new = list(met)
        self.learn(new)
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = list(map(known.__getitem__, chain.from_iterable(found)))
        flat = np.array(at, np.int64)
        first = np.cumsum(n) - n
        total = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(self.sizes[:3, flat], 1)], 1)
        n_a, n_b, n_groups = total[:, first + n] - total[:, first]
        broken = np.concatenate([[0], np.cumsum(flat == 0)])
        ok = (n > 0) & (broken[first + n] == broken[first])
        name = self.groups.__getitem__
        for r, i, d, good, x, y, z in zip(rows, first.tolist(), n.tolist(), ok.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist()):
            own = {"n_a": x, "n_b": y, "n_groups": z, "groups_sha256": _digest(";".join(map(name, at[i:i + d])))} if good else _EMPTY
            out.append({"rid": r["rid"], "doc_id": r["doc_id"]} | own)
        rids = np.array([r["rid"] for r in rows], np.int64)
        self.blocks.add(rids[ok], n[ok], flat[np.repeat(ok, n)], int((n_a + n_b - n_groups)[ok].sum()))
        if self.blocks.links >= BLOCK_LINKS:
            out += self.block()
        for u in new:
            if len(u) > CACHED_LENGTH:
                del known[u]  # hardly comes again
        return out + parts

    def part(self, row: dict) -> dict:
        """The fragment of a range, from the units around it."""
        valid, a, b, _ = self.encoders.encode(_UNIT.findall(row["text"]))
        whole = Fragment(valid=False)
        if valid.all():
            x, x_ends, y, y_ends = self.encoders.ends(a, b)
            keep = [(e + row["first"] > row["start"]) & (e + row["first"] <= row["stop"]) for e in (x_ends, y_ends)]
            whole = Fragment.of(x[keep[0]], x_ends[keep[0]] + row["first"], y[keep[1]], y_ends[keep[1]] + row["first"])
        return {"rid": row["rid"], "doc_id": row["doc_id"], "part": row["part"], "fragment": whole.dump()}


_EMPTY = {"n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""}
_ROWS = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("fragment", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("block", pa.int64()), ("payload", pa.binary()), ("pairs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])
_DDL = (
    "rid long, doc_id long, part long, fragment binary, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "block long, payload binary, pairs array<int>, counts array<long>"
)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def read_texts(chunks: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Rows of three kinds: whole documents, fragments of parts of documents (``fragment``), blocks of links (``block``).

    ``chunks`` has (rid, doc_id, part, text, first, start, stop); a whole document has a null part.
    """
    def run(batches):
        reader = Reader(Encoders(*files), TaskContext.get().partitionId())
        for batch in batches:
            for rows in _slices(batch):
                yield pa.RecordBatch.from_pylist(reader.read(rows), _ROWS)
        yield pa.RecordBatch.from_pylist(reader.block(), _ROWS)

    return chunks.select("rid", "doc_id", "part", "text", "first", "start", "stop").mapInArrow(tidy(run), _DDL)


def _slices(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    rows, size = [], 0
    for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
        rows.append(row)
        size += len(row["text"] or "")
        if size >= SLICE_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def compose(fragments: DataFrame, levels: int) -> DataFrame:
    """(rid, doc_id, part 0, fragment) of whole documents: neighbours are composed ``FAN`` at a time, level by level."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        whole = Fragment()
        for data in rows["fragment"]:
            whole = whole.then(Fragment.load(data))
        return pd.DataFrame({"rid": rows["rid"].iloc[:1], "doc_id": pd.array(rows["doc_id"].iloc[:1], "Int64"), "part": [rows["part"].iloc[0] // FAN], "fragment": [whole.dump()]})

    for _ in range(levels):
        pages = fragments.withColumn("page", F.floor(F.col("part") / FAN)).groupBy("rid", "page")
        fragments = pages.applyInPandas(reduce, "rid long, doc_id long, part long, fragment binary")
    return fragments


def finish(composed: DataFrame) -> DataFrame:
    """Rows like those of ``read_texts`` for the composed documents: their results, and blocks of their links."""
    def run(batches):
        # Negative numbers keep these blocks apart from those of whole documents.
        blocks, flat, ends = Blocks(-1 - TaskContext.get().partitionId()), [], [0]

        def block() -> list[dict]:
            out = blocks.row(np.concatenate([*flat, np.zeros(0, np.int32)]), np.array(ends))
            flat.clear()
            del ends[1:]
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                whole = Fragment.load(row["fragment"]).finished()
                own = _EMPTY
                if whole.valid and whole.n_a:
                    # A document is one unit here.
                    blocks.add(np.array([row["rid"]]), np.array([1]), np.array([len(flat)]), len(whole.pairs))
                    flat.append(whole.pairs)
                    ends.append(ends[-1] + len(whole.pairs))
                    own = {"n_a": whole.n_a, "n_b": whole.n_b, "n_groups": whole.n_body, "groups_sha256": _digest(whole.body)}
                out = [{"rid": row["rid"], "doc_id": row["doc_id"]} | own]
                yield pa.RecordBatch.from_pylist(out + (block() if blocks.links >= BLOCK_LINKS else []), _ROWS)
        yield pa.RecordBatch.from_pylist(block(), _ROWS)

    return composed.select("rid", "doc_id", "fragment").mapInArrow(tidy(run), _DDL)


def cut_long(docs: DataFrame, chunk: int) -> DataFrame:
    """(rid, doc_id, part, text, first, start, stop): the ranges of each text, dealt over all tasks."""
    def run(batches):
        names = ["rid", "doc_id", "part", "text", "first", "start", "stop"]
        for batch in batches:
            for i in range(batch.num_rows):
                rid, doc_id, text = (batch.column(c)[i].as_py() for c in range(3))
                for part, (piece, first, start, stop) in enumerate(cut_ranges(b" " + text.encode(), chunk)):
                    row = (rid, doc_id, part, piece.decode(), first, start, stop)
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], pa.schema([(n, pa.string() if n == "text" else pa.int64()) for n in names]))

    ranges = docs.select("rid", "doc_id", "text").mapInArrow(tidy(run), "rid long, doc_id long, part long, text string, first long, start long, stop long")
    return ranges.repartition("rid", "part")


def pair_sums(blocks: DataFrame) -> DataFrame:
    """(rid, n_best, count_sum) from blocks of links: how often each pair is linked corpus-wide, and whether it leads its B id."""
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = own.groupBy("pair").agg(F.sum("n").alias("total"))
    # A B id is in at most as many pairs as there are A ids.
    most = total.groupBy(F.shiftright("pair", _SHIFT).alias("b")).agg(F.max("total").alias("most"))
    ranked = total.join(most, F.shiftright("pair", _SHIFT) == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = own.select("block", "place", "pair").join(ranked, "pair").select("block", "place", "total", "best")

    def run(counts: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        order = counts["place"].to_numpy().argsort()
        total, best = counts["total"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
        rids, n_units, of_doc, sizes, rank = _unpack(block["payload"].iloc[0])
        ends, doc_ends = np.cumsum(sizes), np.cumsum(n_units)
        out = {"rid": rids}
        for name, value in (("n_best", best), ("count_sum", total)):
            per_unit = np.diff(np.concatenate([[0], np.cumsum(value[rank])])[np.concatenate([[0], ends])])
            out[name] = np.diff(np.concatenate([[0], np.cumsum(per_unit[of_doc])])[np.concatenate([[0], doc_ends])])
        return pd.DataFrame(out)

    payload = blocks.select(F.col("block").alias("own"), "payload")
    return back.groupBy("block").cogroup(payload.groupBy("own")).applyInPandas(run, "rid long, n_best long, count_sum long")


def align(docs: DataFrame, files: tuple[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text)."""
    files = files or default_paths()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long_ = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    none = F.lit(None).cast("long")
    whole = numbered.filter(~long_).select("rid", "doc_id", none.alias("part"), "text", none.alias("first"), none.alias("start"), none.alias("stop"))
    read = materialize(read_texts(whole.unionByName(cut_long(numbered.filter(long_), chunk)), files))
    fragments = read.filter(F.col("part").isNotNull()).select("rid", "doc_id", "part", "fragment")
    parts, levels = fragments.agg(F.max("part")).first()[0], 1
    while parts is not None and FAN ** levels <= parts:
        levels += 1
    read = read.unionByName(materialize(finish(compose(fragments, levels))))
    results = read.filter(F.col("groups_sha256").isNotNull()).select("rid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    sums = pair_sums(read.filter(F.col("block").isNotNull()))
    found = results.join(sums, "rid", "left")
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
