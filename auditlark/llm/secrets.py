r"""Secret scans in DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. The method
adds high-entropy spans: over every candidate string (a run of base64 characters
with a digit and a letter) a window slides one character at a time, and the sum
of n * log2(n) over the window's character counts is updated for the character
that enters and the one that leaves, so a window costs one step. Candidates are
measured on the alphabet of their class (hexadecimal or base64), each with its own
threshold; windows above it merge into spans. Left out are candidates of an allowed
form (identifiers in the usual dashed form, digests named as such), the windows that touch
a placeholder or a long run of one character (a secret beside one is found), and spans
inside a base span.

Positions come from the pieces between matches: Java's ``split`` and
``regexp_extract_all`` use the same leftmost non-overlapping matches, so running
sums of lengths give code-point offsets and no marker is put into the text.

Defined results: null and empty texts have no spans; the same text gives the
same spans on every row; columns of the input are kept, a clashing ``spans`` or
``base`` column is replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base rules, and the kinds in the order that breaks ties of position.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# A run is a match as a whole, so a lower bound on its length drops the same ones.
_RULES = {"assign": ASSIGN, "access": ACCESS.replace("+", "{12,}"), "hex": HEX.replace("+", "{32,}")}
_MATCHES = {kind: f"_{kind}_matches" for kind in ("assign", "access", "hex", "candidate")}

CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
#: Characters of a window, and bits per character that a window must exceed.
WINDOW = 24
HEX_BITS, BASE64_BITS = 3.0, 3.8
HEX_ALPHABET = "0123456789abcdef"
BASE64_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: The allow list in two parts: forms of a whole candidate, and words that excuse only the windows that touch them.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)-",
)
ALLOW_WORDS = r"(?i:example|placeholder|changeme|dummy|sample|redacted|your_?key)|(.)\1{7,}|0123456789|abcdefghij|ABCDEFGHIJ"

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
_CHUNK = 256


def _starts(lengths: Column) -> Column:
    """Exclusive running sums of a non-empty array of longs, in chunks so that long arrays stay near-linear."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def scan(values, base):
        state = F.struct(base.alias("total"), none.alias("out"))
        step = lambda s, x: F.struct((s.total + x).alias("total"), F.concat(s.out, F.array(s.total)).alias("out"))
        return F.aggregate(values, state, step, lambda s: s.out)

    last = F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)))
    bases = scan(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.zip_with(chunks, bases, scan))


def matches(text: Column, found: Column, pattern: str) -> Column:
    """Array of (start, end, text) of ``found``, the leftmost non-overlapping matches of ``pattern`` in ``text``."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x).cast("long"))
    starts = F.zip_with(_starts(F.zip_with(gaps, found, lambda g, m: g + F.length(m))), gaps, lambda a, g: a + g)
    spans = F.zip_with(starts, found, lambda a, m: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("text")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>"))


def _ranked(spans: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda m: F.struct(m.start.alias("start"), rank.alias("rank"), m.end.alias("end"))).cast(_SPAN)


def _base_spans(text: Column) -> Column:
    """Spans of the base rules by start and kind, from the matches that ``scan`` has put beside ``text``."""
    assigned, access, hexes = (F.col(_MATCHES[kind]) for kind in KINDS[:3])
    # A match is consumed before its length is looked at, so the length is no part of the assignment pattern.
    whole = F.zip_with(
        matches(text, assigned, ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
        lambda m, v: F.struct(m.start.alias("start"), m.end.alias("end"), F.length(v).alias("n")),
    )
    long_enough = F.when(F.size(assigned) > 0, _ranked(F.filter(whole, lambda m: m.n >= 8), "assign")).otherwise(F.array().cast(_SPAN))
    rest = (_ranked(matches(text, found, _RULES[kind]), kind) for kind, found in (("access", access), ("hex", hexes)))
    return F.array_sort(F.concat(long_enough, *rest))


def window_spans(text: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Merged (first, last) ranges of the windows of ``text`` whose entropy exceeds ``bits``.

    ``last`` is exclusive and counts from the candidate's own start. The fold walks
    an array of (entering, leaving) characters, which is made once, so each step costs the
    same however long the text.
    """
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    f = lambda n: F.element_at(weight, n + 1)
    # Characters outside the alphabet (- and _) share the first slot.
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.instr(F.lit(alphabet), c))
    none = F.array_repeat(F.lit(-1), window)
    moves = F.zip_with(codes(text), F.concat(none, codes(text)), lambda x, y: F.struct(x.alias("enter"), y.alias("leave")))
    moves = F.slice(moves, F.lit(1), F.length(text))
    span = "struct<a:int,b:int>"
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"),
        F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")).cast(span).alias("last"), F.array().cast(f"array<{span}>").alias("done"),
    )

    def step(s, m):
        i = s.i + 1
        n_in = F.element_at(s.counts, m.enter + 1)
        n_out = F.when(m.leave >= 0, F.element_at(s.counts, F.greatest(m.leave, F.lit(0)) + 1)).otherwise(F.lit(0))
        moved = F.transform(s.counts, lambda n, k: n + (k == m.enter).cast("int") - (k == m.leave).cast("int"))
        change = f(n_in + 1) - f(n_in) + F.when(m.leave >= 0, f(n_out - 1) - f(n_out)).otherwise(0.0)
        total = s["sum"] + F.when(m.enter == m.leave, 0.0).otherwise(change)
        # A window at the very threshold is not above it, however its sum was rounded.
        high = (i >= window) & (F.lit(math.log2(window)) - total / window > bits + 1e-9)
        a = i - window
        joins = s["last"].b >= a
        fresh = high & ~joins
        last = F.struct(F.when(fresh, a).otherwise(s["last"].a).alias("a"), F.when(high, i).otherwise(s["last"].b).alias("b"))
        done = F.when(fresh & (s["last"].b >= 0), F.concat(s.done, F.array(s["last"]))).otherwise(s.done)
        return F.struct(moved.alias("counts"), total.alias("sum"), i.alias("i"), last.alias("last"), done.alias("done"))

    whole = lambda s: F.when(s["last"].b >= 0, F.concat(s.done, F.array(s["last"]))).otherwise(s.done)
    return F.aggregate(moves, start, step, whole)


def _pieces(candidate: Column, words: str) -> Column:
    """Array of (start, text): what lies between the matches of ``words``."""
    parts, found = F.split(candidate, words, -1), F.regexp_extract_all(candidate, F.lit(words), F.lit(0))
    gaps = F.transform(found, lambda w: F.length(w).cast("long"))
    lengths = F.zip_with(parts, gaps, lambda p, g: F.length(p) + F.coalesce(g, F.lit(0).cast("long")))
    return F.zip_with(_starts(lengths), parts, lambda a, p: F.struct(a.alias("start"), p.alias("text")))


def _entropy_spans(text: Column, allow: tuple[str, ...], words: str) -> Column:
    """Spans of both classes over the candidates of ``text``."""
    candidates = matches(text, F.col(_MATCHES["candidate"]), CANDIDATE)
    found = F.filter(candidates, lambda m: m.text.rlike("[0-9]") & m.text.rlike("[A-Za-z]") & ~_allowed(m.text, allow))

    def measured(m):
        low = window_spans(F.lower(m.text), HEX_ALPHABET, HEX_BITS)
        mixed = window_spans(m.text, BASE64_ALPHABET, BASE64_BITS)
        rank = F.when(m.is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.transform(
            F.when(m.is_hex, low).otherwise(mixed),
            lambda w: F.struct((m.start + w.a).alias("start"), rank.alias("rank"), (m.start + w.b).alias("end")),
        ).cast(_SPAN)

    # What lies between allowed words is measured on its own; a piece has the class of its whole candidate.
    cut = lambda m: F.transform(
        F.filter(_pieces(m.text, words), lambda p: F.length(p.text) >= WINDOW),
        lambda p: F.struct((m.start + p.start).alias("start"), p.text.alias("text"), m.text.rlike("^[0-9a-fA-F]+$").alias("is_hex")),
    )
    return F.flatten(F.transform(F.flatten(F.transform(found, cut)), measured))


def _allowed(candidate: Column, allow: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in allow:
        found = found | candidate.rlike(pattern)
    return found


def scan(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, words: str = ALLOW_WORDS) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (start, rank, end); rank points into ``KINDS``.

    A candidate that matches ``allow`` is left out whole; of one that holds a match of ``words``, only the windows that touch it.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rules = _RULES | {"candidate": CANDIDATE}
    # Matches are columns of their own: each pattern reads the text once, and only texts with matches go on.
    found = docs.withColumns({_MATCHES[k]: F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for k, p in rules.items()})
    found = found.withColumns({"base": _base_spans(whole), "spans": _entropy_spans(whole, allow, words)}).drop(*_MATCHES.values())
    inside = lambda e: F.exists("base", lambda b: (b.start <= e.start) & (b.end >= e.end))
    return found.withColumn("spans", F.array_sort(F.concat("base", F.filter("spans", lambda e: ~inside(e)))))


def digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s.start, s.end)), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, words: str = ALLOW_WORDS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``[kind]``; overlapping spans become one."""
    scanned = docs.select("*", F.struct(*[F.col(c) for c in docs.columns]).alias("_row")).select("_row", F.col(text))
    found = scan(scanned, text, allow, words)
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    state = F.struct(F.array().cast("array<string>").alias("parts"), F.coalesce(F.col(text), F.lit("")).alias("rest"), F.lit(0).cast("long").alias("at"))

    def step(s, e):
        fresh = e.start >= s["at"]  # else it overlaps the span before it, which only grows
        gap = F.greatest(e.start - s["at"], F.lit(0)).cast("int")
        taken = F.greatest(e.end - s["at"], F.lit(0)).cast("int")
        parts = F.when(fresh, F.concat(s.parts, F.array(s.rest.substr(F.lit(1), gap), F.element_at(kinds, e["rank"] + 1)))).otherwise(s.parts)
        return F.struct(parts.alias("parts"), s.rest.substr(taken + 1, F.length(s.rest)).alias("rest"), F.greatest(e.end, s["at"]).alias("at"))

    clean = F.aggregate("spans", state, step, lambda s: F.array_join(F.concat(s.parts, F.array(s.rest)), ""))
    out = F.when(F.size("spans") > 0, clean).otherwise(F.col(text)).alias(text)
    return found.select(*[out if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
