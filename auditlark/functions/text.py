"""Column helpers for strings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text that are counted at once.
ENTROPY_SLICE = 1 << 20

SEPARATOR, ESCAPE, FOR_SEPARATOR, FOR_ESCAPE = "\x01", "\x02", "\x03", "\x04"

#: All characters that count as white space at the ends of a field.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """``text`` without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def lstrip(text: Column | str) -> Column:
    return F.ltrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column | str) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def regex_groups(text: Column, regex: str, groups: int) -> Column:
    """All groups of an expression anchored at both ends, in one pass over the text.

    An array of ``groups`` strings (empty where a group took no part), or null
    when the text does not match. A separator in the text itself is escaped by
    other control characters before the match and restored in each group.
    """
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + FOR_ESCAPE)), F.lit(SEPARATOR), F.lit(ESCAPE + FOR_SEPARATOR))
    joined = F.regexp_replace(escaped, regex, "".join(f"{SEPARATOR}${i}" for i in range(1, groups + 1)))
    parts = F.slice(F.split(joined, SEPARATOR, groups + 1), 2, groups)
    restored = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit(ESCAPE + FOR_SEPARATOR), F.lit(SEPARATOR)), F.lit(ESCAPE + FOR_ESCAPE), F.lit(ESCAPE))
    )
    return F.when(joined.startswith(SEPARATOR), F.when(joined.contains(ESCAPE), restored).otherwise(parts))


def _runs(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points of a slice of a text, and how often each occurs."""
    top = int(piece.max()) + 1
    if top <= 4 * len(piece) + 256:
        counts = np.bincount(piece, minlength=top)
        found = np.flatnonzero(counts)
        return found, counts[found]
    ordered = np.sort(piece)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(starts, append=len(ordered))


def text_entropy(text: str, slice_chars: int = ENTROPY_SLICE) -> float:
    """Bits per character; the partial counts of slices of bounded length are added."""
    if not text:
        return 0.0
    parts = [_runs(np.frombuffer(text[a:a + slice_chars].encode("utf-32-le"), np.uint32)) for a in range(0, len(text), slice_chars)]
    counts = parts[0][1]
    if len(parts) > 1:
        _, of = np.unique(np.concatenate([codes for codes, _ in parts]), return_inverse=True)
        counts = np.bincount(of, weights=np.concatenate([n for _, n in parts]))
    if len(counts) < 2:
        return 0.0
    return float(math.log2(len(text)) - (counts * np.log2(counts)).sum() / len(text))


@F.arrow_udf(T.DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    return pa.array([text_entropy(t.as_py() or "") for t in texts], pa.float64())


def shannon_entropy(text: Column) -> Column:
    """Bits per character of a text; 0 for null or empty text.

    One linear pass: characters are counted in arrays, a whole batch of texts per
    call, so neither the length nor the number of distinct characters multiplies.
    """
    return _entropy(text.cast("string"))


def mask_middle(value: Column) -> Column:
    """Keep two characters at both ends of values longer than four."""
    hidden = F.repeat(F.lit("•"), F.greatest(F.lit(0), F.length(value) - 4))
    return F.when(
        F.length(value) > 4, F.concat(F.substring(value, 1, 2), hidden, F.right(value, F.lit(2)))
    ).otherwise("••••")


def version_key(value: Column) -> Column:
    """Numeric parts of a version as an array, which compares part by part."""
    parts = F.transform(
        F.filter(F.split(strip(value), "[^0-9]+"), lambda p: p != ""), lambda p: p.cast("decimal(38,0)")
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))
