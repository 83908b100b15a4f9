"""Lines described by a user-supplied expression with named groups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip
from ..functions.times import coerce_us, iso_utc


def to_java(pattern: str) -> tuple[str, dict[str, int]]:
    """The expression with plain groups, and the number of each named group."""
    if not pattern or not pattern.strip():
        raise ValueError("an expression is needed")
    try:
        groups = dict(re.compile(pattern).groupindex)
    except re.error as exc:
        raise ValueError(f"the expression does not compile: {exc}") from exc
    plain = re.sub(r"\(\?P<[^>]+>", "(", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{groups[m.group(1)]}", plain), groups


def parse_regex_lines(lines: DataFrame, pattern: str, ingest_us: int, line: str = "line") -> DataFrame:
    """Matching lines as events; groups without a canonical name stay in ``regex_fields``."""
    plain, groups = to_java(pattern)
    text = F.col(line)
    rows = lines.where(text.rlike(plain))
    values = {name: F.nullif(F.regexp_extract(text, plain, i), F.lit("")) for name, i in groups.items()}

    named: dict[str, list] = {}
    for name, value in values.items():
        named.setdefault(R.REGEX_ALIASES.get(name.lower(), name.lower()), []).append(value)
    pairs = [F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in values.items()]
    fields = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    def canonical(name: str, default):
        return F.coalesce(*named.get(name, []), default)

    # The last usable time wins, as later groups overwrite earlier ones.
    ts_us = F.coalesce(*[coerce_us(v) for v in reversed(named.get("ts", []))], F.lit(ingest_us))
    return rows.select(
        *[c for c in lines.columns if c != line],
        ts_us.alias("ts_us"), iso_utc(ts_us).alias("iso"), F.lit("regex").alias("parsed"),
        canonical("event", F.lit("REGEX_LOG")).alias("event"),
        canonical("user", F.lit("-")).alias("user"),
        canonical("src_ip", F.lit("0.0.0.0")).alias("src_ip"),
        canonical("host", F.lit("-")).alias("host"),
        canonical("msg", F.substring(strip(text), 1, 400)).alias("msg"),
        fields.alias("regex_fields"),
    )
