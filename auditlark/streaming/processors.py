"""Keyed state for unbounded input.

Every processor holds rows back until the watermark has passed them, so results
follow event time whatever the arrival order, and keeps only what later rows
can still need.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

US = 1_000_000

# Order key, tie-breaker, member (counted distinct) and value of a held row.
ROW = StructType(
    [
        StructField("ts_us", LongType()),
        StructField("event_id", LongType()),
        StructField("member", StringType()),
        StructField("value", StringType()),
    ]
)


# A row that waits, with its key.
WAITING = StructType([*ROW.fields, StructField("key", StringType())])

#: Most rows of a chunk.
CHUNK_ROWS = 512

# Key, first and last time of a chunk, its rows, and a number that tells equal ones apart.
CHUNK = StructType([StructField("key", StringType()), *[StructField(c, LongType()) for c in ("first_us", "last_us", "n", "part")]])
KEY = StructType([StructField("key", StringType())])
NAMES = StructType([StructField("names", ArrayType(CHUNK))])


def rows_of(row: StructType) -> StructType:
    return StructType([StructField("rows", ArrayType(row))])


class Chunks:
    """Rows in chunks that follow their times.

    A call to the state moves a whole chunk, so the calls grow with the chunks and not
    with the rows. New rows join a chunk that is less than half full, if there is one; what they
    rewrite is bounded, and so is the number of small chunks.
    """

    def __init__(self, state) -> None:
        self.state = state

    def names(self) -> list[tuple]:
        """Name of each chunk, the earliest first."""
        return sorted((tuple(k) for k in self.state.keys()), key=lambda c: c[1:])

    def read(self, name: tuple) -> list[tuple]:
        return [tuple(r) for r in self.state.getValue(name)[0]]

    def _pop(self, name: tuple) -> list[tuple]:
        rows = self.read(name)
        self.state.removeKey(name)
        return rows

    def add(self, rows: list[tuple], names: list[tuple], key: str | None = "") -> list[tuple]:
        """Add rows beside the chunks ``names`` of the key; returns the new names."""
        known = set(names)
        for small in [c for c in names if c[3] < CHUNK_ROWS // 2]:
            rows = rows + self._pop(small)
            known.discard(small)
        rows = sorted(rows, key=lambda r: r[:2])
        for i in range(0, len(rows), CHUNK_ROWS):
            own = rows[i:i + CHUNK_ROWS]
            name = (key, own[0][0], own[-1][0], len(own), 0)
            while name in known:
                name = (*name[:4], name[4] + 1)
            known.add(name)
            self.state.updateValue(name, (own,))
        return sorted(known, key=lambda c: c[1:])

    def drop(self, before_us: int, names: list[tuple]) -> list[tuple]:
        """Remove the chunks that end before a time; returns the names of the others."""
        for name in names:
            if name[2] < before_us:
                self.state.removeKey(name)
        return [c for c in names if c[2] >= before_us]

    def take(self, before_us: int) -> tuple[list[tuple], int | None]:
        """Remove the rows before a time; returns them, and the earliest time left."""
        names = self.names()
        passed = [c for c in names if c[1] < before_us]
        rows = [r for name in passed for r in self._pop(name)]
        left = names[len(passed):]
        if rest := [r for r in rows if r[0] >= before_us]:
            left = self.add(rest, left)
        return [r for r in rows if r[0] < before_us], left[0][1] if left else None


class Windows:
    """The rows of each key's window; only the keys that get rows are read or written."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = Chunks(handle.getMapState("window", CHUNK, rows_of(ROW)))
        self.held = handle.getMapState("held", KEY, NAMES)

    def rows(self, key: str | None, since_us: int) -> tuple[list[tuple], list[tuple] | None]:
        """The rows from a time on in order, and the key's chunks (None for a key never seen)."""
        found = self.held.getValue((key,))
        if found is None:
            return [], None
        names = [tuple(c) for c in found[0]]
        return sorted(r for c in names for r in self.chunks.read(c) if r[0] >= since_us), names

    def update(self, key: str | None, names: list[tuple] | None, since_us: int, rows: list[tuple]) -> None:
        """Add rows and remove chunks that end before a time."""
        names = self.chunks.drop(since_us, names or [])
        self.held.updateValue((key,), (self.chunks.add(rows, names, key) if rows else names,))


class OrderedProcessor(StatefulProcessor):
    """Releases rows of each key in (ts_us, event_id) order once the watermark is past them.

    A processor serves a share of the keys, whose rows wait together: what a batch costs in
    calls depends on the share's chunks, not on its keys. Memory is kept by key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = Chunks(handle.getMapState("pending", CHUNK, rows_of(WAITING)))
        self.memory = handle.getMapState("memory", KEY, rows_of(ROW))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.pending.names()
        first = names[0][1] if names else None
        earliest = math.inf
        for pdf in rows:
            new = list(zip(*(pdf[c].tolist() for c in WAITING.names)))
            names = self.pending.add(new, names)
            earliest = min(earliest, min(r[0] for r in new))
        if first is None or earliest < first:
            self.handle.registerTimer(int(earliest) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before_us = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = self.pending.take(before_us)
        if rest is not None:
            self.handle.registerTimer(rest // 1000 + 1)
        by_key: dict[str | None, list[tuple]] = {}
        for r in ready:
            by_key.setdefault(r[4], []).append(r[:4])
        out = [(own, *row) for own, rows in by_key.items() for row in self.released(own, sorted(rows))]
        self.settle(before_us)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def released(self, key: str | None, ready: list[tuple]) -> list[tuple]:
        found = self.memory.getValue((key,))
        out, memory = self.follow(key, [tuple(r) for r in found[0]] if found is not None else [], ready)
        self.memory.updateValue((key,), (memory,))
        return out

    def follow(self, key: str | None, memory: list[tuple], ready: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        raise NotImplementedError

    def settle(self, before_us: int) -> None:
        """After a release; no later row is older than the time."""

    def advance(self, memory: list[tuple], ready: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        """One key by itself."""
        out, memory = self.follow("", memory, ready)
        self.settle(ready[-1][0])
        return pd.DataFrame(out, columns=self.columns[1:]), memory

    def close(self) -> None:
        pass


class SlidingWindow(OrderedProcessor):
    """Rows and distinct members in the window that ends at each row."""

    columns = ["key", "event_id", "ts_us", "n", "n_distinct", "first_us"]

    def __init__(
        self, window_s: int, min_rows: int, min_distinct: int = 0, fire_from_us: int = 0, max_per_member: int | None = None
    ) -> None:
        self.window_us = window_s * US
        self.min_rows = min_rows
        self.min_distinct = min_distinct
        self.fire_from_us = fire_from_us
        self.max_per_member = max_per_member

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = Windows(handle)

    def released(self, key, ready):
        """Rows stay in the window's chunks until it has passed them."""
        held, names = self.window.rows(key, ready[0][0] - self.window_us)
        out, kept = self.follow(key, held, ready)
        self.window.update(key, names, kept[0][0], [r for r in ready if r[0] >= kept[0][0]])
        return out

    def follow(self, key, memory, ready):
        rows = memory + ready
        counts: dict[str, int] = {}
        for r in memory:
            counts[r[2]] = counts.get(r[2], 0) + 1
        limit = math.inf if self.max_per_member is None else self.max_per_member
        crowded = sum(n > limit for n in counts.values())  # members with more rows than allowed
        start, out, i = 0, [], len(memory)
        while i < len(rows):
            now = rows[i][0]
            peers = i
            # Rows of the same instant see each other.
            while peers < len(rows) and rows[peers][0] == now:
                counts[rows[peers][2]] = counts.get(rows[peers][2], 0) + 1
                crowded += counts[rows[peers][2]] == limit + 1
                peers += 1
            while rows[start][0] < now - self.window_us:
                crowded -= counts[rows[start][2]] == limit + 1
                counts[rows[start][2]] -= 1
                if not counts[rows[start][2]]:
                    del counts[rows[start][2]]
                start += 1
            n = peers - start
            if n >= self.min_rows and len(counts) >= self.min_distinct and now >= self.fire_from_us and not crowded:
                out += [(rows[j][1], now, n, len(counts), rows[start][0]) for j in range(i, peers)]
            i = peers
        return out, rows[start:]


TEXT = StructType([*KEY.fields, StructField("text", StringType())])
TIME = StructType([StructField("ts_us", LongType())])
COUNTS = StructType([StructField("counts", ArrayType(LongType()))])


class Cached:
    """Names and times of a key in a map state, each read once and written once however many rows ask for it.

    A key that is ``new`` has nothing there to read.
    """

    def __init__(self, state, key: str | None, new: bool) -> None:
        self.state, self.key, self.new = state, key, new
        self.known: dict[str, int | None] = {}
        self.changed: set[str] = set()

    def get(self, name: str) -> int | None:
        if name not in self.known:
            found = None if self.new else self.state.getValue((self.key, name))
            self.known[name] = found[0] if found is not None else None
        return self.known[name]

    def put(self, name: str, time: int) -> None:
        self.known[name] = time
        self.changed.add(name)

    def write(self) -> None:
        for name in sorted(self.changed):
            self.state.updateValue((self.key, name), (self.known[name],))


class SiteBlocks(OrderedProcessor):
    """The first time a source has enough hits on a site within the window.

    Each pattern text counts once per source, each request once per instant. Rows carry
    ``{"site", "kind", "text"}``; the state is a window in chunks, the texts seen and the sites blocked.
    """

    columns = ["key", "event_id", "ts_us", "site", "hits"]

    def __init__(self, window_s: int, threshold: int) -> None:
        self.window_us, self.threshold = window_s * US, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = Windows(handle)
        self.seen = handle.getMapState("seen", TEXT, TIME)
        self.blocked = handle.getMapState("blocked", TEXT, TIME)

    def released(self, key, ready):
        held, names = self.window.rows(key, ready[0][0] - self.window_us)
        recent: dict[str, deque] = {}
        for r in held:
            recent.setdefault(r[2], deque()).append(r[0])
        seen, blocked = Cached(self.seen, key, names is None), Cached(self.blocked, key, names is None)
        out, kept = [], []
        for now, peers in groupby(ready, key=lambda r: r[0]):
            first: dict[str, int] = {}
            instant: set[tuple[str, str]] = set()
            for r in peers:
                hit = json.loads(r[3])
                same = (hit["kind"], hit["text"])
                if same in instant or (hit["kind"] == "pattern" and seen.get(hit["text"]) is not None):
                    continue
                instant.add(same)
                if hit["kind"] == "pattern":
                    seen.put(hit["text"], now)
                if hit.get("site") is not None:
                    first.setdefault(hit["site"], r[1])
                    recent.setdefault(hit["site"], deque()).append(now)
                    kept.append((now, r[1], hit["site"], ""))
            for site, event_id in first.items():
                hits = recent[site]
                while hits[0] < now - self.window_us:
                    hits.popleft()
                if len(hits) >= self.threshold and blocked.get(site) is None:
                    blocked.put(site, now)
                    out.append((event_id, now, site, len(hits)))
        seen.write()
        blocked.write()
        since = ready[-1][0] - self.window_us
        self.window.update(key, names, since, [r for r in kept if r[0] >= since])
        return out


class EwmaSpikes(OrderedProcessor):
    """Running mean and deviation of a key; state is one row a key whatever the history."""

    columns = ["key", "event_id", "ts_us", "n_sample", "z", "spike"]

    def __init__(self, alpha: float = 0.3, threshold: float = 3.0, warmup: int = 10) -> None:
        self.alpha, self.threshold, self.warmup = alpha, threshold, warmup

    def follow(self, key, memory, ready):
        n, mean, var = 0, 0.0, 0.0
        if memory:
            mean, var = (float.fromhex(v) for v in memory[0][3].split())
            n = memory[0][1]
        out = []
        for ts_us, event_id, _, value in ready:
            x = float(value)
            n += 1
            if n == 1:
                z, mean = 0.0, x
            else:
                dev = x - mean
                z = dev / max(math.sqrt(var), 0.05 * abs(mean) if mean != 0 else 1e-6)
                mean, var = self.alpha * x + (1 - self.alpha) * mean, self.alpha * dev * dev + (1 - self.alpha) * var
            out.append((event_id, ts_us, n, z, n > self.warmup and z >= self.threshold))
        state = [(ready[-1][0], n, "", f"{mean.hex()} {var.hex()}")]
        return out, state


class SuppressRepeats(OrderedProcessor):
    """sent / deduped per alert; the state is the second of the last sent alert."""

    columns = ["key", "event_id", "ts_us", "status"]

    def __init__(self, window_s: int = 900) -> None:
        self.window_s = window_s

    def follow(self, key, memory, ready):
        sent_at = memory[0][0] if memory else None
        out = []
        for ts_us, event_id, _, _ in ready:
            second = ts_us // US
            send = sent_at is None or second - sent_at > self.window_s
            sent_at = second if send else sent_at
            out.append((event_id, ts_us, "sent" if send else "deduped"))
        return out, [(sent_at, 0, "", "")]


class UserRisk(OrderedProcessor):
    """Risk of each authentication event from what the user did before.

    Known sources and hosts lie in map states with the time they were last seen; one
    not seen for ``keep_s`` of event time is unknown again, and a sweep removes it. Hours are one
    entry of 24 counts; the last attempts and event times are a bounded list.
    """

    columns = ["key", "event_id", "ts_us", "logins", "score", "factors"]

    def __init__(
        self, weights: dict[str, float], min_logins: int, attempt_span: int, event_span: int, burst_s: int, keep_s: int = 365 * 86_400
    ) -> None:
        self.weights, self.min_logins = weights, min_logins
        self.attempt_span, self.event_span, self.burst_us = attempt_span, event_span, burst_s * US
        self.keep_us = keep_s * US
        self.due = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ips = handle.getMapState("ips", TEXT, TIME)
        self.hosts = handle.getMapState("hosts", TEXT, TIME)
        self.hours = handle.getMapState("hours", KEY, COUNTS)

    def _known(self, names: Cached, name: str, now: int) -> bool:
        seen = names.get(name)
        return seen is not None and seen >= now - self.keep_us

    def _sweep(self, now: int) -> None:
        for state in (self.ips, self.hosts):
            for name in [tuple(k) for k, v in state.iterator() if v[0] < now - self.keep_us]:
                state.removeKey(name)

    def settle(self, before_us):
        if self.due:
            self._sweep(before_us)
            self.due = False

    def follow(self, key, memory, ready):
        # Logins so far and the last sweep, then attempts, then event times.
        n, swept = (memory[0][1], memory[0][0]) if memory else (0, ready[0][0])
        fails = deque((r[1] for r in memory if r[2] == "attempt"), maxlen=self.attempt_span)
        times = deque((r[0] for r in memory if r[2] == "time"), maxlen=self.event_span)
        ips, hosts = Cached(self.ips, key, not memory), Cached(self.hosts, key, not memory)
        found = self.hours.getValue((key,)) if memory else None
        hours = list(found[0]) if found is not None else [0] * 24
        out = []
        for ts_us, event_id, _, value in ready:
            event = json.loads(value)
            hour = ts_us // (3600 * US) % 24
            kind, ip, host = event["event"], event["src_ip"], event["host"]
            if kind in ("AUTH_OK", "AUTH_FAIL"):
                known = self._known(ips, ip, ts_us), self._known(hosts, host, ts_us)
                found = self.factors(n, ts_us, ip, host, hours[hour], *known, fails, times)
                score = min(100.0, sum(found.values()))
                out.append((event_id, ts_us, n, score, ",".join(found)))
            times.append(ts_us)
            if kind == "AUTH_OK":
                ips.put(ip, ts_us)
                hosts.put(host, ts_us)
                hours[hour] += 1
                n += 1
            if kind in ("AUTH_OK", "AUTH_FAIL"):
                fails.append(int(kind == "AUTH_FAIL"))
        ips.write()
        hosts.write()
        self.hours.updateValue((key,), (hours,))
        if ready[-1][0] - swept > self.keep_us // 8:
            swept, self.due = ready[-1][0], True
        kept = [(swept, n, "logins", ""), *[(0, f, "attempt", "") for f in fails], *[(t, 0, "time", "") for t in times]]
        return out, kept

    def factors(self, n, now, ip, host, in_hour, ip_known, host_known, fails, times) -> dict[str, float]:
        found: dict[str, float] = {}
        if n < self.min_logins:
            return found
        if not ip_known and ip != "0.0.0.0":
            found["new_ip"] = self.weights["new_ip"]
        if in_hour / n < 0.10:
            found["off_hours"] = self.weights["off_hours"]
        if len(fails) >= 5 and sum(fails) / len(fails) >= 0.5:
            found["failures"] = self.weights["failures"] * sum(fails) / len(fails)
        if len(times) >= 10:
            recent = sum(t >= now - self.burst_us for t in times)
            minutes = max(1.0, (times[-1] - times[0]) / (60 * US))
            if recent >= 10 and recent / 10.0 > 5 * len(times) / minutes:
                found["burst"] = self.weights["burst"]
        if not host_known and host != "-":
            found["new_host"] = self.weights["new_host"]
        return found
