"""Main-text extraction by wrappers: union-free regular expressions over page tokens.

Every page is read as a stream of tokens: containers that open and close, and
blocks of text. Streams of the same host are aligned one after the other. Where
two sequences agree, text becomes a slot; where they differ, neighbours that
repeat become a repeated group and the rest becomes optional. The result is one
expression without unions for each host: nested sequences of slots, optional and
repeated groups. A sequence longer than ``MAX_ITEMS`` is closed into one repeated
group of optional items, so an expression stays bounded on hosts without a template.

Alignment is associative enough to be a tree reduction: a task aligns the pages it
reads, then partial wrappers of a host meet ``FAN_IN`` at a time, so a host with
a third of all pages is never one group, and every page takes part.

Each container of a wrapper carries what its slots held over all pages: text,
link text, pages, and whether the text was the same on all of them. From that,
the host's content roots follow: ``article`` or ``main`` where the host has one, else the
container that holds most of the text that changes from page to page and is no link. Inside
the roots each page is matched against its host's wrapper: a slot of its own, no heading, whose text was
the same on at least ``SAME_PAGES`` pages and most pages of its container is a notice of the template and is
left out, unless nothing in the root changes from page to page. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are recognised by element and by class name, and left out.

Defined results: a null or empty page has an empty text; a page without its
host's content roots gives its whole body without the regions named above; pages
without a host share one wrapper; repeated rows give equal texts; pages of any
length are read whole; columns of the input are kept, a clashing ``text`` is replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlark.session import materialize

#: Items of a sequence before it is closed; partial wrappers that meet at once; hosts held by a task.
MAX_ITEMS = 48
FAN_IN = 64
HELD_HOSTS = 500
#: Depth beyond which containers count as their parent's content.
MAX_DEPTH = 24
#: Pages on which a slot must hold the same text before it counts as part of the template.
SAME_PAGES = 5

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^<>"'])*+"""
# An unquoted part of a tag ends at the next tag, so a tag that is never closed costs no more than its own length.
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|math|object)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"""
    rf"""|<[!?][^<>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9-]*)(?P<attrs>{_ATTRS})>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINERS = frozenset(
    "html head body article main section div nav header footer aside form ul ol dl table figure blockquote details dialog fieldset button menu".split()
)
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre figcaption caption summary hr address option title legend".split())
# Regions that are never main text, by element and by the words of class, id and role.
_OUTSIDE = frozenset("head nav footer aside form dialog button menu".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu topbar breadcrumb breadcrumbs "
    "header masthead footer colophon sidebar aside rail widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager search".split()
)


# Words that may stand beside a listed word in the name of a region; any other word makes it a name of its own.
_BESIDE = frozenset(
    "site page main left right top bottom box bar block wrapper wrap container area list links link button buttons section inner outer primary secondary global "
    "fixed sticky post posts entry article content unit slot panel form feed icons icon item items text title body thread single group row col column zone "
    "mobile desktop message center small large big".split()
)
# Never a region by name; words before a name that only describe the page; names that no amount of text makes main text.
_CORE = frozenset("html body main article".split())
_STATES = frozenset("has with without no not is are hide show".split())
_READERS = frozenset("comment comments disqus reply replies respond".split())


def key_of(tag: str, attrs: str) -> str:
    """The element and the names of its class, id and role, without digits."""
    if not attrs or "=" not in attrs:
        return tag
    found = (re.sub(r"[^a-z]+", "-", token).strip("-") for m in _NAMES.finditer(attrs) for token in (m[1] or m[2] or m[3] or "").lower().split())
    return ".".join([tag, *sorted({name for name in found if name})])


def outside_names(names: list[str]) -> set[str]:
    """The listed words of those ``names`` that are made of listed words and words that go beside them, and describe no state."""
    found: set[str] = set()
    for name in names:
        words = name.split("-")
        if words[0] not in _STATES and all(w in _OUTSIDE_NAMES or w in _BESIDE for w in words):
            found |= _OUTSIDE_NAMES.intersection(words)
    return found


def region(key: str, within: bool, by_name: bool = True) -> bool:
    """Whether a container or block is a region that is never main text; ``within`` an article or main element, a header is none.

    Without ``by_name`` only readers' comments count by their name, whatever their text amounts to.
    """
    tag, *names = key.split(".")
    if tag in _CORE:
        return False
    found = outside_names(names) if names else set()
    if within:
        # An article's own header holds its title.
        found.discard("header")
    if tag in _OUTSIDE or tag == "header" and not within:
        return True
    return bool(found if by_name else found & _READERS)


def holds_article(key: str) -> bool:
    return key.split(".")[0] in ("article", "main")


def outside(path: tuple[str, ...], by_name: bool = True) -> bool:
    return region(path[-1], any(map(holds_article, path[:-1])), by_name)


def events(html: str) -> Iterator[tuple]:
    """("open", key), ("close",) and ("block", key, text, link characters) in page order."""
    open_: list[str] = []
    known: Counter[str] = Counter()  # open containers by element
    parts: list[str] = []
    tag, links, in_link, at = "", 0, 0, 0

    def block():
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        return text

    def add(piece):
        nonlocal links
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece)

    def shut(name):
        while True:
            last = open_.pop()
            known[last] -= 1
            yield ("close",)
            if last == name:
                return

    for m in _TOKEN.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        name, closing = name.lower(), bool(m["end"])
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in _CONTAINERS or name in _BLOCKS:
            if text := block():
                yield "block", tag, text, min(links, len(text))
            links, in_link, tag = 0, 0, "" if closing else key_of(name, m["attrs"])
            if name in _CONTAINERS:
                if not closing:
                    if name in ("body", "article", "main") and known["head"]:
                        yield from shut("head")
                    open_.append(name)
                    known[name] += 1
                    yield "open", key_of(name, m["attrs"])
                    tag = ""
                elif known[name]:
                    yield from shut(name)
    add(html[at:])
    if text := block():
        yield "block", tag, text, min(links, len(text))


# An item of a wrapper is a list [key, optional, repeated, children, pages, chars, link chars, text hash].
# Children are items; a slot of text has no children and the key "#" and its block's tag. The hash is
# that of the text where it was the same on every page so far, else 0.
KEY, OPTIONAL, REPEATED, CHILDREN, PAGES, CHARS, LINKS, HASH = range(8)


def text_hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) or 1


def page_wrapper(html: str) -> list:
    """The wrapper of one page."""
    root = ["", False, False, [], 1, 0, 0, 0]
    stack = [root]
    depth = 0
    for event in events(html):
        if event[0] == "open":
            depth += 1
            if depth <= MAX_DEPTH:
                stack.append([event[1], False, False, [], 1, 0, 0, 0])
                stack[-2][CHILDREN].append(stack[-1])
        elif event[0] == "close":
            if depth <= MAX_DEPTH and len(stack) > 1:
                done = stack.pop()
                done[CHILDREN] = folded(done[CHILDREN])
            depth = max(depth - 1, 0)
        else:
            _, tag, text, links = event
            stack[-1][CHILDREN].append([f"#{tag}", False, False, [], 1, len(text), links, text_hash(text)])
    while stack:
        done = stack.pop()
        done[CHILDREN] = folded(done[CHILDREN])
    return root


def joined(a: list, b: list, same_page: bool = False) -> list:
    """Two items of one key as one. On one page they repeat; from two pages their statistics add up."""
    children = folded(aligned(a[CHILDREN], b[CHILDREN])) if a[CHILDREN] or b[CHILDREN] else []
    return [
        a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or same_page, children,
        max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS],
        (a[HASH] if a[HASH] == b[HASH] else 0) if not same_page else (xxhash.xxh32_intdigest(f"{a[HASH]},{b[HASH]}") or 1 if a[HASH] and b[HASH] else 0),
    ]


def folded(items: list[list]) -> list[list]:
    """Neighbours that repeat, up to four items at a time, become one repeated group."""
    for period in (1, 2, 3, 4):
        out: list[list] = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period and all(x[KEY] == y[KEY] for x, y in zip(out[-2 * period:-period], out[-period:])):
                out[-2 * period:] = [joined(x, y, same_page=True) for x, y in zip(out[-2 * period:-period], out[-period:])]
        items = out
    if len(items) > MAX_ITEMS:
        # One repeated group of optional items, one for each key.
        by_key: dict[str, list] = {}
        for item in items:
            by_key[item[KEY]] = joined(by_key[item[KEY]], item, same_page=True) if item[KEY] in by_key else item
        items = [[*x[:OPTIONAL], True, True, *x[CHILDREN:]] for x in by_key.values()]
    return items


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Sequences ``a`` and ``b`` as one: a longest common subsequence of keys is joined, the rest is optional."""
    if [x[KEY] for x in a] == [x[KEY] for x in b]:
        return [joined(x, y) for x, y in zip(a, b)]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i][KEY] == b[j][KEY] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    optional = lambda x: [x[KEY], True, *x[REPEATED:]]
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][KEY] == b[j][KEY]:
            out.append(joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1, j] >= best[i, j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out


def expression(item: list) -> str:
    """A wrapper as a regular expression, for readers."""
    inner = item[KEY] if not item[CHILDREN] else f"{item[KEY]}({' '.join(map(expression, item[CHILDREN]))})"
    return inner + ("*" if item[OPTIONAL] and item[REPEATED] else "?" if item[OPTIONAL] else "+" if item[REPEATED] else "")


def content_roots(wrapper: list) -> list[str]:
    """Paths (keys joined by ``>``) of the containers that hold the main text of a host's pages."""
    found: list[str] = []

    def named(item, path):
        for child in item[CHILDREN]:
            if child[KEY].startswith("#"):
                continue
            own = (*path, child[KEY])
            if outside(own):
                continue
            if child[KEY].split(".")[0] in ("article", "main"):
                found.append(">".join(own))
            else:
                named(child, own)

    named(wrapper, ())
    if found:
        # An article inside a main region is the closer one.
        inner = [f for f in found if "article" in (k.split(".")[0] for k in f.split(">"))]
        return sorted(set(inner or found))

    def mass(item, path):
        total = 0
        for child in item[CHILDREN]:
            if child[KEY].startswith("#"):
                constant = child[HASH] != 0 and child[PAGES] > 2
                total += 0 if constant else max(child[CHARS] - 2 * child[LINKS], 0)
            elif not outside((*path, child[KEY]), by_name=False):
                total += mass(child, (*path, child[KEY]))
        return total

    # Names do not count here: the container of most of the text that varies is no region, whatever it is called.
    node, path = wrapper, ()
    while True:
        inner = [c for c in node[CHILDREN] if not c[KEY].startswith("#") and not outside((*path, c[KEY]), by_name=False)]
        best = max(inner, key=lambda c: mass(c, (*path, c[KEY])), default=None)
        if best is None or mass(best, (*path, best[KEY])) < 0.6 * mass(node, path) or not mass(node, path):
            return [">".join(path)] if path else []
        node, path = best, (*path, best[KEY])


def template_slots(wrapper: list, roots: list[str]) -> list[list]:
    """[path, block key, text hash] of the slots inside ``roots`` that are part of the host's template."""
    wanted, found = frozenset(roots), []

    def visit(item, path, single, same, varying):
        """Collect the slots of a root whose text is always the same; whether any other slot varies."""
        for child in item[CHILDREN]:
            alone = single and not child[REPEATED]
            if not child[KEY].startswith("#"):
                varying = visit(child, (*path, child[KEY]), alone, same, varying)
            elif not child[HASH]:
                varying = True
            elif alone and child[PAGES] >= max(SAME_PAGES, item[PAGES] / 2) and not re.match("#(h[1-6]|dt|th|summary|caption)\\b", child[KEY]):
                same.append([">".join(path), child[KEY], child[HASH]])
        return varying

    def search(item, path):
        for child in item[CHILDREN]:
            own = (*path, child[KEY])
            if ">".join(own) in wanted:
                same: list[list] = []
                if visit(child, own, True, same, False):
                    found.extend(same)
            elif not child[KEY].startswith("#"):
                search(child, own)

    search(wrapper, ())
    return found


def extract(html: str, roots: list[str], template: list[list] | None = None) -> str:
    """The main text of a page: its blocks inside the content roots, outside the regions that are never main text and not of the template."""
    tree: dict = {}
    for root in roots:
        node = tree
        for key in root.split(">"):
            node = node.setdefault(key, {})
        node[""] = True
    slots = {(path, key, h) for path, key, h in template or ()}
    deepest = max((path.count(">") for path, _, _ in slots), default=-1)
    inside: list[str] = []
    anywhere: list[str] = []
    keys: list[str] = []
    # For each open container: place among the roots, in a root, in an excluded region, in an article.
    state: list[tuple[dict | None, bool, bool, bool]] = [(tree, False, False, False)]
    seen = False
    for event in events(html):
        place, rooted, excluded, within = state[-1]
        if event[0] == "open":
            key = event[1]
            place = place.get(key) if place else None
            root = bool(place and place.get(""))
            seen |= root
            # A root inside a region named above opens it again.
            state.append((place, rooted or root, not root and (excluded or region(key, within)), within or holds_article(key)))
            keys.append(key)
        elif event[0] == "close":
            if keys:
                keys.pop()
                state.pop()
        elif not excluded and not (event[1] and region(event[1], within)):
            anywhere.append(event[2])
            if rooted and not (len(keys) - 1 <= deepest and (">".join(keys), f"#{event[1]}", text_hash(event[2])) in slots):
                inside.append(event[2])
    return "\n\n".join(inside if seen else anywhere)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper (JSON) for each host of ``pages`` (host and html), written to the shared folder."""

    def read(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                names=["host", "part", "wrapper"],
            )
            held.clear()

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1)):
                host, page = host.as_py(), page.as_py()
                if page:
                    own = page_wrapper(page)
                    held[host] = joined(held[host], own) if host in held else own
                    if len(held) > HELD_HOSTS:
                        yield from flush()
        yield from flush()

    found = materialize(pages.select("host", F.col(html).cast("string")).mapInArrow(read, "host string, part long, wrapper string"))
    width = (found.agg(F.max("part")).first()[0] or 0) + 1

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "wrapper"])
        whole = None
        for text in rows["wrapper"]:
            whole = json.loads(text) if whole is None else joined(whole, json.loads(text))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [int(rows["part"].iloc[0])], "wrapper": [json.dumps(whole)]})

    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        found = found.groupBy("host", "part").applyInPandas(meet, "host string, part long, wrapper string")
        width = -(-width // FAN_IN)
        if width == 1:
            return materialize(found.select("host", "wrapper"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``text``, the main text of each whole page."""
    docs = pages.drop("text").withColumn("_host", host_of(F.col(url)))
    wrappers = induce(docs.select(F.col("_host").alias("host"), html), html)

    def compile_(batches):
        for batch in batches:
            rules = []
            for wrapper in map(json.loads, batch.column(1).to_pylist()):
                roots = content_roots(wrapper)
                rules.append(json.dumps([roots, template_slots(wrapper, roots)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], ["_rule_host", "_roots"])

    # Written, so that the planner knows whether the rules are small enough to broadcast.
    rules = materialize(wrappers.mapInArrow(compile_, "_rule_host string, _roots string"))
    ruled = docs.join(rules, docs["_host"] == rules["_rule_host"], "left").drop("_rule_host", "_host")
    kept = [c for c in ruled.columns if c != "_roots"]
    schema = T.StructType([*(f for f in ruled.schema.fields if f.name != "_roots"), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            parsed: dict[str, list] = {}
            texts = []
            for page, roots in zip(batch.column(html), batch.column("_roots")):
                page, roots = page.as_py(), roots.as_py() or "[[], []]"
                if roots not in parsed:
                    parsed[roots] = json.loads(roots)
                texts.append(extract(page, *parsed[roots]) if page else "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return ruled.mapInArrow(run, schema)
