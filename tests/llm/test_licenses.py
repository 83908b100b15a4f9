import random
import re
import textwrap

from auditlark.llm import licenses as L


def brute(text, threshold=L.THRESHOLD):
    """Best (dice, license) of each distinct bigram set, comparing every unit with every template."""
    norm = re.sub(r"[!?:;]+([\"')\]]*)([ \t\r\n]|\Z)", r".\1\2", (text or "").lower())
    norm = re.sub(r"[^\w.+\n-]+|_", " ", norm)
    paragraphs = re.split(r"\n[ ]*\n\s*", norm)
    units = [*re.split(r"\.+[ \n]+|\n", norm), *norm.split("\n"), *paragraphs, norm]
    for p in paragraphs:
        units += re.split(r"\.+[ ]+", p.replace("\n", " "))
    found = set()
    for unit in units:
        w = [x for x in re.split(r"\.*[ \n]+", re.sub(r"\.+$", "", unit)) if x]
        own = frozenset(f"{a} {b}" for a, b in zip(w, w[1:]))
        scores = []
        for name, template in L.TEMPLATES:
            other, words = set(L.template_bigrams(template)), L.template_words(template)
            foreign = {x for x in L.FAMILY if x not in words and x not in ("by", "library")}
            if own and set(L.template_marks(template)) <= set(w) and not foreign & set(w):
                scores.append((-2 * len(own & other) / (len(own) + len(other)), name))
        if scores and min(scores)[0] <= -threshold + 1e-12:
            found.add((own, min(scores)[1], round(-min(scores)[0], 9)))
    return sorted((name, dice) for _, name, dice in found)


GNU = (
    "This {kind} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {family}General Public License as published by the "
    "Free Software Foundation{b} either version {version} of the License, or (at your option) any later version."
)


def test_planted_notices(spark):
    """Notices as they stand in articles and files, named by hand."""
    header = lambda kind, a, family, b, version: GNU.format(kind=kind, a=a, family=family, b=b, version=version)
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n))
    cases = {
        "Want to reuse this article? Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Copyright 2021 Jane Doe: Released under the MIT License.": ["MIT"],
        "Some words. Licensed under CC BY-NC 4.0! More words": ["CC-BY-NC-4.0"],
        "Old text; licensed under the MIT License; and so on": ["MIT"],
        header("program", ";", "", ";", "2"): ["GPL-2.0"],
        header("program", ":", "", ",", "3"): ["GPL-3.0"],
        header("library", ";", "Lesser ", ";", "2.1"): ["LGPL-2.1"],
        header("program", ":", "Lesser ", ",", "3"): ["LGPL-3.0"],
        header("program", ":", "Affero ", ",", "3"): ["AGPL-3.0"],
        header("program", ";", "", ";", "1"): [],
        "Licensed under CC BY 3.0.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "A longer paragraph begins here and goes on. " + wrap(header("program", ":", "", ",", "3"), 50) + " And it ends\nover there.": ["GPL-3.0"],
        "# " + wrap(header("program", ";", "", ";", "2"), 60).replace("\n", "\n# "): ["GPL-2.0"],
        "Intro. This work is licensed under the GNU\nLesser General Public License, version 3. Outro": ["LGPL-3.0"],
        "The licence of this text is a matter of taste. He released it under pressure.": [],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.text: sorted({m.license for m in r["matches"]}) for r in L.scan(docs).collect()}
    assert found == cases


def test_matches_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n", "Licensed under CC BY-NC 4.0.", "x Licensed under CC BY-NC 4.0. y", "LICENSED, under: CC  BY-NC 4.0", "MIT MIT MIT"]
    texts += [t for _, t in L.TEMPLATES] + ["Intro words.\n" + t + "\nAnd then more of the text. End" for _, t in L.TEMPLATES]
    texts += ["Start here\n\n" + t.replace(", ", ",\n").replace(" and ", "\nand ") + "\n\nother end" for _, t in L.TEMPLATES]
    for _ in range(150):
        words = rng.choice(L.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["the", "software", "4.0.", "zzz", ""])
        texts.append(" ".join(words[rng.randint(0, 2):]) + rng.choice(["", ".", "\nmore"]))
    texts += ["word " * 30_000 + "Released under the MIT License.\n"] * 2
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    found = {r.doc_id: sorted((m.license, round(m.dice, 9)) for m in r["matches"]) for r in L.scan(docs).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert found[i] == brute(t), t
    assert sum(bool(f) for f in found.values()) > 60
    assert L.scan(docs.limit(0)).count() == 0


def test_anchors_leave_no_match_out():
    """A set without any anchor of a template shares too few of its bigrams to match it."""
    low = L.THRESHOLD / (2 - L.THRESHOLD)
    chosen = set(L.anchors(L.TEMPLATES, L.THRESHOLD))
    for _, text in L.TEMPLATES:
        own = set(L.template_bigrams(text))
        assert len(own - chosen) < low * len(own)
