"""Row-at-a-time secret scan for the tests."""

import math
import re

from auditlark.llm import secrets as S


def windows(text, alphabet, bits, w=S.WINDOW):
    spans = []
    for i in range(w, len(text) + 1):
        counts = {}
        for c in text[i - w:i]:
            k = alphabet.find(c)
            counts[k] = counts.get(k, 0) + 1
        if -sum(n / w * math.log2(n / w) for n in counts.values()) > bits + 1e-9:
            if spans and spans[-1][1] >= i - w:
                spans[-1][1] = i
            else:
                spans.append([i - w, i])
    return spans


def spans(text):
    text, base, more = text or "", [], []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    for m in re.finditer(S.CANDIDATE, text):
        c = m[0]
        if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)) or any(re.search(p, c) for p in S.ALLOW):
            continue
        is_hex = re.fullmatch("[0-9a-fA-F]+", c)
        taken = [m.span() for m in re.finditer(S.ALLOW_WORDS, c)]
        for low, high in zip([0, *(b for _, b in taken)], [*(a for a, _ in taken), len(c)]):
            part = c[low:high]
            found = windows(part.lower(), S.HEX_ALPHABET, S.HEX_BITS) if is_hex else windows(part, S.BASE64_ALPHABET, S.BASE64_BITS)
            more += [(m.start() + low + a, 3 if is_hex else 4, m.start() + low + b) for a, b in found]
    more = [e for e in more if not any(b[0] <= e[0] and b[2] >= e[2] for b in base)]
    return sorted(base), sorted(base + more)
