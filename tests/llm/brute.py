"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    n_chars = sum(map(len, words))
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), n_chars, symbols, len(lines) - len(set(lines)), len(inside), failed


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def linked(sets, percent=80):
    """Pairs of places whose sets are similar enough."""
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    out, seen = [], set()
    for same in where.values():
        for k, b in enumerate(same):
            for a in same[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        out.append((a, b))
    return out


def least_reachable(ids, pairs):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(d, least.get(r, d))
    return [least[find(i)] for i in range(len(ids))]


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def base_spans(text, kinds):
    """(counts by kind, sha256 of the listed spans, the spans)."""
    found = [(m.start(), k, name, m.end()) for k, (name, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text or "") if ok(m)]
    found.sort()
    counts = [sum(x[1] == k for x in found) for k in range(len(kinds))]
    listed = ",".join(f"{n}:{s}:{e}" for s, _, n, e in found)
    return counts, hashlib.sha256(listed.encode()).hexdigest(), listed
