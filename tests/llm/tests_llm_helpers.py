"""Brute-force versions of the operators."""
import re
from collections import defaultdict


def without_repeats(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            w = data[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        out.append((doc, bytes(c for c, g in zip(data, gone) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def hits(texts, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k:k + size])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def linked(texts, percent):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in texts.items():
        w = pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}
