"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def repeats(docs, window=50):
    """docs: [(doc_id, text)] -> rows (doc_id, n_words, n_removed, sha)."""
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def near(docs, words=4, percent=80):
    """docs: [(doc_id, text)] -> {doc_id: (n, component)}; ids differ."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    pairs = {(a, b) for v in where.values() if len(v) < 400 for a in v for b in v if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(docs, items, window=13):
    rows = []
    phrases = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        if w:
            k = min(window, len(w))
            for j in range(len(w) - k + 1):
                phrases.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    sizes = sorted({len(p) for p in phrases})
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                p = tuple(w[j : j + k])
                if p in phrases:
                    hit[j : j + k] = [True] * k
                    found |= phrases[p]
        n = sum(hit)
        rows.append((d, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return rows
