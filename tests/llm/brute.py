"""The operators' results by plain means, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def windows(items, n):
    return [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]


def _gone(rows, n, cut):
    count = Counter()
    for row in rows:
        count.update(cut(row, n))
    out = []
    for row in rows:
        g = np.zeros(len(row), bool)
        for i, w in enumerate(cut(row, n)):
            if count[w] > 1:
                g[i : i + n] = True
        out.append(g)
    return out


def removed_words(texts, n=35):
    rows = [words(t) for t in texts]
    return [(len(w), int(g.sum()), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for w, g in zip(rows, _gone(rows, n, windows), strict=True)]


def removed_bytes(texts, n=200):
    rows = [(t or "").encode() for t in texts]
    out = []
    for b, g in zip(rows, _gone(rows, n, lambda b, n: [b[i : i + n] for i in range(len(b) - n + 1)]), strict=True):
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((len(b), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    return out


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else set(windows(w, 5))


def groups(ids, texts):
    """(doc_id, n_shingles, component_id), and for each row the number of its component."""
    sets, holders = [shingles(t) for t in texts], defaultdict(list)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in holders[g]).items():
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                top[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, d in enumerate(ids)], [find(i) for i in range(len(ids))]


def removed_lines(rows, least=3):
    """rows: (doc_id, text), in the order of documents; equal rows are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, gone = set(), defaultdict(set)
    for row in order:
        lines = [x for x in (row[1] or "").split("\n") if words(x)]
        for i, w in enumerate(windows(lines, least)):
            if w in first:
                gone[row].update(range(i, i + least))
            first.add(w)
    out = []
    for row in rows:
        kept, number = [], 0
        for line in (row[1] or "").split("\n"):
            if not (words(line) and number in gone[row]):
                kept.append(line)
            number += bool(words(line))
        out.append((row[0], number, len(gone[row]), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def counts(text):
    w = words(text)
    seen, covered = Counter(windows(w, 5)), set()
    for i, x in enumerate(windows(w, 5)):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
