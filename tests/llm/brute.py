"""Plain versions of the operators, for small tables. Rows are (doc_id, text)."""

import hashlib
import re
from collections import defaultdict

LAST = (1 << 63) - 1


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, size=50):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            least[key] = min(least.get(key, LAST), i)
    out = []
    for (doc, _), i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if least[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def near(rows, k=2, percent=80):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets.append({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else root(i), True if i is None else root(i) == i) for (i, _), s in zip(rows, sets)]


def leaks(rows, items, size=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(word, lower(t))
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, t in rows:
        w = re.findall(word, lower(t))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    hit[a : a + n] = [True] * n
                    found |= windows[key]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out
