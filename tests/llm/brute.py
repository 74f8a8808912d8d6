"""Brute-force versions."""

import collections
import re

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = _WORD.findall((text or "").translate(_LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(rows, percent=85):
    """{(doc_id, n, component, kept)} of (doc_id, text) rows, by prefix filtering and exact comparison."""
    sets = [shingles(t) for _, t in rows]
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            groups[s].append(i)
    keys = list(groups)
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    seen = collections.Counter(x for s in keys for x in s)
    index = collections.defaultdict(list)
    for k in sorted(range(len(keys)), key=lambda k: len(keys[k])):
        s = keys[k]
        prefix = sorted(s, key=lambda x: (seen[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]
        for c in {c for x in prefix for c in index[x]}:
            if root(c) != root(k):
                both = len(s & keys[c])
                if 100 * both >= percent * (len(s) + len(keys[c]) - both):
                    up[root(c)] = root(k)
        for x in prefix:
            index[x].append(k)
    least = {}
    for k, s in enumerate(keys):
        for i in groups[s]:
            if rows[i][0] is not None:
                least[root(k)] = min(least.get(root(k), rows[i][0]), rows[i][0])
    of = {i: least.get(root(k)) for k, s in enumerate(keys) for i in groups[s]}
    out = []
    for i, (doc, _) in enumerate(rows):
        c = of[i] if i in of else doc
        out.append((doc, len(sets[i]), c, doc is not None and doc == c))
    return out
