"""Plain restatements of the operators, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(texts, size, num, den):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    at, links = defaultdict(list), []
    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in at[s]).items():
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links.append((j, i))
        for s in sets[i]:
            at[s].append(i)
    return {i: (len(sets[i]), c) for i, c in classes(sets, links).items()}


def repeated(texts, least):
    """Word places that lie in a run of `least` words which another document holds too."""
    owners = defaultdict(set)
    split = {i: words(t) for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - least + 1):
            owners[tuple(w[k : k + least])].add(i)
    out = {i: set() for i in texts}
    for i, w in split.items():
        for k in range(len(w) - least + 1):
            if len(owners[tuple(w[k : k + least])]) > 1:
                out[i].update(range(k, k + least))
    return out
