"""Plain-Python versions of what the operators compute."""

from collections import Counter, defaultdict


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingles(text, n):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(sets, least, scale):
    """id: (set size, smallest id reachable by similar sets)."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    postings = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            postings[t].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for t in s for j in postings[t] if j > i).items():
            if scale * both >= least * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def passes_rules(text):
    """The production quality rules, all of them and in no order."""
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = list(zip(own, own[1:], own[2:]))
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    n, chars, repeats = len(own), sum(len(w.decode()) for w in own), len(lines) - len(set(lines))
    bad = n < 50 or 100 * len(covered) > 50 * n or 100 * sum(map(text.count, "#*$%&|<>")) > 10 * n or 100 * text.count("!!") > 30 * n
    return not bad and not (repeats >= 4 and 100 * repeats > 30 * len(lines)) and 2 * n <= chars <= 15 * n
