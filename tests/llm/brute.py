"""Plain versions of the operators' results, for small inputs."""

from collections import defaultdict

SF_SMALL = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows):
    """(id, text) rows with ids: {(id, n): component}."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
             if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    root = roots({i for i, _ in rows}, links)
    return sorted((i, len(s), root[i]) for i, s in sets)


def repeated_places(rows, n=50):
    """{id: word places inside passages of n words that another id holds, too}."""
    held = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            held[tuple(w[k:k + n])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            if len(held[tuple(w[k:k + n])]) > 1:
                out[i].update(range(k, k + n))
    return dict(out)


def align(item, window, match=2, mismatch=-1, gap=-1):
    """Smith-Waterman score of two word lists."""
    best, last = 0, [0] * (len(window) + 1)
    for w in item:
        row = [0]
        for j, x in enumerate(window, 1):
            row.append(max(0, last[j - 1] + (match if w == x else mismatch), last[j] + gap, row[-1] + gap))
        best, last = max(best, *row), row
    return best
