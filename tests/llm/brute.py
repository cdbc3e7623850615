"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = words(fold(text))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def components(rows):
    """Of (id, text) rows: a list of (id, set size, smallest id of the component), in the order of the rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        root = find(i)
        if key is not None:
            least[root] = min(key, least.get(root, key))
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def dedup(texts, window=35):
    """Of each text: words, removed words, kept words joined."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), " ".join(kept)))
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def top_k(rows, k):
    """Of (id, list of integers or None) rows, queries being ids divisible by 50."""
    good = [(i, v) for i, v in rows if i is not None and v is not None]
    out = []
    for qid, q in {i: min(v for j, v in good if j == i) for i, _ in good if i % 50 == 0}.items():
        found = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qid and len(v) == len(q)]
        out += [(qid, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def warc(rows):
    groups = defaultdict(list)
    for key, body in rows:
        raw = (body or "").encode()
        if len(raw) >= 100 and key is not None:
            groups[raw].append(key)
    out = []
    for key, body in rows:
        raw = (body or "").encode()
        first = min(groups[raw]) if groups.get(raw) else None
        refers = first if first is not None and key != first else None
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out
