"""Plain versions of the operators, word by word, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def small_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w = words(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def fingerprint(text):
    w = words(folded(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=2):
    """Group number of each fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def passages(texts, width=35):
    """(n_words, n_removed, sha of the kept words) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for k in range(width)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def hits(text, items, width=10):
    """(n_words, n_hit, item ids) of a text; ``items`` are (id, text)."""
    w = small_words(text)
    hit, names = set(), set()
    for name, t in items:
        v = small_words(t)
        size = min(width, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def base_licences(text):
    w = small_words(text)
    found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
             for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
