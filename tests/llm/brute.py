"""Plain Python versions of what the corpus operators return, for small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
WHITE = " \t\n\x0b\x0c\r"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def repeated_words(texts, width):
    """Kept words of each text."""
    split = [spaced(t) for t in texts]
    counts = Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_bytes(rows, width):
    """``(key, text)`` rows in order of key, null last; the kept bytes of each."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, (rows[i][1] or "").encode()))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k:k + width] in seen:
                gone[k:k + width] = b"\1" * width
            seen.add(b[k:k + width])
        out[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))
    return [out[i] for i in range(len(rows))]


def shingles(text, size):
    w = spaced((text or "").translate(TO_LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_components(rows, size, percent):
    """``(key, text)`` rows; ``(n, component)`` of each, links by exact similarity."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if None not in (rows[i][0], rows[j][0]) and sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return [(len(sets[i]), None if rows[i][0] is None else min(k for k in least[find(i)] if k is not None)) for i in range(len(rows))]


def benchmark_hits(text, items, width):
    """Hit word places and names of items found."""
    w = alphanumeric(text)
    hits, names = set(), set()
    for name, said in items:
        v = alphanumeric(said)
        for k in range(max(1, len(v) - width + 1) if v else 0):
            window = v[k:k + width]
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hits.update(range(i, i + len(window)))
                    names.add(str(name))
    return sorted(hits), sorted(names)


def random_texts(n, words, longest, seed, separator=" "):
    """Texts over few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            w = rng.choice(texts).split(separator)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(separator.join(w))
        elif texts and kind < 0.7:
            w = rng.choice(texts).split(separator)
            a = rng.randrange(len(w))
            texts.append(separator.join([rng.choice(words) for _ in range(rng.randint(0, 9))] + w[a:a + 30]
                                        + [rng.choice(words) for _ in range(rng.randint(1, 9))]))
        else:
            texts.append(separator.join(rng.choice(words) for _ in range(rng.randint(1, longest))))
    return texts


def usable_vector(v, dim):
    return v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)


def whitened(vectors, components, scale, offset, by_count):
    """``x, n, sums`` of the fit list, deviations and whitened rows of all vectors, explained shares; signs are free."""
    x = np.floor(scale * np.array(vectors, float)).astype(np.int64) + offset
    fit = x if by_count else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = lambda m: (m - sums // n) - (sums % n) / n
    v = centred(fit).T @ centred(fit) / n
    values, axes = np.linalg.eigh(v)
    top = np.argsort(-values)[:components]
    top = top[values[top] > 1e-9 * values.max()]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred(x) @ axes[:, top] / np.sqrt(values[top]), values[top] / np.trace(v)


def hard_negatives(rows, anchor, positives, negatives, low, high, scale):
    """``(key, label, vector)`` rows of one length; the result's tuples, sorted."""
    rows = [(k, l, [int(np.floor(scale * c)) for c in v]) for k, l, v in rows]
    out = []
    for i, (k, l, x) in enumerate(rows):
        if not anchor(k):
            continue
        ranked = sorted((-sum(a * b for a, b in zip(x, y)), kk, j) for j, (kk, _, y) in enumerate(rows) if j != i)
        for s, p, _ in [r for r in ranked if rows[r[2]][1] == l][:positives]:
            inside = [(n, t) for t, n, j in ranked if rows[j][1] != l and low * -s <= 100 * -t <= high * -s]
            out += [(k, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(inside[:negatives])]
    return sorted(out)


def near_vectors(rows, threshold):
    """``(key, label, vector)`` rows; ``(n_links, component)`` of each."""
    ok = [k is not None and l is not None and v is not None and usable_vector(v, len(v)) and any(v) for k, l, v in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    for i, (_, l, v) in enumerate(rows):
        for j, (_, m, w) in enumerate(rows):
            if i != j and ok[i] and ok[j] and l == m and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                linked[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    component = [k for k, _, _ in rows]
    for _ in rows:
        component = [c if not linked[i].any() else min([c, *(component[j] for j in np.flatnonzero(linked[i]))]) for i, c in enumerate(component)]
    return list(zip(linked.sum(axis=1).tolist(), component))
