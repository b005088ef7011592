"""Plain versions of the operators, to hold results against."""

from __future__ import annotations

import hashlib
import random


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows with copies, shared passages, null and empty texts, ties and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(k))
    passages = [make(r.randint(40, 140)) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n ", make(3000)]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.25:
            texts.append(make(r.randint(0, 30)) + " " + r.choice(passages) + "\n" + make(r.randint(0, 60)))
        elif kind < 0.45:
            texts.append(r.choice(texts))
        elif kind < 0.6:
            old = (r.choice(texts) or "x").split(" ")
            old[r.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        elif kind < 0.7:
            texts.append(r.choice(passages) + "  \t" + r.choice(passages))
        else:
            texts.append(make(r.randint(1, 200)))
    ids = r.sample(range(10_000), n)
    ids[5] = ids[6]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None]), len(t) if t else 0) for i, t in zip(ids, texts)]
    return [*rows, rows[7], (None, texts[9], None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def repeats(rows: list[tuple], window: int = 50) -> list[tuple]:
    """Operator 4 by a dictionary of all windows."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    least: dict[tuple, int] = {}
    for i, t, *_ in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_repeats(rows: list[tuple], size: int = 200) -> list[tuple]:
    """Operator 2 by a dictionary of all byte windows."""
    seen: dict[bytes, int] = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            seen[b[s : s + size]] = seen.get(b[s : s + size], 0) + 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s : s + size] = b"\x01" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(rows: list[tuple], least: float = 0.8) -> list[tuple]:
    """Operator 5 by comparing all pairs of distinct shingle sets: (doc_id, class_id)."""
    sets = {}
    for r in rows:
        sets.setdefault(shingle_set(r[1]), []).append(r[0])
    keys = list(sets)
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_shingle: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        for s in k:
            by_shingle.setdefault(s, []).append(i)
    for i, k in enumerate(keys):
        common: dict[int, int] = {}
        for s in k:
            for j in by_shingle[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if c >= least * (len(k) + len(keys[j]) - c):
                parent[root(i)] = root(j)
    best: dict[int, int | None] = {}
    for i, k in enumerate(keys):
        ids = [x for x in [*sets[k], best.get(root(i))] if x is not None]
        best[root(i)] = min(ids) if ids else None
    return [(r[0], best[root(keys.index(shingle_set(r[1])))]) for r in rows]
