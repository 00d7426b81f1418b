"""Plain versions of the operators, for small tables."""

import hashlib
import re

import numpy as np

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def repeats(rows, length=50):
    """(doc_id, bytes) -> {index: (n_bytes, n_removed, n_spans, sha256 of the rest)}"""
    first, out = {}, {}
    last = 1 << 63
    order = sorted(range(len(rows)), key=lambda i: last if rows[i][0] is None else rows[i][0])
    for i in order:
        doc_id, text = rows[i]
        doc_id = last if doc_id is None else doc_id
        for a in range(len(text) - length + 1):
            first.setdefault(text[a : a + length], doc_id)
    for i, (doc_id, text) in enumerate(rows):
        doc_id = last if doc_id is None else doc_id
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - length + 1):
            if first[text[a : a + length]] < doc_id:
                gone[a : a + length] = True
        spans = int((gone & ~np.append(False, gone)[:-1]).sum()) if len(text) else 0
        rest = bytes(np.frombuffer(text, np.uint8)[~gone])
        out[i] = (len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def near(rows, k=4):
    """{doc_id: text} -> {doc_id: (n_shingles, component)}"""
    sets = {i: shingles(t, k) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in rows}


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def all_spans(text, scope=240):
    """Base spans and the weak ones whose complementary parts stand within the scope, compared pair by pair."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    named = r"""(?:user(?:name|_?id)?|login|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}"""
    weak = {(m.start(), 3, m.end()) for m in re.finditer(named, text, re.I | re.A)}
    weak |= {(m.start(), 3, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9.-]+", text)}
    weak |= {(m.start(), 4, m.end()) for m in ASSIGN.finditer(text) if 4 <= len(m[2]) <= 7}
    endpoint = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])"
    weak |= {(m.start(), 5, m.end()) for m in re.finditer(endpoint, text)}
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    needs = {3: {"s"}, 4: {"i"}, 5: {"i", "s"}}
    near = lambda w, p: p[0] <= w[2] + scope and p[2] >= w[0] - scope
    every = [*base, *weak]
    linked = [w for w in weak if needs[w[1]] <= {role[p[1]] for p in every if near(w, p)}]
    return sorted([*base, *linked])


def nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        own = int(np.flatnonzero(ids == q)[0])
        score = (x * x[own]).sum(axis=1)
        score[own] = -np.inf
        out[q] = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
    return out
