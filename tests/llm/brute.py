"""Plain versions of the operators' contracts, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().lower().split()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def fingerprint(text, n=3):
    w = words(text)
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(rows, radius=2):
    """rows: (doc_id, text); the smallest id reachable over links of at most radius bits."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), repeats=2):
    """sizes: {source: size}; reshare the excess until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, fixed, free = share * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > repeats * sizes[s]}
        if not above:
            break
        for s in above:
            fixed[s] = Fraction(repeats * sizes[s])
        free -= above
        left = share * sum(sizes.values()) - sum(fixed.values())
    return {s: float(fixed[s] if s in fixed else left * weight[s] / sum(weight[x] for x in free)) for s in order}


def held_out(doc_id, n, remainder):
    return zlib.crc32(str(doc_id).encode()) % n == remainder


def nearest(vectors, query, k=20):
    ok = [(i, np.asarray(v, dtype=np.float64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    q = dict(ok)[query]
    return sorted(((float(q @ v), i) for i, v in ok if i != query), key=lambda x: (-x[0], x[1]))[:k]


def all_spans(texts, disclosure=0.9, support=3):
    """For each text its base spans and, after them, those of terms that disclose an entity of it."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    entities = [{t[a:b].lower() for _, a, b in spans} for t, spans in zip(texts, base, strict=True)]
    terms = [{w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts]
    count = lambda sets: Counter(x for s in sets for x in s)
    with_entity, with_term, n = count(entities), count(terms), len(texts)
    both = Counter((e, w) for es, ws in zip(entities, terms, strict=True) for e in es for w in ws)
    different = Counter((e, w) for _, es, ws in {(t, frozenset(es), frozenset(ws)) for t, es, ws in zip(texts, entities, terms, strict=True)} for e in es for w in ws)
    told = set()
    for (e, w), c in both.items():
        content = math.log2(n / with_entity[e])
        if different[e, w] >= support and content > 0 and math.log2(c * n / (with_entity[e] * with_term[w])) >= disclosure * content:
            told.add((e, w))
    out = []
    for t, spans, es in zip(texts, base, entities, strict=True):
        own = {w for e, w in told if e in es}
        more = [("term", *m.span()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in own]
        out.append(spans + [x for x in more if not any(a < x[2] and b > x[1] for _, a, b in spans)])
    return out
