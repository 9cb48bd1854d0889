"""Near copies of whole texts against brute force over all pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relog.llm import nearcopies


def grouped(keys: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {k: k for k in keys}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 2000])
def test_strays_of_a_large_group_find_all_partners(spark, monkeypatch, block):
    """Texts around the similarity of 0.8, which share bands in one large group: every pair that shares a band
    and is similar ends in one component, and no component holds more than brute force links."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(90)], []
    for i in range(160):
        words = list(base)
        for at in rng.choice(90, rng.integers(1, 4), replace=False):
            words[at] = f"x{rng.integers(0, 400)}"
        texts.append(" ".join(words))
    texts += ["", "one two", "one two", *(f"other {i} " + " ".join(base[:6]) for i in range(5)), texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text"))
    prints = nearcopies.signatures(docs)
    rows = prints.select("key", "bands").collect()
    found = {bytes(r["key"]): bytes(r["component"]) for r in nearcopies.classes(docs, prints).collect()}

    sets = {}
    for text in texts:
        s = nearcopies.shingle_set(text)
        sets[nearcopies.xxhash.xxh3_128_digest(s.tobytes())] = set(s.tolist())
    bands = {bytes(r["key"]): set(r["bands"]) for r in rows}
    assert all(len(k) == 16 for k in bands)
    similar = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    least = grouped(list(sets), [(a, b) for a, b in similar if bands[a] & bands[b]])
    most = grouped(list(sets), similar)
    got = {k: found.get(k, k) for k in sets}
    assert len(set(least.values())) > 10 and sum(bool(bands[a] & bands[b]) for a, b in combinations(sets, 2)) > 2 * len(similar) / 3
    for a, b in combinations(sets, 2):
        if least[a] == least[b]:
            assert got[a] == got[b]
        if got[a] == got[b]:
            assert most[a] == most[b]
    assert all(found[c] == c for c in found.values())


def test_alike_counts_shingles_in_common():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 30, n).astype(np.uint64)) for n in (1, 5, 20, 40, 60, 0)]
    every, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    by, sizes = np.argsort(every, kind="stable"), np.array([len(p) for p in parts])
    for ask in parts:
        want = [j for j, p in enumerate(parts) if len(ask) and len(p) and len(np.intersect1d(ask, p)) >= 0.5 * len(np.union1d(ask, p))]
        assert nearcopies.alike(ask, every[by], owner[by], sizes, 0.5).tolist() == want
