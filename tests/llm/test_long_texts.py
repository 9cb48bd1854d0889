"""Parts that very long texts and shared payloads need: passages in slices, rewriting in pieces, hot digests."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relog.llm import common, media, pii, quality

WORDS = ["a", "be", "the", "Wörd", "x1", "lorem", "ipsum", "the"]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return "".join(w + rng.choice([" ", "\n", " \t "]) for w in rng.choice(WORDS, n))


def bucket(h, kinds):
    return (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % kinds


def plain_passages(text):
    """encode_passages, a passage and a byte at a time."""
    b, mix, mod = text.encode(), [int(x) for x in quality._MIX], 2**64
    words, at = [], 0
    for w in b.split():
        at = b.index(w, at)
        words.append((at, w))
        at += len(w)
    if not words:
        return [[0.0] * quality.FEATURES]
    hashes = [sum(mix[x] * (2 * i + 1) for i, x in enumerate(w)) % mod for _, w in words]
    out = []
    for p in range(0, len(words), quality.PASSAGE):
        last = min(p + quality.PASSAGE, len(words))
        begin, end = (words[p][0] if p else 0), (words[last][0] if last < len(words) else len(b))
        grams = [bucket(sum(mix[b[i - k]] * (2 * k + 1) for k in range(3) if i >= k) % mod, quality.GRAMS) for i in range(begin, end)]
        own = hashes[p:last]
        pairs = [bucket((hashes[i] + hashes[max(i - 1, 0)] * 3) % mod, quality.PAIRS) for i in range(p, last)]
        row = []
        for found, kinds in ((grams, quality.GRAMS), ([bucket(h, quality.WORDS) for h in own], quality.WORDS), (pairs, quality.PAIRS)):
            row += [math.sqrt(Counter(found)[k] / len(found)) for k in range(kinds)]
        out.append([*row, math.log1p(len(own)) / 4, len(set(own)) / len(own), sum(x == y for x, y in zip(own, own[1:], strict=False)) / len(own)])
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 700])
@pytest.mark.parametrize("lead", ["", " \n"])
def test_passages_against_plain(n, lead):
    text = lead + prose(n, n)
    want = plain_passages(text)
    for size in (1, 3, quality.SLICE):
        got = np.concatenate(list(quality.encode_slices(text, size)))
        assert got.shape == (len(want), quality.FEATURES) and np.allclose(got, want, atol=1e-6)


def test_scores_against_plain_attention():
    rng = np.random.default_rng(3)
    model = quality.fit([quality.encode_passages(prose(300, i)) for i in range(20)], np.arange(20) % 2 * 1.0)
    model.w |= {k: rng.normal(size=x.shape) for k, x in model.w.items()}
    w = model.w
    for n in (0, 1, 64, 1000):
        h, s = [], []
        for x in np.array(plain_passages(prose(n, n))):
            h.append(np.tanh((x - model.mean) / model.scale @ w["e"] + w["eb"]))
            s.append(float((np.tanh(h[-1] @ w["v"]) / (1 + np.exp(-h[-1] @ w["u"]))) @ w["a"]))
        share = np.exp(np.array(s) - max(s))
        z = sum(a * x for a, x in zip(share / share.sum(), h, strict=True))
        want = 1 / (1 + math.exp(-float(z @ w["c"] + w["cb"][0])))
        for size in (1, 4, quality.SLICE):
            assert abs(model.score(prose(n, n), size) - want) < 1e-4


def plain_rewritten(text, spans):
    out, pos = [], 0
    for a, b, kind in sorted(spans):
        if a >= pos:
            out.append(text[pos:a] + f"[{kind.upper()}]")
        pos = max(pos, b)
    return "".join(out) + text[pos:]


@pytest.mark.parametrize("cut", [1, 5, 4096])
def test_texts_are_rewritten_in_pieces(spark, monkeypatch, cut):
    """Spans side by side, overlapping, equal, at both ends and at a piece's end, and more than one run holds."""
    monkeypatch.setattr(pii, "CUT", cut)
    rng = np.random.default_rng(cut)
    rows = [("", []), ("é😀\nabc", []), ("é😀\nabc", [(0, 6, "ip")]), ("0123456789", [(0, 5, "ip"), (5, 10, "email")]), ("0123456789", [(2, 8, "phone"), (4, 6, "card"), (7, 9, "ip")])]
    for n in (3, 40, 900):
        text = "".join(rng.choice(list("ab é😀\n"), 4 * n))
        rows.append((text, [(int(a), int(min(a + rng.integers(1, 6), 4 * n)), "card") for a in rng.integers(0, 4 * n, n)]))
    df = spark.createDataFrame([(i, t, [(k, a, b, t[a:b]) for a, b, k in s]) for i, (t, s) in enumerate(rows)], f"i int, t string, spans array<{pii.SPAN}>")
    got = {r.i: r.out for r in df.select("i", pii.rewritten(F.col("t"), F.col("spans")).alias("out")).collect()}
    assert got == {i: plain_rewritten(t, s) for i, (t, s) in enumerate(rows)}


def test_payloads_that_many_share(spark, monkeypatch):
    """A third of all texts is one text, a third is empty or null: their references stay in their tasks."""
    monkeypatch.setattr(common, "SPREAD", 5)
    texts = ["same text"] * 40 + [None, ""] * 20 + [f"text {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = media.document_media(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(len(texts)))
    for r in got:
        n, payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest()
