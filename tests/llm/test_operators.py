"""Every operator against a plain version of its contract, on an awkward table and on a whole small one."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relog.llm import ann, bpe, media, mixing, passages, pii, ppm, quality, sharding, simhash
from relog.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, k1 string, node string, t string, row string, bucket string, words string, fp string"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows; clashing extra columns come with SCHEMA."""
    story = " ".join(f"word{i % 97} and then" for i in range(400))
    texts = [None, "", " ", "\t\n", "a", "Ab", "one two", "one two three", story, story, story + " end", story.upper(), "x " * 30_000, "é漢字 😀 <|endoftext|> tail", "a  b   c\n\n  d", "mail me@x.org now", "me@x.org", "call +1 (555) 123-4567 or 4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.1"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "null id", None, "s1", 7), (None, None, None, None, None), (-5, "negative id", "en", "s2", 11)]
    return [(*r, 1, *["x"] * 7) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("table", ["odd", "real"])
def test_sharding(table, request):
    docs = request.getfixturevalue(table)
    got = sharding.pack_shards(docs).collect()
    want = multiset((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    if table == "real":
        homes, tokens, count = defaultdict(set), Counter(), Counter()
        for r in got:
            homes[r["text_crc32"], r["size"]].add(r["shard"])
            tokens[r["shard"]] += r["tokens"]
            count[r["shard"]] += 1
        for of, most in ((load, 1.02), (tokens, 1.05), (count, 1.1)):  # balanced together
            assert max(of.values()) <= most * sum(of.values()) / 16, of
        assert all(len(x) == 1 for x in homes.values())  # no group is over a shard's share


def test_only_groups_that_no_shard_holds_are_split(spark):
    rows = [(i, "copy " * 30) for i in range(100)] + [(200 + i, f"other {i} text") for i in range(200)] + [(500 + i, "few " * 20) for i in range(9)]
    got = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes, load = defaultdict(set), Counter()
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert len(homes[zlib.crc32(b"copy " * 30)]) > 4 and len(homes[zlib.crc32(b"few " * 20)]) == 1
    assert max(load.values()) <= 1.3 * sum(load.values()) / 16


def plain_place(sizes, n):
    """Item by item, shard by shard: the highest dot product with what is left among shards that can hold it."""
    total = [sum(x[d] for x in sizes) or 1 for d in range(3)]
    share = [[x[d] / total[d] for d in range(3)] for x in sizes]
    left, out = [[1 / n] * 3 for _ in range(n)], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-max(share[i]), i)):
        fits = [s for s in range(n) if all(left[s][d] >= share[i][d] - 1e-12 for d in range(3))] or range(n)
        dot = {s: sum(left[s][d] * share[i][d] * sharding.WEIGHTS[d] for d in range(3)) for s in fits}
        best = max(dot.values())
        out[i] = next(s for s in fits if dot[s] >= best * (1 - 1e-12) - 1e-15)
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share[i], strict=True)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_place_follows_the_dot_product(seed):
    sizes = np.random.default_rng(seed).lognormal(2, 1.5, (80, 3)).round() + 1
    assert sharding.place(sizes, 5).tolist() == plain_place(sizes.tolist(), 5)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_simhash(table, request):
    docs = request.getfixturevalue(table)
    rows = [(math.inf if d is None else d, t) for d, t in pairs(docs)]
    want = multiset((None if d == math.inf else d, p, None if c == math.inf else c) for d, p, c in brute.components(rows))
    assert multiset(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_simhash_links_in_dense_shards(spark, monkeypatch):
    """Shards over the limit are cut finer without losing a link."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    flips = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (30, 2))]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in map(int, [*base, *flips])})
    monkeypatch.setattr(simhash, "SHARD", 8)
    prints = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(prints).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {x: find(i) for i, x in enumerate(fps)}


def test_quality(real, labels):
    got = {r["doc_id"]: r for r in quality.score_documents(real, labels).collect()}
    assert set(got) == {d for d, _ in pairs(real)}
    assert all(r["held_out"] == brute.held_out(d, 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    out = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc >= 0.85, auc


def test_quality_reads_the_text_alone(odd, labels):
    got = quality.score_documents(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(r["predicted"] == 1 for r in got)
    assert len({r["score"] for r in quality.score_documents(odd.where("text is null or trim(text) = ''"), labels).collect()}) == 1


def test_quality_of_awkward_rows(spark, labels):
    """A trained model on nulls, empty, long and repeated texts; conflicting and repeated labels; repeated ids
    of different texts; and equal scores for equal texts."""
    good, bad = "calm words that say something new about the river and its towns ", "buy buy buy buy "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5) + (f"number {i}" if i % 2 else ""), "x", 9) for i in range(400)]
    rows += [(1000, None, "x", 9), (1001, "", "x", 9), (1002, good * 5000, "x", 9), (1002, good * 5000, "x", 9), (None, bad, "x", 9), (7, bad, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score int")
    own = [(i, i % 2) for i in range(400)] + [(3, 0), (3, 1), (5, 1), (5, 1), (None, 1), (9, None), (11, 7)]
    got = quality.score_documents(docs, spark.createDataFrame(own, "doc_id long, quality int")).collect()
    assert multiset((r["doc_id"],) for r in got) == multiset((r[0],) for r in rows)
    score = defaultdict(set)
    for r in got:
        score[r["doc_id"]].add(round(r["score"], 12))
    assert len(score[1002]) == 1 and score[1000] == score[1001] and len(score[7]) == 2
    assert min(score[2]) < 0.3 < min(score[1]) and min(score[None]) < 0.3 < min(score[1002])
    few = quality.train(docs, spark.createDataFrame(own, "doc_id long, quality int"), rows=50, passages=60)
    assert set(few.w) == {"e", "eb", "v", "u", "a", "c", "cb"}


def test_good_documents_of_awkward_rows(odd, labels):
    kept, scored = quality.good_documents(odd, labels), quality.score_documents(odd, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert multiset(kept.select("doc_id").collect()) == multiset(scored.where("predicted = 1").select("doc_id").collect())


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    model = quality.fit([b.astype(np.float32) for b in bags], np.array([1.0, 1.0, 1.0]))
    for k in model.w:
        model.w[k] = rng.normal(size=model.w[k].shape) * 0.5
    x, first, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, first)["p"]) + (1 - y) * np.log(1 - p))
    for k, g in model.gradients(x, first, y).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        before = model.w[k][at]
        model.w[k][at] = before + 1e-5
        up = loss()
        model.w[k][at] = before - 1e-5
        down = loss()
        model.w[k][at] = before
        assert abs((up - down) / 2e-5 + quality.DECAY * before - g[at]) < 1e-5, k


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [None] * 64), (None, [1.0] * 64), (10_080, [1.0, 2.0])]
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    rows += [(20_000 + i, rows[3][1]) for i in range(40)]  # ties
    dim = len(rows[3][1])
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == dim]
    asked = sorted({i for i, v in good if i % 20 == 0})
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        want = brute.nearest(good, q)
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for s, _ in want]
        hits += len({i for i, _ in got[q]} & {i for _, i in want})
    assert hits / (20 * len(asked)) > 0.99  # ties may round either way


@pytest.mark.parametrize(("n", "spread"), [(1500, 0.4), (6000, 0.4), (4000, None)])
def test_neighbours_recall_in_windows(spark, monkeypatch, n, spread):
    """Recall against brute force is over 0.9 on clusters and on isotropic vectors; windows in clusters are narrow."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = rng.normal(size=(n, 32)) if spread is None else centres[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    reach, measured = [], ann.half_window
    monkeypatch.setattr(ann, "half_window", lambda *a: reach.append(measured(*a)) or reach[-1])
    table = spark.createDataFrame([(i, v.tolist(), "x", 0, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rep string, rank int, curve int")
    got = defaultdict(set)
    for r in ann.neighbours(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, n, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9, hits / (20 * len(got))
    assert spread is None or reach[0] < n / 4, reach


def test_neighbours_of_awkward_rows(spark):
    """Infinite components take no part; repeated ids count once for each different vector; few rows."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [float("inf"), 0.0]), (2, [2.0, 2.0]), (3, [-1.0, 0.0])]
    got = multiset(ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("query_id", "vec_id", "score").collect())
    assert got == multiset([(0, 2, 2.0), (0, 3, 0.0), (0, 2, 2.0), (0, 3, -1.0)])


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = ann.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


class PlainPPM:
    """Dictionary PPM with method C escapes and exclusion, over bytes."""

    def __init__(self, texts, order):
        self.order, self.n = order, defaultdict(Counter)
        for t in texts:
            for ctx, c in self.steps(t):
                for j in range(order + 1):
                    self.n[ctx[len(ctx) - j :]][c] += 1

    def steps(self, text):
        b = bytes([255]) * self.order + (text or "").encode().lower() + b"\xff"
        return [(b[i - self.order : i], b[i]) for i in range(self.order, len(b))]

    def score(self, text):
        total = 0.0
        for ctx, c in self.steps(text):
            out = set()
            for j in range(self.order, -1, -1):
                have = {k: v for k, v in self.n.get(ctx[len(ctx) - j :], {}).items() if k not in out}
                if not have:
                    continue
                den = sum(have.values()) + len(have)
                if c in have:
                    total += math.log10(have[c] / den)
                    break
                total += math.log10(len(have) / den)
                out |= set(have)
            else:
                total -= math.log10(max(1, 256 - len(out)))
        return total


@pytest.mark.parametrize(("table", "bound"), [("odd", 100), ("odd", 0), ("real", ppm.MAX_BRANCHES), ("real", 2000)])
def test_ppm(table, bound, request):
    """Also where tasks look up few or no branches themselves: joins give the same scores."""
    docs = request.getfixturevalue(table)
    docs = docs.where("doc_id is null or doc_id < 60") if table == "real" else docs
    rows = pairs(docs)
    training = [t for d, t in rows if d is None or not brute.held_out(d, 7, 2)]
    words = Counter(w for t in training for w in brute.words(t))
    n, v, ends = sum(words.values()) + len(training), len(words) + 1, len(training)
    model = PlainPPM(training, ppm.ORDER)
    got = ppm.score_texts(docs, max_branches=bound, max_words=50).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for d, t in rows:
        w = brute.words(t)
        counts = [words[x] for x in w] + [ends]
        want[d].append((len(w) + 1, sum(c > 0 for c in counts), sum(math.log10((c + 1) / (n + v + 1)) for c in counts), model.score(t)))
    for d in want:
        have = sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got if r["doc_id"] == d)
        for a, b in zip(have, sorted(want[d]), strict=True):
            assert a[:2] == b[:2] and all(abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a[2:], b[2:], strict=True)), (d, a, b)
    assert {r["train_tokens"] for r in got} == {n}


def test_passages(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"term{i}" for i in range(5000)]
    prose = lambda n: rng.choice(vocabulary, n).tolist()
    shared, edited = prose(70), prose(120)
    changed = edited.copy()
    changed[60] = "edit"
    texts = [prose(200) + shared + prose(50), prose(30) + shared + prose(300), prose(20) + edited, changed + prose(90), prose(400), prose(400), prose(40)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(7, " ".join(texts[4])), (8, None), (9, ""), (None, " ".join(texts[6])), (8, None), (10, "a b " * 3000)]
    got = {(r["doc_id"], r["class_id"]) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6), (7, 4), (8, 8), (9, 8), (None, 6), (10, 10)}


@pytest.mark.parametrize("table", ["odd", "real"])
def test_mixing(table, request):
    docs = request.getfixturevalue(table)
    got = mixing.mix_taken(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    assert multiset((r["doc_id"], r["size"]) for r in got) == multiset((r["doc_id"], len((r["text"] or "").encode().split())) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    want, taken = brute.targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.01 * want[s])
    assert multiset(got) == multiset(mixing.mix_taken(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].encode().split())
    assert words == Counter({s: n for s, n in taken.items() if n})


def test_mixed_texts_keep_white_space(spark):
    """Words that follow each other in a text that is taken in part keep what stands between them."""
    gap = lambda i: "\n\n    " if i % 5 == 0 else "\t" if i % 7 == 0 else " "
    text = {d: "".join(f"d{d}w{i}{gap(i)}" for i in range(1000 + 37 * d)) for d in range(3)}
    docs = spark.createDataFrame([(d, t, "en", f"s{d}", len(t)) for d, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(docs).collect()
    assert any(r["text"] != text[r["doc_id"]] for r in got)
    for r in got:
        w = r["text"].split()
        assert r["n_chars"] == len(r["text"]) and w == sorted(w, key=lambda x: int(x.split("w")[1]))
        assert r["text"].rstrip() == "".join(x + gap(int(x.split("w")[1])) for x in w).rstrip()


def test_mixing_takes_what_the_slots_say(real):
    """taken of every document against a count over its words, and the draw of the slots."""
    sized = real.select("doc_id", "source", mixing.n_words(mixing.text_of()).alias("size"), *mixing.text_key())
    targets, (rows, total) = mixing.source_targets(sized), mixing.size_of(sized)
    slots = mixing.drawn_slots(targets, total).collect()
    times, shards = Counter((r["source"], r["block"]) for r in slots), defaultdict(set)
    for r in slots:
        shards[r["source"], r["block"]].add(r["out_shard"])
    assert len({(r["source"], r["epoch"], r["block"]) for r in slots}) == len(slots)  # an epoch is a permutation
    counts = mixing.drawn_counts(targets, total).collect()
    assert Counter((r["source"], r["out_shard"]) for r in slots) == Counter({(r["source"], r["out_shard"]): r["count"] for r in counts})
    for t in targets.collect():
        own = [r["count"] for r in counts if r["source"] == t["source"]]
        n = -(-t["source_size"] // mixing.BLOCK)
        assert sum(own) == round(t["target"] * n / t["source_size"])
        mean = sum(own) / mixing.SHARDS  # chi-square of a multinomial draw with 15 degrees of freedom
        chi = sum((c - mean) ** 2 / mean for c in own) + (mixing.SHARDS - len(own)) * mean
        assert 1 < chi < 60, chi
    want = Counter()
    for r in mixing.with_starts(sized.where("size > 0"), rows).collect():
        places = range(r["start"], r["start"] + r["size"])
        blocks = {(r["source"], p // mixing.BLOCK) for p in places}
        own = sum(times[r["source"], p // mixing.BLOCK] for p in places)
        want[r["doc_id"], r["size"], own, ",".join(map(str, sorted(set().union(*(shards[b] for b in blocks)))))] += 1
    assert multiset((r["doc_id"], r["size"], r["taken"], r["out_shards"]) for r in mixing.mix_taken(real).collect() if r["size"]) == want
    split = Counter()
    for r in mixing.mixed_documents(real, by_shard=True).collect():
        split[r["out_shard"]] += len(r["text"].encode().split())
    whole = sum(r["taken"] for r in mixing.mix_taken(real).collect())
    assert sum(split.values()) == whole and len(split) == mixing.SHARDS


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).toPandas()["x"]
        assert sorted(x) == list(range(n))


@pytest.mark.parametrize("table", ["odd", "real"])
def test_bpe(table, request):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    docs = request.getfixturevalue(table)
    want = []
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert multiset(bpe.encode_documents(docs, tokenizer_path()).collect()) == multiset(want)


def test_bpe_on_random_bytes_of_text():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.BytePairs(open(tokenizer_path(), encoding="utf-8").read())
    rng = np.random.default_rng(4)
    letters = list("aabcdeeesstti  \n\t.,'’-012éß漢😀  x") + ["ing", "the", "'ll", "'S", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        ids = own.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("table", ["odd", "real"])
def test_media(table, request):
    docs = request.getfixturevalue(table)
    got = media.document_media(docs).collect()
    want = Counter()
    for d, t in pairs(docs):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert multiset((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
        assert r["caption"] == f"{r['n_bytes']} bytes of text" and r["media_sha256"] and r["position"] in (0, 1) and r["n_items"] <= 3
    assert all(len(x) == 1 for x in same.values())


def test_media_features_and_files():
    """Feature against a sum sample by sample; stored files are PNG images; damage is seen."""
    rng = np.random.default_rng(2)
    for n in (1, 3):
        raw = rng.integers(0, 256, n * media.TILE).astype(np.uint8).tobytes()
        tile = [sum(raw[t * media.TILE + i] for t in range(n)) / n for i in range(media.TILE)]
        edges = [0, 3, 6, 9, 12, 14, 16, 18, 21, 24]
        cell = lambda r, c: sum(tile[y * 24 + x] for y in range(3 * r, 3 * r + 3) for x in range(edges[c], edges[c + 1])) / (edges[c + 1] - edges[c])
        bits = "".join("1" if cell(r, c + 1) > cell(r, c) else "0" for r in range(8) for c in range(8))
        mean = sum(raw) / len(raw)
        std = math.sqrt(sum((x - mean) ** 2 for x in raw) / len(raw))
        assert media.feature(raw) == f"{int(bits, 2):016x}:{mean:.4f}:{std:.4f}"
        stored = media.store(raw)
        assert stored[:8] == b"\x89PNG\r\n\x1a\n" and media.load(stored) == raw
        with pytest.raises(ValueError, match="damaged|not"):
            media.load(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


def test_references_without_a_payload_keep_their_place(spark):
    html = "<p>one</p><img src='sha256:aa' alt='A'><p>two</p><img src='sha256:bb'>"
    pages = spark.createDataFrame([(1, html, "x"), (2, "", "x"), (3, "<p>" + "long " * 50_000 + "<img src='sha256:aa'>", "x")], "page_id long, html string, digest string")
    payloads = spark.createDataFrame([("aa", 5)], "digest string, size int")
    got = media.resolved(media.interleaved(pages), payloads, "page_id").select("page_id", "position", "digest", "caption", "size").collect()
    assert multiset(got) == multiset([(1, 1, "aa", "A", 5), (1, 3, "bb", None, None), (3, 1, "aa", None, 5)])


def test_sequences_of_the_pages(spark):
    """All pages: the items' texts are the page's visible words in order, and every image is there in its place."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in media.interleaved(pages).collect():
        html = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "", raw[r["page_id"]])
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))
        assert sum(x["kind"] == "media" for x in r["items"]) == len(re.findall(r"(?i)<(?:img|video|audio|source|embed)\b[^>]*\bsrc\s*=", html))
        words = unescape(re.sub(r"<[^>]*>", " ", html)).split()
        own = " ".join(x["text"] or x["caption"] or "" for x in r["items"]).split()
        assert Counter("".join(own)) <= Counter("".join(words) + "".join(raw[r["page_id"]])) and len("".join(own)) >= 0.95 * len("".join(words))


def test_sequences(spark):
    html = "<p>one<img src='a' alt='A'>two</p><script>no</script><figure><img src='b'><figcaption>cap &amp; tion</figcaption></figure>tail"
    got = media.interleaved(spark.createDataFrame([(1, html), (2, None), (3, "<p")], "page_id long, html string")).collect()
    items = {r["page_id"]: [(x["kind"], x["text"], x["media"], x["caption"]) for x in r["items"]] for r in got}
    assert items[1] == [("text", "one", None, None), ("media", None, "a", "A"), ("text", "two", None, None), ("media", None, "b", "cap & tion"), ("text", "tail", None, None)]
    assert items[2] == []


@pytest.mark.parametrize("table", ["odd", "real"])
def test_pii(table, request):
    docs = request.getfixturevalue(table)
    got = pii.find_pii(docs).collect()
    want, texts = Counter(), defaultdict(list)
    for d, t in pairs(docs):
        base = brute.base_spans(t)
        n = Counter(k for k, *_ in base)
        want[d, n["email"], n["ip"], n["card"], n["phone"], brute.digest(base)] += 1
        texts[d].append(base)
    assert multiset((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        base = [(k, int(a), int(b)) for k, a, b in spans if k != "term"]
        assert base in texts[r["doc_id"]]


def test_pii_on_hard_texts(spark):
    rng = np.random.default_rng(6)
    parts = ["a@b.c", "@", ".", "a.b@c-d.e.f", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 567-8901", "++12", " ", "-", "x", "12", "007.08.9.1", "٣", "é@x.y", "a@b@c.d", "%+-@a.b", "0" * 25]
    rows = [(i, "".join(rng.choice(parts, rng.integers(1, 9)))) for i in range(1500)]
    rows += [(9000, "a" * 200_000), (9001, "1." * 100_000), (9002, "@a" * 100_000), (9003, "1 " * 100_000), (9004, "+1" * 50_000)]
    got = {r["doc_id"]: r["base_sha256"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows[:1500]:
        assert got[d] == brute.digest(brute.base_spans(t)), (d, t)
    assert len(got) == len(rows)


def test_disclosing_terms(spark):
    """A term seen nearly only beside one entity discloses it; common words and copies alone do not."""
    rows = [(i, f"report {i} says that agent Zanzibar{'x' * (i % 1)} wrote from spy@agency.org about topic number {i * 7}") for i in range(6)]
    rows += [(100 + i, f"plain text number {i} says that nothing about the topic wrote itself report") for i in range(40)]
    rows += [(200 + i, "solitary mention beside lone@copy.org") for i in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    terms = {d: {text[d][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in x.split(",") if s) if k == "term"} for d, x in got.items()}
    assert all("zanzibar" in terms[d] and "says" not in terms[d] for d in range(6))
    assert all(not terms[d] for d in terms if d >= 100)
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert len(out) == len(rows) and "zanzibar" not in out[0].lower() and "[EMAIL]" in out[0] and out[100] == text[100]


@pytest.mark.parametrize("f", [sharding.pack_shards, simhash.near_duplicates, ppm.score_texts, passages.repeated_passages, mixing.mix_taken, media.document_media, pii.find_pii, mixing.mixed_documents, simhash.one_of_each, pii.sanitised], ids=lambda f: f.__name__)
def test_empty_tables(f, none):
    assert f(none).count() == 0


def test_empty_tables_of_the_others(none, spark, labels):
    assert quality.score_documents(none, labels).count() == 0
    assert quality.good_documents(none, labels).count() == 0
    assert bpe.encode_documents(none, tokenizer_path()).count() == 0
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_groups_of_awkward_rows(odd):
    """Wordless texts are one group; texts of fewer than five words group as whole sequences."""
    rows = pairs(odd)
    shingles = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := brute.words((t or "").lower())) else frozenset() for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    rank = [(d is None, d or 0) for d, _ in rows]
    kept = Counter(rows[i][0] for i in range(len(rows)) if rank[i] == min(rank[j] for j in range(len(rows)) if alike(shingles[i], shingles[j])))
    assert Counter(r["doc_id"] for r in simhash.one_of_each(odd).collect()) == Counter(dict.fromkeys(kept, 1))


def test_passages_of_awkward_rows(odd):
    """Equal texts and near passages share the smallest id; rows without an id come with their class."""
    rows = pairs(odd)
    story = min(d for d, t in rows if t and t.lower().startswith("word0 and then word1"))
    got = multiset(passages.repeated_passages(odd).select("doc_id", "class_id").collect())
    own = {}
    for d, t in rows:
        if d is not None:
            own[t or ""] = min(d, own.get(t or "", d))
    want = Counter()
    for d, t in rows:
        want[d, story if t and t.lower().startswith("word0 and then word1") else own.get(t or "")] += 1
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == Counter({k: n for k, n in want.items() if k[0] is not None})
    assert sum(n for (d, _), n in got.items() if d is None) == 2


def test_sanitised_awkward_rows(odd):
    rows = odd.select("doc_id", "text", "lang", "source").collect()
    want = Counter()
    for (d, t, lang, source), spans in zip(rows, brute.all_spans([r["text"] for r in rows]), strict=True):
        for kind, a, b in sorted(spans, key=lambda x: -x[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[d, t, lang, source] += 1
    assert multiset(pii.sanitised(odd).select("doc_id", "text", "lang", "source").collect()) == want


def test_mixed_awkward_rows_have_the_words_taken(odd):
    counted, taken = Counter(), Counter()
    for r in mixing.mixed_documents(odd).collect():
        counted[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mix_taken(odd).collect():
        taken[r["doc_id"]] += r["taken"]
    assert counted == +taken and set(taken) == {d for d, _ in pairs(odd)}


def test_neighbours_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCKS", (64, 64))
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, (900, 6)).astype(np.float32) + np.array([0, 0, 0, 0, 0, 3], np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(900), x, strict=True)]
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), target=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    held = dict(rows)
    for q in range(0, 900, 20):
        want = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in rows if i != q)[:20]
        assert got[q] == [(i, -s) for s, i in want]


def test_near_copies_are_dropped(spark):
    """Edited copies of similarity 0.8 to 0.95 and chains of them against brute force; texts under 0.8 all stay."""
    rng = np.random.default_rng(12)
    vocabulary = [f"term{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = rng.choice(vocabulary, 200).tolist()
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            t = base.copy()
            for at in rng.choice(200, edits, replace=False):
                t[at] = f"edit{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(t)))
    base = rng.choice(vocabulary, 300).tolist()
    for i in range(30):  # each near the next, the ends have nothing in common
        rows.append((len(rows), " ".join(base[i * 6 : i * 6 + 120])))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root, direct = list(range(len(rows))), 0
    for j in range(len(rows)):
        for i in range(j):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                direct += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    want = set(root)
    assert want <= got, "a text without a near copy was dropped"
    assert direct > 300 and len(got - want) <= 0.01 * (len(rows) - len(want)), got - want


@pytest.mark.parametrize("table", ["odd", "real"])
def test_tokens_and_media_are_kept(table, request, monkeypatch):
    """The operators give the tokens, their text and the stored bytes of every document, not only digests."""
    docs = request.getfixturevalue(table)
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    monkeypatch.setattr(bpe, "PART", 1000)  # many parts a batch
    stage = dict(corpus_pipeline.STAGES)["encoding"]
    got = multiset((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in stage(docs.sparkSession, docs, SF).collect())
    want = Counter()
    for d, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    stored = {r["digest"]: bytes(r["media"]) for r in media.stored_media(docs).collect()}
    assert all(hashlib.sha256(m).hexdigest() == d for d, m in stored.items())
    assert {media.load(m) for m in stored.values()} == {media.padded(t)[1] for _, t in pairs(docs)}


def test_terms_far_from_their_entity_disclose_it(spark):
    """Short names and names over a window away from the entity count, and every occurrence is marked."""
    filler = " ".join(f"word{i} and so on" for i in range(60))
    rows = [(i, f"Headline by Lee {i}. {filler} Sent from lee7@agency.org. {filler} Signed: LEE, not Leeward.") for i in range(5)]
    rows += [(100 + i, f"Leeward text {i} sent, signed: headline by not from. {filler}") for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    text, got = dict(rows), {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    spans = {d: [s.split(":") for s in x.split(",") if s] for d, x in got.items()}
    assert all([text[d][int(a) : int(b)] for k, a, b in spans[d] if k == "term"] == ["Lee", "LEE"] for d in range(5)), spans[0]
    assert all(not spans[d] for d in range(100, 140))
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert out[0].startswith("Headline by [TERM] 0.") and out[0].endswith("Signed: [TERM], not Leeward.") and "[EMAIL]" in out[0] and out[100] == text[100]


def test_terms_and_spans_against_all_pairs(spark):
    """Entities of one text and of many, frequent and rare terms, copies, and more matches than one run numbers."""
    rng = np.random.default_rng(17)
    people = [f"p{i}@mail{i}.org" for i in range(25)]
    names = [f"Name{chr(97 + i)}" for i in range(25)]
    prose = lambda n: [f"w{chr(97 + x // 26 % 26)}{chr(97 + x % 26)}" for x in rng.zipf(1.4, n) % 600]
    texts = []
    for i in range(160):
        who = rng.integers(0, 25, int(rng.integers(0, 4)))
        parts = prose(int(rng.integers(5, 40))) + [people[k] for k in who] + [names[k] for k in who if rng.random() < 0.9] + [f"only{i}@once.net"] * (i % 5 == 0)
        texts.append(" ".join(rng.permutation(parts)))
    texts += texts[:20] + [None, "", " ".join(f"a{i}@many.org {names[0]} {people[0]}" for i in range(700))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.all_spans(texts)
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(w, key=lambda x: (x[0] == "term", ["email", "ip", "card", "phone", "term"].index(x[0]), x[1]))) for i, w in enumerate(want)}
    assert sum(k == "term" for w in want for k, *_ in w) > 100
