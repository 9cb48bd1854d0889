"""Token counts, whitening and the filter audit against the library and plain versions of their contracts."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from relog.llm import audit, transducer, whitening
from relog.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
MODEL = tokenizer_path("piece_bpe_32k.model")
ALPHABETS = ["a", "aab", "-", "=- ", " ab", "in the of ing er", "a \n\t▁", "あいうえ執ゼ", "é́1234 😀☃", "abcdefghijklmnopqrstuvwxyz", "▁ ", "/#*=-", "<s></s><unk><0x0A>", "\x00​퟿１ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def made():
    with open(MODEL, "rb") as f:
        return transducer.Transducer(f.read())


def random_texts(n, longest, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        letters = r.choice(ALPHABETS) + r.choice(["", r.choice(ALPHABETS)])
        yield "".join(r.choice(letters) for _ in range(r.randint(0, longest)))


def test_transducer_counts_as_the_library(made, library):
    for text in random_texts(4000, 60):
        assert made.count(text) == len(library.encode(text)), text


def test_state_maps_compose_in_any_grouping(made, library):
    r = random.Random(3)
    for text in random_texts(1500, 200, seed=2):
        whole, size = transducer.marked(text), r.randint(1, 40)
        maps = [transducer.state_map(made, whole[max(0, i - transducer.BEFORE) : i], whole[i : i + size]) for i in range(0, len(whole), size)]
        at = r.randint(1, len(maps))
        halves = [transducer.composed(made, part) for part in (maps[:at], maps[at:]) if part]
        expected = len(library.encode(text)) if text else 1  # the mark of an empty text, which count_tokens never cuts
        assert transducer.composed(made, halves)(made, transducer.START)[1] == expected, text
        assert transducer.composed(made, maps)(made, transducer.START)[1] == expected, text


def test_states_and_words_are_forgotten_without_a_change(library, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT", 50)
    with open(MODEL, "rb") as f:
        small = transducer.Transducer(f.read())
    for text in random_texts(300, 80, seed=4):
        assert small.count(text) == len(library.encode(text))


def test_another_model_is_refused():
    with pytest.raises(Exception):
        transducer.Transducer(b"no model")


@pytest.mark.parametrize("part", [37, 1000, transducer.PART])
def test_token_counts(spark, library, part):
    r = random.Random(7)
    texts = [None, "", " ", "\n", "a", "a" * 5000, "-" * 3001, "x " * 3000, " " * 700, "é漢字 😀 <s>", *random_texts(60, 300, seed=8)]
    texts += ["".join(r.choice("ab") for _ in range(2500))] * 40  # copies of a text in parts
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (3, "\n", "x", 1), (3, "\n", "x", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, no long").repartition(5)
    got = transducer.count_tokens(docs, MODEL, limit=100, part=part)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = [len(library.encode(t or "")) for _, t, *_ in rows]
    assert Counter(map(tuple, got.collect())) == Counter((d, len((t or "").encode()), k, k > 100) for (d, t, *_), k in zip(rows, n, strict=True))


def test_token_counts_of_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in transducer.count_tokens(docs, MODEL).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.select("doc_id", "text").collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert transducer.count_tokens(docs, MODEL).collect() == []
    assert audit.filter_audit(docs, labels).collect() == []
    vectors = spark.createDataFrame([(1, None), (2, []), (3, [float("nan")])], "vec_id long, embedding array<float>")
    assert whitening.whitened_vectors(vectors).collect() == []
    assert whitening.whitened_vectors(vectors.limit(0)).collect() == []


def plain_whitening(rows, k=8):
    """vec_id, deviation, whitened of each row, and e/trace, by a full eigendecomposition."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(dim)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    c = (np.array(x) * n - np.array(sums)) / n
    e, b = np.linalg.eigh(c.T @ c / n)
    e, b = e[::-1][:k], b[:, ::-1][:, :k]
    return deviation, c @ b / np.sqrt(e), e / (np.square(c).sum() / n)


def check_whitening(got, rows, k=8):
    deviation, white, explained = plain_whitening(rows, k)
    k = white.shape[1]
    assert len(got) == len(rows) * k
    table = defaultdict(list)
    for r in got:
        table[r["vec_id"]].append(r)
    same_sign = {}
    for (i, _), d, w in zip(rows, deviation, white, strict=True):
        for r in table[i]:
            j = r["component"] - 1
            assert r["n"] == len(rows) and r["deviation"] == d and r["identity_error"] < 1e-9
            assert abs(r["explained"] / explained[j] - 1) < 1e-9
            if abs(w[j]) > 1e-6:
                same_sign.setdefault(j, np.sign(w[j] * r["whitened"]))
                assert r["whitened"] == pytest.approx(w[j] * same_sign[j], abs=1e-6)


def test_whitening_of_all_embeddings(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    check_whitening(whitening.whitened_vectors(vectors).collect(), rows)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=3).astype(np.float32) * [1, 5, 0.1]]) for i in range(200)]
    good += [good[7][:1] + (good[7][1],), (-4, [0.0, 0.0, 0.0])]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [float("inf"), 0.0, 0.0]), (903, [float("nan")] * 3), (904, []), (905, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, "x", 5) for r in good + bad], "vec_id long, embedding array<float>, x string, n int").repartition(4)
    got = [r for r in whitening.whitened_vectors(vectors).collect() if r["vec_id"] != 7]
    deviation, white, explained = plain_whitening(good)
    assert {r["vec_id"] for r in got} == {i for i, _ in good} - {7} and len(got) == 3 * 200
    by_id = {i: d for (i, _), d in zip(good, deviation, strict=True)}
    assert all(r["deviation"] == by_id[r["vec_id"]] and r["n"] == 202 and r["identity_error"] < 1e-9 for r in got)
    assert {r["component"]: round(r["explained"], 9) for r in got} == {j + 1: round(float(e), 9) for j, e in enumerate(explained)}


def test_whitening_without_variance(spark):
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = whitening.whitened_vectors(vectors).collect()
    assert len(got) == 6 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (0.0, 0.0, 0, 1.0) for r in got)


@pytest.mark.parametrize(("dim", "shape"), [(120, "isotropic"), (120, "falling"), (200, "rank 3"), (30, "equal pair")])
def test_lobpcg(dim, shape):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(dim * 4, dim))
    x *= {"isotropic": np.ones(dim), "falling": np.geomspace(1, 1e-3, dim), "rank 3": np.arange(dim) < 3, "equal pair": 1.0}[shape]
    v = x.T @ x / len(x)
    if shape == "equal pair":
        q, _ = np.linalg.qr(x[:dim])
        v = q @ np.diag([5.0, 5.0, *np.linspace(2, 1, dim - 2)]) @ q.T
    e, b = whitening.lobpcg(lambda block: v @ block, dim, 8)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-10, atol=1e-12)
    assert np.abs(b.T @ b - np.eye(8)).max() < 1e-12 and np.abs(v @ b - b * e).max() < 1e-11 * e[0]


def plain_audit(docs, labels):
    """All rows by walking through every document in every order."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    facts = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        facts.append((s or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, shapley = Counter(), Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                row = [0] * 6
                for p, fails, g, x in facts:
                    if p == part:
                        gone = any(fails[b] for b in order[: step - 1])
                        row[0] += not gone and not fails[f]
                        row[1] += not gone and fails[f]
                        row[2] += gone and fails[f]
                        row[3] += [k for k, v in fails.items() if v] == [f]
                        row[4] += g and not gone and fails[f]
                        row[5] += x and not gone and fails[f]
                out[part, order, step, *row] += 1
                shapley[part, f] += row[1]
    return Counter({(*k, shapley[k[0], k[1][k[2] - 1]]): n for k, n in out.items()})


def audit_rows(seed=1):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "é", "漢字", "a|b", "50%"]
    texts = [None, "", " ", "ABC", " ".join(f"w{i}" for i in range(250)), "same " * 300, "same " * 300 + "#"] + [" ".join(r.choice(words) for _ in range(r.choice([5, 150, 260]))) for _ in range(20)]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)]
    return rows + [rows[0], rows[0], (None, None, None), (-3, texts[4], "a"), (60, texts[4], "hot")] + [(100 + i, texts[5], "hot") for i in range(60)]


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(4, 1, None), (None, 1, 1), (5, None, 1), (105, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(6)
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_texts_that_share_a_fingerprint_stay_apart(spark, monkeypatch):
    rows = audit_rows(2)
    routed = [(0, (t or "").encode(), d, None, {s or "": 1}) for d, t, s in rows if d is not None]
    chains, out = audit.Chains(), []
    for r in routed:
        done = chains.add(*r)
        if done:
            out.append(done)
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    expected = Counter(d for d, t, _ in rows if d is not None and d > least[t or ""])
    assert Counter({d: n for d, n in expected.items()}) == sum((Counter({d: sum(p.values())}) for d, m, p in out if m & audit.COPY), Counter())
    assert {(t, d) for _, t, d, _, _ in chains.drained()} == {(t.encode(), d) for t, d in least.items()}


def test_tasks_that_hold_little_send_the_same(monkeypatch):
    rows = [(d, s or "", (t or "").encode()) for d, t, s in audit_rows(5)]
    whole = list(audit.copies(sorted(audit.routed(rows), key=lambda r: r[0])))
    monkeypatch.setattr(audit, "HELD", 100)
    flushed = list(audit.copies(sorted(audit.routed(rows), key=lambda r: r[0])))
    count = lambda facts: sum((Counter({(d, m, p): n for p, n in parts.items()}) for d, m, parts in facts), Counter())
    assert count(whole) == count(flushed)


def test_filter_audit_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = audit.filter_audit(docs, labels)
    assert Counter(map(tuple, got.collect())) == Counter(db.execute(audit.SQL).fetchall())
    assert got.select(F.countDistinct("filter_order")).first()[0] == 120
