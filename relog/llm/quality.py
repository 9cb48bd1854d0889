"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, crc_mod, n_words, text_of

#: Words in a passage.
PASSAGE = 64
#: Passages of a text that are encoded at a time.
SLICE = 2048
#: Bounds of the labelled training sample: the documents with the smallest hashes of doc_id, so many and
#: with so many passages together.
TRAIN_ROWS, TRAIN_PASSAGES = 6000, 40_000
#: Kinds of byte trigrams, of words and of pairs of words that the encoder tells apart, by hash.
GRAMS, WORDS, PAIRS = 512, 256, 256
FEATURES = GRAMS + WORDS + PAIRS + 3
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 25, 256, 0.01, 1e-3
#: Passage features, which lie between 0 and log(65) / 4, go to the learning task in steps of 1 / STEPS, a byte each.
STEPS = 240
CUT = 0.3
FOLDS, HELD_OUT = 5, 0
#: White space of ASCII.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)


def _bucket(h: np.ndarray, kinds: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % kinds


def encode_passages(text: str) -> np.ndarray:
    """Hashed n-grams of every passage of a text, passages x FEATURES: roots of the shares that kinds of byte
    trigrams, of words and of pairs of words have of the passage, then its length and the shares of different
    words and of words that repeat the one before. What they mean is learned. Roots let a weighted sum tell
    a passage of many kinds from one of few. A text without words is one passage of zeros."""
    return np.concatenate(list(encode_slices(text)))


def encode_slices(text: str, passages: int = SLICE) -> Iterator[np.ndarray]:
    """The rows of encode_passages, so many passages at a time: memory beside the text and its words' places
    is that of one slice."""
    b = np.frombuffer(text.encode(), np.uint8)
    solid = ~SPACES[b]
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])) if len(b) else np.zeros(0, np.int64)
    if not len(starts):
        yield np.zeros((1, FEATURES), np.float32)
        return
    before = None  # hash of the word before the slice
    for w in range(0, len(starts), passages * PASSAGE):
        own = starts[w : w + passages * PASSAGE]
        begin = own[0] if w else 0
        end = starts[w + passages * PASSAGE] if w + passages * PASSAGE < len(starts) else len(b)
        context = min(2, begin)  # bytes that the first trigrams reach back
        rows, before = _encoded(b[begin - context : end], context, own - begin, before)
        yield rows


def _encoded(b: np.ndarray, context: int, starts: np.ndarray, before: np.uint64 | None) -> tuple[np.ndarray, np.uint64]:
    """Rows of the passages of bytes b but for the first `context` ones, with words from starts on, and the last word's hash."""
    first = starts[::PASSAGE]
    p = len(first)
    gram = np.zeros(len(b), np.uint64)
    for back in range(3):
        gram[back:] += _MIX[b[: len(b) - back]] * np.uint64(2 * back + 1)
    gram, b = gram[context:], b[context:]
    sizes = np.diff(np.concatenate([[0], first[1:], [len(b)]]))
    counts = np.bincount(np.repeat(np.arange(p) * GRAMS, sizes) + _bucket(gram, GRAMS), minlength=p * GRAMS).reshape(p, GRAMS)
    word = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([[0], starts[1:], [len(b)]])))
    place = (np.arange(len(b)) - starts[word]).astype(np.uint64)
    hashes = np.add.reduceat(np.where(~SPACES[b], _MIX[b] * (place * np.uint64(2) + np.uint64(1)), 0), starts)
    own = np.arange(len(hashes)) // PASSAGE
    words = np.bincount(own * WORDS + _bucket(hashes, WORDS), minlength=p * WORDS).reshape(p, WORDS)
    two = hashes + np.concatenate([hashes[:1] if before is None else [before], hashes[:-1]]) * np.uint64(3)
    pairs = np.bincount(own * PAIRS + _bucket(two, PAIRS), minlength=p * PAIRS).reshape(p, PAIRS)
    shares = [x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (counts, words, pairs)]
    at = np.arange(0, len(hashes), PASSAGE)
    held = np.diff(np.append(at, len(hashes)))
    by = np.lexsort((hashes, own))
    fresh = np.concatenate([[True], (hashes[by][1:] != hashes[by][:-1]) | (own[1:] != own[:-1])])
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])])
    shape = [np.log1p(held) / 4, np.add.reduceat(fresh, at, dtype=np.int64) / held, np.add.reduceat(again, at, dtype=np.int64) / held]
    return np.column_stack([np.sqrt(np.concatenate(shares, axis=1)), *shape]).astype(np.float32), hashes[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Passage encoder, gated attention and the document's score; weights as plain arrays."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of passages x: standardised features, hidden values, both gates, and the attention before its softmax."""
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["e"] + w["eb"])
        v, u = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        return x, h, v, u, (v * u) @ w["a"]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all documents, one after the other; first: where each document begins."""
        w, size = self.w, np.diff(np.append(first, len(x)))
        x, h, v, u, s = self.encoded(x)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
        a = s / np.repeat(np.add.reduceat(s, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["cb"][0]), "size": size}

    def score(self, text: str, passages: int = SLICE) -> float:
        """The score of a text as forward gives it, with its attention summed up slice by slice."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in encode_slices(text, passages):
            _, h, _, _, s = self.encoded(x)
            new = max(top, s.max())
            e, kept = np.exp(s - new), np.exp(top - new)
            top, total, z = new, total * kept + e.sum(), z * kept + e @ h
        return float(_sigmoid(z / total @ self.w["c"] + self.w["cb"][0]))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, o = self.w, self.forward(x, first)
        g = (o["p"] - y) / len(y)
        dz = np.repeat(g[:, None] * w["c"], o["size"], axis=0)
        da = (dz * o["h"]).sum(axis=1)
        ds = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, first), o["size"]))
        dv, du = ds[:, None] * w["a"] * o["u"] * (1 - o["v"] ** 2), ds[:, None] * w["a"] * o["v"] * o["u"] * (1 - o["u"])
        dh = (o["a"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - o["h"] ** 2)
        out = {"c": o["z"].T @ g, "cb": np.array([g.sum()]), "a": (o["v"] * o["u"]).T @ ds, "v": o["h"].T @ dv, "u": o["h"].T @ du, "e": o["x"].T @ dh, "eb": dh.sum(axis=0)}
        return {k: d + DECAY * w[k] for k, d in out.items()}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0, unit: float = 1.0) -> AttentionModel:
    """Adam on the log loss of document labels; bags hold features in multiples of unit. Without labels, or with one class, the bias alone is set."""
    rng = np.random.default_rng(seed)
    n = bags[0].shape[1] if bags else FEATURES
    rows, total, squares = 0, np.zeros(n), np.zeros(n)
    for at in range(0, len(bags), BATCH):  # a batch at a time, as in the epochs: bags may be bytes
        x = np.concatenate(bags[at : at + BATCH]).astype(np.float64) * unit
        rows, total, squares = rows + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
    mean = total / max(rows, 1)
    scale = np.sqrt(np.maximum(squares / max(rows, 1) - mean * mean, 0)) + 0.01
    w = {"e": rng.normal(0, n**-0.5, (n, HIDDEN)), "eb": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "cb": np.zeros(1)}
    model = AttentionModel(mean.astype(np.float32), scale.astype(np.float32), w)
    if len(set(labels.tolist())) < 2:
        w["cb"][0] = 4.0 if not len(labels) or labels[0] else -4.0
        return model
    m, r, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(bags[i]) for i in some])
            grads, t = model.gradients(np.concatenate([bags[i] for i in some]) * np.float32(unit), np.cumsum(sizes) - sizes, labels[some]), t + 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                r[k] = 0.999 * r[k] + 0.001 * g * g
                w[k] -= RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(r[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _packed(model: AttentionModel) -> bytes:
    out = io.BytesIO()
    np.savez(out, mean=model.mean, scale=model.scale, **{f"w_{k}": x for k, x in model.w.items()})
    return out.getvalue()


def _unpacked(b: bytes) -> AttentionModel:
    with np.load(io.BytesIO(b)) as x:
        return AttentionModel(x["mean"], x["scale"], {k[2:]: x[k] for k in x.files if k.startswith("w_")})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> AttentionModel:
    """Learn from labelled documents outside the held-out fold: at most `rows`, the smallest hashes of doc_id
    first, as long as their texts have at most `passages` passages together; a text of over a twentieth of
    these is not learned from. A document's label is the smallest it has, and of several texts of one doc_id
    the one of the smallest hash counts. Passages are encoded in many tasks; one task learns from this
    bounded sample, and the model alone (some 300 kB) reaches the driver."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(crc_mod("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    chosen = chosen.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.col("text").cast("string")
    held = checkpoint(docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    counted = held.select("doc_id", (F.floor(n_words(text_of()) / PASSAGE) + 1).alias("n")).where(F.col("n") * 20 <= passages)
    upto = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over `rows` pairs of numbers
    within = counted.withColumn("upto", upto).where(F.col("upto") <= passages).select("doc_id")
    sample = held.join(F.broadcast(within), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [np.rint(encode_passages(t.as_py() or "") * STEPS).astype(np.uint8).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((row for b in batches for row in zip(b.column("doc_id").to_pylist(), b.column("quality").to_pylist(), b.column("bag").to_pylist(), strict=True)), key=lambda x: x[0])
        model = fit([np.frombuffer(bag, np.uint8).reshape(-1, FEATURES) for _, _, bag in got], np.array([q for _, q, _ in got]), unit=1 / STEPS)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(model)], pa.binary())], names=["model"])

    encoded = sample.repartition(16, "doc_id").mapInArrow(encode, "doc_id long, quality double, bag binary")
    got = encoded.repartition(1).mapInArrow(learn, "model binary").first()
    return _unpacked(got["model"]) if got else fit([], np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better quality), predicted of docs (doc_id, text), after
    learning from labels (doc_id, quality).

    The score depends on the text alone: null and empty texts are one passage without words. Null ids
    are in no fold's held-out part; repeated ids and rows are all scored. Without usable labels every
    document counts as good. An empty table gives an empty result. Every row stays in its task; the
    model (some 300 kB) goes along with the function."""
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without those that the classifier rejects; the text is
    scored where it is read, so nothing is joined or shuffled."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "") >= CUT for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
