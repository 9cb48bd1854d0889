"""Language-model scores by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod

#: Bytes of the longest context.
ORDER = 5
#: Bound of the frequent branches whose scores tasks look up themselves, about 48 MB; all others meet the
#: trie's tables in joins, with the same scores.
MAX_BRANCHES = 4_000_000
#: Bound of the frequent words that tasks look up themselves; all others meet their counts in a join.
MAX_WORDS = 262_144
#: Bytes that tasks hold for each of these words, on average; longer ones make it fewer words.
WORD_BYTES = 32
#: Bytes of different words that a task holds before it sends their counts on, but for one text's words.
HELD_BYTES = 1 << 25
FOLDS, HELD_OUT = 7, 2
#: Stands before and after every text; never a byte of UTF-8.
EDGE = 0xFF
#: Bytes that are worked on at once, and different branches that a task holds before it hands them on.
CHUNK, BRANCHES = 1_000_000, 2_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """For every byte of the texts and for each text's end: the byte after its context, as one number."""
    edge = bytes([EDGE])
    b = np.frombuffer(b"".join(edge * order + t + edge for t in texts), np.uint8)
    key = np.zeros(len(b), np.uint64)
    for j in range(order + 1):
        key[order:] = (key[order:] << np.uint64(8)) | b[j : len(b) - order + j]
    size = np.array([len(t) + order + 1 for t in texts])
    keep = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size) >= order
    return key[keep]


def in_chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Lookup:
    """Hash table from 64-bit keys to 32-bit floats; most lookups end in their first slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slots, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.float32)
        at, rest = self._hash(keys), np.arange(len(keys))
        while len(rest):
            free = self.slots[at] == EMPTY
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.values[at[first]] = keys[rest[first]], values[rest[first]]
            stay = np.ones(len(rest), bool)
            stay[first] = False
            at, rest = (at[stay] + 1) & ((1 << self.bits) - 1), rest[stay]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys (0 where there is none), and the places of the keys that have none."""
        at = self._hash(keys)
        got = self.slots[at]
        out = self.values[at].astype(np.float64)
        rest = np.flatnonzero((got != keys) & (got != EMPTY))
        missing = [np.flatnonzero(got == EMPTY)]
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            got, k = self.slots[at], keys[rest]
            hit, empty = got == k, got == EMPTY
            out[rest[hit]] = self.values[at[hit]]
            missing.append(rest[empty])
            rest, at = rest[~hit & ~empty], at[~hit & ~empty]
        none = np.concatenate(missing)
        out[none] = 0
        return out, none


def threshold(counted: DataFrame, n: str, size: str | Column, bound: int) -> int:
    """The smallest power of two t such that rows with n >= t have at most `bound` of size together (at
    most 64 rows reach the driver)."""
    by = {int(r[0]): int(r[1]) for r in counted.groupBy(F.floor(F.log2(n)).alias("p")).agg(F.sum(size)).collect()}
    t, total = 63, 0
    for p in range(63, -1, -1):
        total += by.get(p, 0)
        if total > bound:
            break
        t = p
    return 1 << t


def count_grams(training: DataFrame, order: int) -> DataFrame:
    """gram, n over the training texts: every task counts its own texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for chunk in in_chunks(lowered(t.as_py()) for batch in batches for t in batch.column("text")):
            k, c = np.unique(grams(chunk, order), return_counts=True)
            k, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            keys, n = k, np.bincount(at, np.concatenate([n, c]), len(k)).astype(np.int64)
            if len(keys) > BRANCHES:
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["gram", "n"])
                keys, n = keys[:0], n[:0]
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)].astype(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["gram", "n"])

    return training.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(training: DataFrame) -> DataFrame:
    """word, n over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0  # bytes of texts counted since the last rows

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.binary()), pa.array(n[at : at + (1 << 16)], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column("text"):
                text = lowered(t.as_py())
                held.update(text.split())
                size += len(text)
                if size > HELD_BYTES:
                    full, size = sum(map(len, held)) > HELD_BYTES, 0
                else:
                    full = len(held) > 500_000
                if full:
                    yield from out()
                    held.clear()
        yield from out()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_BUILT: list = []


def lookup_of(table: tuple[np.ndarray, np.ndarray]) -> Lookup:
    """The hash table of a broadcast table, built once in each Python worker; only the last one is kept."""
    if not _BUILT or _BUILT[0] is not table:
        _BUILT[:] = [table, Lookup(*table)]
    return _BUILT[1]


def low(bytes_: str) -> Column:
    """Mask of so many last bytes; bytes_ is a SQL expression."""
    return F.expr(f"shiftleft(1L, 8 * ({bytes_})) - 1")


@dataclass(frozen=True)
class Trie:
    """A static PPM model as tables. branches: j (bytes of context), key (context and next byte), n. nodes: j,
    context, total, kinds (different next bytes), and for j > 0 left and kinds_left: what the next shorter
    context has beside the bytes that this one has seen. frequent: score of branches of the longest
    contexts, the most frequent ones, at most max_branches. least: they have this count at least.

    Escapes are by method C: a context's number of different next bytes counts as escapes. Bytes that a
    longer context has seen are excluded below it; as a context's bytes are also bytes of each shorter one,
    what remains below depends on the longer context alone."""

    order: int
    branches: DataFrame
    nodes: DataFrame
    frequent: tuple[np.ndarray, np.ndarray]
    least: int

    def scores(self, grams_: DataFrame) -> DataFrame:
        """gram, value: log10 probability of the byte after its context, for different grams of (gram).

        Those that the longest context has seen end there; the others fetch their branches and nodes of all
        orders and go down these."""
        o, gram = self.order, F.col("gram")
        seen = seen_scores(self.branches, self.nodes, o)
        first = checkpoint(grams_.join(seen, "gram", "left"))
        orders = F.explode(F.sequence(F.lit(0), F.lit(o))).alias("j")
        steps = first.where("value is null").select("gram", orders).select("gram", "j", gram.bitwiseAND(low("j + 1")).alias("key"), F.shiftrightunsigned(gram, 8).bitwiseAND(low("j")).alias("context"))

        def meet(rows: DataFrame, branches: DataFrame, nodes: DataFrame) -> DataFrame:
            return rows.join(branches, ["j", "key"], "left").join(nodes, ["j", "context"], "left")

        # all grams share the context of order 0, and many one of order 1: at most 256 * 257 branches, 257 nodes
        short = meet(steps.where("j <= 1"), F.broadcast(self.branches.where("j <= 1")), F.broadcast(self.nodes.where("j <= 1")))
        met = short.unionByName(meet(steps.where("j > 1"), self.branches.where("j > 1"), self.nodes.where("j > 1")))
        down = F.sort_array(F.collect_list(F.struct((-F.col("j")).alias("up"), "n", "total", "kinds", "left", "kinds_left")))

        def step(acc: Column, x: Column) -> Column:
            below = acc["den"].isNotNull()
            den = F.when(below, acc["den"]).otherwise((x["total"] + x["kinds"]).cast("double"))
            escape = F.when(below, acc["escapes"]).otherwise(x["kinds"].cast("double"))
            here = F.when(acc["done"], acc["sum"]).when(x["n"].isNotNull(), acc["sum"] + F.log10(x["n"] / den)).otherwise(acc["sum"] + F.coalesce(F.log10(escape / den), F.lit(0.0)))
            left = F.when(x["left"].isNotNull(), F.greatest(x["left"] + x["kinds_left"], F.lit(1)).cast("double"))  # null: a context never seen
            # kinds_left 0: nothing remains below, the escape is certain
            escapes = F.when(x["kinds_left"] > 0, x["kinds_left"].cast("double")).otherwise(left)
            return F.struct((acc["done"] | x["n"].isNotNull()).alias("done"), here.alias("sum"), left.alias("den"), escapes.alias("escapes"))

        none = F.lit(None).cast("double")
        start = F.struct(F.lit(False).alias("done"), F.lit(0.0).alias("sum"), none.alias("den"), none.alias("escapes"))
        new_byte = F.log10(F.lit(float(max(1, 256 - self.branches.where("j = 0").count()))))
        ends = lambda acc: F.when(acc["done"], acc["sum"]).otherwise(acc["sum"] - new_byte)
        value = F.aggregate("down", start, step, ends).alias("value")
        fallen = met.groupBy("gram").agg(down.alias("down")).select("gram", value)  # order + 1 rows a gram
        return first.where("value is not null").unionByName(fallen)


def seen_scores(branches: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """gram, value of all branches of the longest contexts; 32 bits, as tasks hold them."""
    longest = branches.where(F.col("j") == order).select(F.col("key").alias("gram"), "n", F.shiftrightunsigned("key", 8).alias("context"))
    own = nodes.where(F.col("j") == order).select("context", (F.col("total") + F.col("kinds")).alias("den"))
    return longest.join(own, "context").select("gram", F.log10(F.col("n") / F.col("den")).cast("float").cast("double").alias("value"))


def train_trie(training: DataFrame, order: int, bound: int) -> Trie:
    """The trie of the training texts. Counts of all orders come from those of the longest; all of it stays
    in tables, and only the scores of the frequent branches reach the driver, about 12 bytes each."""
    top = count_grams(training, order)
    masked = F.array(*[F.struct(F.lit(j).alias("j"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")) for j in range(order + 1)])
    branches = checkpoint(top.select(F.explode(masked).alias("x"), "n").groupBy("x.j", "x.key").agg(F.sum("n").alias("n")))
    context = F.shiftrightunsigned("key", 8).alias("context")
    plain = checkpoint(branches.groupBy("j", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
    shorter = branches.where("j > 0").select((F.col("j") - 1).alias("j"), F.col("key").bitwiseAND(low("j")).alias("key"), context)
    lower = shorter.join(branches, ["j", "key"]).groupBy((F.col("j") + 1).alias("j"), "context").agg(F.sum("n").alias("held"))
    parent = plain.select((F.col("j") + 1).alias("j"), F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    joined = plain.withColumn("up", F.when(F.col("j") > 0, F.col("context").bitwiseAND(low("j - 1"))).otherwise(F.lit(0))).join(lower, ["j", "context"], "left").join(parent, ["j", "up"], "left")
    nodes = checkpoint(joined.select("j", "context", "total", "kinds", (F.col("up_total") - F.col("held")).alias("left"), (F.col("up_kinds") - F.col("kinds")).alias("kinds_left")))
    longest = branches.where(F.col("j") == order)
    least = threshold(longest, "n", F.lit(1), bound)
    got = seen_scores(branches.where((F.col("j") < order) | (F.col("n") >= least)), nodes, order).select("gram", F.col("value").cast("float").alias("value")).toArrow()
    return Trie(order, branches, nodes, (got.column("gram").to_numpy().astype(np.uint64), got.column("value").to_numpy()), least)


def score_texts(docs: DataFrame, order: int = ORDER, max_branches: int = MAX_BRANCHES, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text).

    score: log10 probability of the text's lower-cased bytes and its end under a PPM model of all
    training texts. base_score: an add-one unigram model of words and ends. Both learn from all
    documents outside the held-out fold; null ids are in no fold's held-out part.

    Tasks look up the scores of at most max_branches frequent branches and the counts of at most max_words
    frequent words of WORD_BYTES on average. A document's other branches and words leave as different ones with their numbers, and meet
    the trie's tables and the counts in joins; both bounds change no result. Null texts are empty: one
    token, the end. Repeated ids and rows are all scored. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = docs.where(~F.col("held_out"))
    words = checkpoint(count_words(training))
    kinds, tokens = words.agg(F.count("*"), F.sum("n")).first()
    ends = training.count()
    n_train, n_kinds = (tokens or 0) + ends, kinds + (ends > 0)
    least = max(threshold(words, "n", F.lit(1), max_words), threshold(words, "n", F.octet_length("word"), WORD_BYTES * max_words))
    got = words.where(F.col("n") >= least).toArrow()
    frequent = dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True))
    trie = train_trie(training, order, max_branches)
    model = spark.sparkContext.broadcast((trie.frequent, {w: float(np.log10(n + 1)) for w, n in frequent.items()}))
    end_log = float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = model.value
        lookup, get = lookup_of(table), known.get
        for batch in batches:
            texts = [lowered(t.as_py()) for t in batch.column("text")]
            scores: list[float] = []
            open_grams, open_times = [], []
            for chunk in in_chunks(iter(texts)):
                size = np.array([len(t) + 1 for t in chunk])
                keys = grams(chunk, order)
                values, none = lookup.get(keys)
                scores += np.add.reduceat(values, np.cumsum(size) - size).tolist()
                none.sort()
                for own in np.split(keys[none], np.searchsorted(none, np.cumsum(size)[:-1])):
                    k, n = np.unique(own, return_counts=True)
                    open_grams.append(k.astype(np.int64))
                    open_times.append(n)
            total, seen, logs, rare, times = [], [], [], [], []
            for t in texts:
                w = t.split()
                total.append(len(w) + 1)
                found = [x for x in map(get, w) if x is not None]
                seen.append(len(found) + (ends > 0))
                logs.append(float(sum(found)) + end_log)
                other = Counter(x for x in w if x not in known) if len(found) < len(w) else {}
                rare.append(list(other))
                times.append(list(other.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(total, pa.int64()), pa.array(seen, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), pa.array(open_grams, pa.list_(pa.int64())), pa.array(open_times, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "n_tokens", "seen", "logs", "found", "rare", "times", "grams", "gram_times"],
            )

    scored = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, seen long, logs double, found double, rare array<binary>, times array<int>, grams array<long>, gram_times array<int>")
    scored = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    other = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    tail = other.join(words.where(F.col("n") < least), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    bytes_ = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    values = trie.scores(bytes_.select("gram").distinct())
    fallen = bytes_.join(values, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("fallen"))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(max(1, n_train + n_kinds + 1 if ends else 1))))
    score = F.col("found") + F.coalesce("fallen", F.lit(0.0))
    return scored.join(tail, "row", "left").join(fallen, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
