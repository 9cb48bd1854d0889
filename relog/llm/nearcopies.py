"""Near copies of whole texts: Jaccard similarity over word shingles, candidates by bands of min-hashes, every link verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS min-hashes each: a pair of similarity s meets with probability 1 - (1 - s^ROWS)^BANDS,
#: which is 0.998 at 0.8 and over 0.99999 at 0.9.
BANDS, ROWS = 16, 5
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64)
PAIR = "a binary, b binary"
CHUNK = 8192
#: Shingles of the sets that one task holds at once, on average, to compare others with them.
BLOCK = 1 << 20


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes. A text of fewer words has one shingle, a
    wordless one none; case and white space count as in fingerprints."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def bands(s: np.ndarray) -> list[int]:
    """A 64-bit value for each band of a set's min-hashes."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), CHUNK):
        least = np.minimum(least, ((s[at : at + CHUNK] ^ _SALT[:, None]) * _MULTIPLY[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(least[b * ROWS : b * ROWS + ROWS].tobytes(), b) for b in range(BANDS)]


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, fingerprint: Callable[[list[bytes], int], int] | None = None) -> DataFrame:
    """doc_id, row, key (128 bits of hash of the shingle set), size (its shingles), bands and, with a function of words and shingle
    size that makes it, fp (64 bits as a signed long) of docs (doc_id, row, text)."""
    more = ["fp"] if fingerprint else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), signed(bands(s))) for s in (shingle_set(t.as_py(), shingle) for t in batch.column("text"))]
            columns = [pa.array([x[0] for x in sets], pa.binary()), pa.array([x[1] for x in sets], pa.int64()), pa.array([x[2] for x in sets], pa.list_(pa.int64()))]
            if fingerprint:
                columns.append(pa.array(signed([fingerprint((t.as_py() or "").encode().lower().split(), shingle) for t in batch.column("text")]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], names=["doc_id", "row", "key", "size", "bands", *more])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, row {chosen.schema['row'].dataType.simpleString()}, " + ", ".join(["key binary", "size long", "bands array<long>", *(f"{c} long" for c in more)]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (key, part) have the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("part").alias("left")), "a").join(sets.select(F.col("key").alias("b"), F.col("part").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, PAIR)


def alike(ask: np.ndarray, every: np.ndarray, owner: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets have the Jaccard similarity to the set ask. The sets' shingles are given together, sorted
    (every), each with its set (owner): those in common are counted, no pair is listed."""
    low, high = np.searchsorted(every, ask, "left"), np.searchsorted(every, ask, "right")
    n = high - low
    places = np.arange(n.sum()) + np.repeat(low - (n.cumsum() - n), n)
    common = np.bincount(owner[places], minlength=len(sizes))
    return np.flatnonzero((common > 0) & (common >= similarity * (sizes + len(ask) - common)))


def joining(apart: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links between sets that share a band and are in different components, enough to join these.
    apart has band, key, size and component, sets has key and part.

    Of two such sets one at least is a stray: not in the most frequent component of their band. Every set of
    a band with strays is put into one block; sets of the same smallest partner share blocks, as many as
    their shingles fill, so a large group is dealt to many tasks. A stray goes to the blocks that hold sets
    of its bands and is compared with all sets there. A task holds one block; strays pass by."""
    per = apart.groupBy("band", "component").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    most = per.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("several"), F.min("key").alias("lead")).where("several > 1")
    mixed = checkpoint(apart.join(most.select("band", "lead", F.col("most.component").alias("main")), "band"))
    led = mixed.groupBy("key", "size", "component").agg(F.min("lead").alias("lead"))
    blocks = led.groupBy("lead").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    data = checkpoint(led.join(blocks, "lead").withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks"))).select("lead", "at", "key", "component"))
    places = mixed.select("band", "key").join(data.select("key", "lead", "at"), "key").select("band", "lead", "at").distinct()
    strays = mixed.where("component != main").select("band", "key", "component").join(places, "band").select("lead", "at", "key", "component").distinct()
    rows = data.withColumn("role", F.lit(0)).unionByName(strays.withColumn("role", F.lit(1))).join(sets, "key").select("lead", "at", "role", "key", "component", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, root, index = None, {}, None
        keys, groups, parts = [], [], []

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for batch in batches:
            out = []
            for lead, at, role, key, component, part in zip(*(batch.column(c) for c in range(6)), strict=True):
                if block != (here := (lead.as_py(), at.as_py())):
                    block, root, index, keys, groups, parts = here, {}, None, [], [], []
                key, component, part = key.as_py(), component.as_py(), np.frombuffer(part.as_py(), np.uint64)
                if role.as_py() == 0:
                    keys.append(key)
                    groups.append(component)
                    parts.append(part)
                    continue
                if index is None:  # all sets of the block are here
                    sizes = np.array([len(x) for x in parts])
                    every, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
                    by, parts = np.argsort(every, kind="stable"), []
                    index = (every[by], owner[by], sizes)
                for j in alike(part, *index, similarity).tolist():
                    x, y = find(component), find(groups[j])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((key, keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("lead", "at").sortWithinPartitions("lead", "at", "role", "key").mapInArrow(run, PAIR)


def classes(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, pairs: DataFrame | None = None) -> DataFrame:
    """key, component (the smallest key that links reach) for the sets of prints (signatures of docs) that
    are linked to others; docs has row and text. pairs (a, b: keys) are more candidates, found in another way.

    Sets that share a band meet. First each is compared with the smallest of its band: that settles
    groups of close copies by one row for each member. Then those that share a band and are in different
    groups yet are compared in blocks (joining), so no pair that meets is left out and no pairs are listed.
    Every link is verified on the whole sets."""
    met = prints.select("key", "size", F.explode("bands").alias("band")).distinct()
    least = met.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    shared = checkpoint(met.join(least, "band"))
    candidates = shared.select(F.col("least").alias("a"), F.col("key").alias("b")).where("a != b")
    asked = shared.select("key")
    if pairs is not None:
        candidates = candidates.unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b"))
        asked = asked.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    wanted = prints.join(asked.distinct(), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(parts, pa.binary())], names=["key", "part"])

    texts = docs.select("row", F.col("text").cast("string").alias("text")).join(wanted, "row").dropDuplicates(["key"])
    sets = checkpoint(texts.select("key", "text").mapInArrow(cut, "key binary, part binary"))
    star = checkpoint(verified(candidates.distinct(), sets, similarity))
    found = components(star)
    grouped = shared.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # pairs with the smallest key of a band have been compared
    apart = checkpoint(grouped.where("key != least").select("band", "key", "size", "component"))
    rest = checkpoint(joining(apart, sets, similarity))
    return components(star.unionByName(rest)).withColumnRenamed("node", "key")
