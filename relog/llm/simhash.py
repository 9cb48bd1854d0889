"""SimHash near-duplicates: fingerprints, and links by BK-trees over shards that share bit blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import nearcopies
from .common import checkpoint
from .components import components

SHINGLE = 3
RADIUS = 2
#: A shard of more fingerprints is cut again by finer blocks, which bounds every tree.
SHARD = 4096
CHUNK = 65_536


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of a word sequence: bit set where over half of the shingles' XXH64 (seed 42) have it."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n, total, ones = max(1, len(words) - shingle + 1), 0, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + CHUNK))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of docs (doc_id, text), with more long columns to keep; bytes.lower and bytes.split
    treat just A-Z and the white space of the contract. No shuffle; one text in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t.as_py() or "").encode().lower().split(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", *keep, "fp"])

    chosen = docs.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", *keep)), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *keep, "fp")))


class BKTree:
    """BK-tree over distinct 64-bit fingerprints; a node's children are keyed by their integer Hamming
    distance to it. Built and searched a level at a time, for many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.child = np.full((n, 65), -1, np.int32)  # node, distance -> node
        at, rest = np.zeros(max(0, n - 1), np.int64), np.arange(1, n)
        while len(rest):
            d = np.bitwise_count(values[at] ^ values[rest]).astype(np.int64)
            slot = at * 65 + d
            _, first = np.unique(slot, return_index=True)  # the first value at a free edge becomes its node
            self.child[at[first], d[first]] = rest[first]
            stay = np.ones(len(rest), bool)
            stay[first] = False
            at, rest = self.child[at[stay], d[stay]].astype(np.int64), rest[stay]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, node) within the radius: only edges whose key is within the radius of
        the query's distance to their node are followed."""
        who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(who):
            d = np.bitwise_count(self.values[node] ^ queries[who]).astype(np.int64)
            hit = d <= radius
            yield who[hit], node[hit]
            key = d[:, None] + np.arange(-radius, radius + 1)
            nxt = np.where((key >= 0) & (key <= 64), self.child[node[:, None], np.clip(key, 0, 64)], -1)
            who, node = np.repeat(who, 2 * radius + 1)[nxt.ravel() >= 0], nxt.ravel()[nxt.ravel() >= 0].astype(np.int64)


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a shard the smallest one that links reach inside the shard."""
    values = np.unique(values)
    root = np.arange(len(values))
    tree = BKTree(values)
    for at in range(0, len(values), 256):
        for who, node in tree.within(values[at : at + 256], radius):
            for a, b in zip((who + at).tolist(), node.tolist(), strict=True):
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
    while (root[root] != root).any():
        root = root[root]
    return np.stack([values, values[root]])


def blocks(fp, widths: list[int], keep: int, low: int = 0) -> list:
    """One struct (combination, bits) for each choice of `keep` blocks: the fingerprint with all other
    bits cleared. Two fingerprints that differ in at most len(widths) - keep bits share one of them."""
    masks, at = [], low
    for w in widths:
        masks.append(((1 << w) - 1) << at)
        at += w
    out = []
    for i, chosen in enumerate(combinations(masks, keep)):
        mask = sum(chosen)
        out.append(F.struct(F.lit(i).alias("combo"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: for the distinct fingerprints (fp) enough links of at most `radius` bits to hold all
    components together.

    A shard is all fingerprints that agree on two of radius + 2 blocks; each pair within the radius
    meets in one. A shard of over SHARD fingerprints is cut by finer blocks of its free bits until at
    most 2^16 different values can fall into one, so no tree grows with the data. Trees reach their
    queries by the shuffle on the shard key: together they are as large as the table, so they are not
    broadcast. A shard returns a forest (a row for each member at most), never its pairs."""
    m = radius + 2
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    fine = radius + 6
    shards = prints.select("fp", F.explode(F.array(*blocks(F.col("fp"), widths, 2))).alias("shard"))
    counted = shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = shards.join(counted, "shard")
    narrow = [64 // fine + (i < 64 % fine) for i in range(fine)]
    cut = shared.where(F.col("n") > SHARD).select("fp", F.explode(F.array(*blocks(F.col("fp"), narrow, fine - radius))).alias("x")).select("fp", (F.col("x.combo") + 1000).alias("combo"), "x.bits").distinct()
    keyed = shared.where(F.col("n") <= SHARD).select("fp", "shard.combo", "shard.bits").unionByName(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            cuts = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rows.shape[1]], strict=True):
                if hi - lo == 2:
                    x, y = rows[2, lo:hi]
                    if (int(x) ^ int(y)) & (2**64 - 1) and ((int(x) ^ int(y)) & (2**64 - 1)).bit_count() <= radius:
                        a.append([max(x, y)])
                        b.append([min(x, y)])
                elif hi - lo > 2:
                    v, r = linked(rows[2, lo:hi].view(np.uint64), radius).view(np.int64)
                    a.append(v[v != r])
                    b.append(r[v != r])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:  # sorted by shard; the last shard of a batch may go on in the next
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
            same = (held[0] == held[0, -1]) & (held[1] == held[1, -1]) if held.shape[1] else np.zeros(0, bool)
            if not same.all():
                yield out(held[:, ~same])
                held = held[:, same]
        if held.shape[1]:
            yield out(held)

    ordered = keyed.select(F.col("combo").cast("long").alias("combo"), "bits", "fp").repartition("combo", "bits").sortWithinPartitions("combo", "bits")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) of docs
    (doc_id, text).

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Null ids are
    passed over when a component's smallest id is taken (a component of null ids alone has null);
    repeated ids and rows are kept. An empty table gives an empty result."""
    prints = checkpoint(fingerprints(docs, shingle))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes(prints, radius), "fp").select("doc_id", hexed, "component_id")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component (its smallest fingerprint), component_id for the different fingerprints of prints
    (doc_id, fp)."""
    each = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(each.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = each.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return checkpoint(joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id"))


def met_by_fingerprint(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: keys of prints (key, fp, size) to compare, as their fingerprints are equal or linked: each with the smallest of its
    fingerprint, and those smallest ones along the links. Wordless texts have one key and need none."""
    of_fp = prints.where("size > 0").select("fp", "key").distinct()
    least = checkpoint(of_fp.groupBy("fp").agg(F.min("key").alias("least")))
    same = of_fp.join(least, "fp").select(F.col("key").alias("a"), F.col("least").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}"))
    near = links(least.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return same.unionByName(near).where("a != b").distinct()


def one_of_each(docs: DataFrame, similarity: float = nearcopies.SIMILARITY, shingle: int = nearcopies.SHINGLE) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with one document of each group of near copies: that of the
    smallest doc_id (null last), and of rows with that id, one by the hash of the text.

    Texts are near copies from a Jaccard similarity of their word shingles on; groups follow verified links.
    The closest ones meet by their fingerprints, in BK-trees (met_by_fingerprint). At 0.8 the fingerprints differ in about 10 of
    64 bits, too many to search by blocks, so those that differ more meet by min-hashes. Rows and shingle sets are told apart by 128 bits of hash each."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("row", F.unhex(F.md5(F.concat_ws(":", said("doc_id"), said("text")))))
    prints = checkpoint(nearcopies.signatures(docs, shingle, fingerprint))
    found = nearcopies.classes(docs, prints, similarity, shingle, checkpoint(met_by_fingerprint(prints)))
    grouped = prints.select("doc_id", "row", "key").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("x.row")
    same = W.partitionBy("row").orderBy("lang", "source", "n_chars")
    return docs.join(least, "row").withColumn("n", F.row_number().over(same)).where(F.col("n") == 1).drop("row", "n")
