"""Mixing sources to target weights, in fixed-length blocks of words. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, checkpoint, n_words, text_key, text_of

BLOCK = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SHARDS = 16
#: A word with the white space after it.
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
ROUNDS = 8
#: Slots are made in chunks of so many, and tasks get a few chunks, so that a hot source's slots are made
#: in many tasks. The number of tasks is set, as Spark would put the few and small chunk rows into one.
CHUNK, CHUNKS_A_TASK, MOST_TASKS = 4096, 4, 20_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target for each source of (source, size) rows: sources by code point, null
    last, weigh weights in turn and share `share` times all sizes; a target stops at `repeats` times its
    source's size and the excess is reshared by weight until none is above.

    That end state is target = min(cap, level * weight), where the sources that reach their cap are
    those of the smallest cap by weight: running sums in that order give the level. The windows run
    over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(repeats))
    everyone = W.partitionBy()
    per = per.withColumn("all_size", F.sum("source_size").over(everyone) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everyone)).withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("all_size") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    per = per.withColumn("level", level)
    # the first source in that order that stays under its cap sets the level of all after it
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everyone)["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1, exact for every n: each swap-or-not round pairs x with
    (key - x) mod n and one hash bit of the pair says whether the two swap."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(seed, r + 1000, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), swap)


def with_starts(sized: DataFrame, rows: int) -> DataFrame:
    """Adds start: the place of a document's first word in the word stream of its source. The stream
    runs by hash bucket, then doc_id and text: bucket sums give offsets, windows stay inside a bucket."""
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(buckets_for(rows))))
    s = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"))
    sized = sized.withColumn("s", s)
    before = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sized.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("s", "bucket").orderBy("doc_id", "k1", "k2", "k3", "size").rowsBetween(W.unboundedPreceding, -1)
    return sized.join(offsets, ["s", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def size_of(sized: DataFrame) -> tuple[int, int]:
    """Number of rows, and of all words."""
    rows, total = sized.agg(F.count("*"), F.sum("size")).first()
    return rows, total or 0


def in_chunks(rows: DataFrame, n: str, tasks: int, *keys: str) -> DataFrame:
    """A row for each number from 0 to n - 1 (slot) of every row, made in chunks by many tasks."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(n) / CHUNK)))).repartition(tasks, *keys, "chunk")
    last = F.least(F.col(n), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.where(last >= F.col("chunk") * CHUNK).withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")


def drawn_counts(targets: DataFrame, total: int, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """source, n (blocks), out_shard, count, first: a multinomial draw of how many slots each output shard gets
    of every source, given the source's slots: round(target / source_size * n). Every slot of a source is
    a trial that falls into one of the shards; first is the source's first slot in the shard."""
    tasks = min(MOST_TASKS, 1 + int(SHARE * total / block / CHUNK / CHUNKS_A_TASK))
    n = F.ceil(F.col("source_size") / block)
    plan = targets.where(F.col("source_size") > 0).select("source", n.alias("n"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("slots"))
    trials = in_chunks(plan, "slots", tasks, "source").select("source", "n", F.pmod(F.xxhash64("source", "slot", F.lit(3)), F.lit(shards)).cast("int").alias("out_shard"))
    counts = trials.groupBy("source", "n", "out_shard").agg(F.count("*").alias("count"))
    before = W.partitionBy("source").orderBy("out_shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    return counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))


def drawn_slots(targets: DataFrame, total: int, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """One row per slot of the mix: source, epoch, block, out_shard. A shard's slots of a source follow each
    other from the source's first slot there, as drawn_counts says; slot i of a source with n blocks holds
    block permutation(i mod n) of epoch i div n."""
    tasks = min(MOST_TASKS, 1 + int(SHARE * total / block / CHUNK / CHUNKS_A_TASK))
    slots = in_chunks(drawn_counts(targets, total, block, shards), "count", tasks, "source", "out_shard").withColumn("slot", F.col("first") + F.col("slot"))
    epoch = F.floor(F.col("slot") / F.col("n"))
    return slots.select("source", epoch.alias("epoch"), permuted(F.col("slot") % F.col("n"), F.col("n"), F.xxhash64("source", epoch)).alias("block"), "out_shard")


def mix_taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, source and
    out_shards (the output shards that get words of the document, joined by commas).

    The words of a source form one stream, cut into blocks of `block` words (the last may be shorter).
    A source takes round(target / source_size * blocks) slots; as targets end at twice the source, no
    block is taken more than twice. Blocks meet slots by a join on (source, block number).

    Null or empty texts have size 0 and take nothing; null sources form one source; repeated rows and
    ids stay apart by their place in the stream. An empty table gives an empty result. Reruns agree: all
    draws are hashes."""
    sized = checkpoint(docs.select("doc_id", "source", n_words(text_of()).alias("size"), *text_key()))
    targets = source_targets(sized)
    rows, total = size_of(sized)
    starts = with_starts(sized.where(F.col("size") > 0), rows)
    s = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")).alias("s")
    # hint: Spark sees the few chunk rows, not the slots made of them, and would broadcast all blocks
    times = drawn_slots(targets, total, block).groupBy(s, "block").agg(F.count("*").alias("times"), F.collect_list("out_shard").alias("shards")).hint("merge")  # a slot an epoch
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = starts.select("s", "start", "doc_id", "size", F.explode(F.sequence(first, last)).alias("block"))
    held = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block, F.col("start"))
    taken = parts.withColumn("held", held).join(times, ["s", "block"], "left").groupBy("s", "start", "doc_id", "size").agg(F.sum(F.col("held") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("shards")))).alias("shards"))
    out_shards = F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("out_shards")
    nothing = sized.where(F.col("size") == 0).select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"), F.lit("").alias("out_shards"))
    out = taken.select("doc_id", F.col("s.name").alias("source"), "size", "taken", out_shards).unionByName(nothing)
    # one row per source, as in the targets' windows: a few sources, so Spark's size check broadcasts it
    known = targets.withColumnRenamed("source", "name")
    return out.join(known, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken", "source", "out_shards")


def mixed_documents(docs: DataFrame, block: int = BLOCK, by_shard: bool = False) -> DataFrame:
    """The mix as rows with the columns of docs (doc_id, text, lang, source, n_chars): one row for each
    document and epoch in which the mix takes words of it, or with by_shard for each document, epoch and
    output shard, which out_shard gives.

    A document taken whole keeps its text as it is. Else its taken words follow each other in their order,
    each with the white space after it, so that lines and tables stay as they are inside a block. Null, empty
    and wordless texts give no row, an empty table no rows."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sized = checkpoint(docs.select("*", n_words(text_of()).alias("size"), *text_key()))
    targets = source_targets(sized.select("source", "size"))
    lean = sized.where(F.col("size") > 0).select("doc_id", "source", "size", "k1", "k2", "k3")
    rows, total = size_of(sized)
    starts = with_starts(lean, rows)
    s = F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")).alias("s")
    shard = ["out_shard"] if by_shard else []
    slots = drawn_slots(targets, total, block).select(s, "block", "epoch", *shard).hint("merge")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    same = ["s", "doc_id", "k1", "k2", "k3"]
    copy = F.row_number().over(W.partitionBy(*same).orderBy("start"))
    parts = starts.withColumn("copy", copy).select(*same, "copy", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    cuts = parts.join(slots, ["s", "block"]).groupBy(*same, "copy", "epoch", *shard).agg(F.sort_array(F.collect_list(F.struct(begin.alias("begin"), (end - begin).alias("n")))).alias("cuts"), F.sum(end - begin).alias("taken"))
    numbered = sized.withColumn("s", F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"))).withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy("lang", "n_chars")))
    keys = [numbered[c].eqNullSafe(cuts[c]) for c in (*same, "copy")]
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(F.col("words"), (c["begin"] + 1).cast("int"), c["n"].cast("int")))), ""))
    out = numbered.join(cuts.hint("merge"), keys).select(numbered["doc_id"], "text", "lang", "source", "size", "taken", "cuts", *shard).withColumn("words", words).withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *shard)
