"""Near-duplicate passages across documents, by compact windows over min-hashes of word shingles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, scattered, shingle_hashes, spread_join, text_of
from .components import components

SHINGLE = 5
#: A passage has this many words, so LENGTH shingles; longer ones hold passages of this length.
WORDS = 50
LENGTH = WORDS - SHINGLE + 1
SIMILARITY = 0.8
#: Two passages of LENGTH shingles have the similarity from this many shingles in common on (41 of 46).
COMMON = math.ceil(2 * LENGTH * SIMILARITY / (1 + SIMILARITY))
#: What an edited word costs: SHINGLE shingles where it stands or stood, one less where a word is missing.
#: A passage can pay for one (LENGTH - COMMON = 5), so near passages have COMMON equal shingles in a row,
#: or in two runs with one such gap between them.
GAPS = (SHINGLE - 1, SHINGLE)
#: The longer of two such runs; near passages share one of this length, shingle by shingle.
RUN = (COMMON + 1) // 2
#: Min-hash functions that must agree on a run.
HASHES = 2
#: Sites of one signature that one task compares, and how many pairs of different components these may make;
#: beyond either they meet by their rarest shingles, in blocks. Both ways find the same classes.
TOGETHER, PAIRS = 20_000, 20_000_000
#: Sites of a rare shingle in one block, on average.
BLOCK = 2048
#: Rows that a task gathers before it links those of equal keys.
CHUNK = 1 << 21
_RNG = np.random.default_rng(5)
_SALT = _RNG.integers(1, 2**63, HASHES).astype(np.uint64)
_SIGN = _RNG.integers(1, 2**63, HASHES + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WHOLE = _RNG.integers(1, 2**63, COMMON).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_REACH = LENGTH - RUN  # a passage around a run begins and ends at most so far from it
PAIR = "a long, b long"
SITE = ["sig", "component", "node", "part", "low", "high"]
SITES = pa.schema(list(zip(SITE, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)))
SITE_ROW = "sig long, component long, node long, part binary, low int, high int"


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text; none where it is too short for a passage."""
    s = shingle_hashes(text, SHINGLE)
    return s if len(s) >= LENGTH else s[:0]


def first_minima(h: np.ndarray, length: int = RUN) -> np.ndarray:
    """For every subsequence of `length` values the place of its first minimum, its centre.

    A centre is a node of h's Cartesian tree whose range holds `length` values, and the subsequences that
    have it are its compact window: they begin at consecutive places. So the wide nodes are all found
    without the narrow ones, by minima over 1, 2, 4, ... values."""
    if len(h) < length:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(h)), 1
    while size < length:
        step = min(size, length - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(h[b] < h[a], b, a), size + step
    return at


def signatures(s: np.ndarray) -> np.ndarray:
    """A signature for every run of RUN shingles: the min-hashes of all functions and how their centres lie
    to each other. Each function cuts the places where runs begin into intervals, one for each compact
    window; a signature holds on the intervals' intersections, so that all functions agree on a run."""
    centres = [first_minima(scattered(s ^ salt)) for salt in _SALT]
    out = (centres[-1] - centres[0]).astype(np.uint64) * _SIGN[-1]
    for c, sign in zip(centres, _SIGN, strict=False):
        out += s[c] * sign
    return scattered(out)


def runs(s: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of the runs of COMMON shingles that begin at the given places."""
    out = np.zeros(len(begins), np.uint64)
    for j in range(COMMON):
        out += s[begins + j] * _WHOLE[j]
    return out


def repeating(s: np.ndarray, length: int) -> np.ndarray:
    """For each run of `length` values whether it holds a value twice."""
    before = np.full(len(s), -1)  # where a value stood last
    by = np.argsort(s, kind="stable")
    same = s[by[1:]] == s[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    if not same.any() or len(s) < length:
        return np.zeros(max(0, len(s) - length + 1), bool)
    return np.lib.stride_tricks.sliding_window_view(before, length).max(axis=1) >= np.arange(len(s) - length + 1)


def gapped_runs(s: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hashes of COMMON different shingles in two runs with one of GAPS between them, the longer run around
    one of RUN shingles that begins in low..high: what is left of a passage where one word is edited."""
    out = [np.zeros(0, np.uint64)]
    several = len(np.unique(s)) < len(s)
    for gap in GAPS:
        for cut in range(max(1, low - COMMON), min(len(s) - gap, high + COMMON) + 1):  # the first shingle of the gap
            first = np.arange(max(0, cut - COMMON + 1), cut)
            on_left = (cut - first >= RUN) & (first <= high) & (cut >= low + RUN)
            right = COMMON - (cut - first)
            on_right = (right >= RUN) & (cut + gap <= high) & (cut + gap + right >= low + RUN)
            first = first[(on_left | on_right) & (cut + gap + right <= len(s))]
            if len(first):
                at = first[:, None] + np.arange(COMMON)
                held = s[np.where(at < cut, at, at + gap)]
                if several:  # as sets such passages have less in common
                    held = held[(np.diff(np.sort(held, axis=1), axis=1) != 0).all(axis=1)]
                out.append((held * _WHOLE).sum(axis=1))
    return np.unique(np.concatenate(out))


def window_sets(x: np.ndarray, length: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each subsequence of `length` values which of the kinds it holds, and how many different values."""
    held = np.zeros((len(x) + 1, len(kinds)), np.int32)
    held[1:] = (x[:, None] == kinds[None, :]).cumsum(axis=0)
    n = len(x) - length + 1
    whole = len(np.unique(x)) == len(x)
    return (held[length:] > held[:-length]).astype(np.float32), np.full(n, length) if whole else np.array([len(np.unique(x[i : i + length])) for i in range(n)])


def near(a: np.ndarray, b: np.ndarray, length: int = LENGTH, similarity: float = SIMILARITY) -> bool:
    """Whether some `length` shingles of a and some of b have the Jaccard similarity, as sets."""
    if min(len(a), len(b)) < length:
        return False
    kinds = np.intersect1d(a, b)
    (in_a, n_a), (in_b, n_b) = window_sets(a, length, kinds), window_sets(b, length, kinds)
    common = in_a @ in_b.T
    return bool((common >= similarity * (np.add.outer(n_a, n_b) - common)).any())


def first_of_each(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts rows by key and node without repetitions: key, node, the key's first node, whether it has more."""
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[: len(key)]
    key, node = key[fresh], node[fresh]
    start = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    size = np.bincount(first, minlength=len(key))[first] if len(key) else first
    return key, node, node[first], size > 1


def grouped(parts: Iterator[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, nodes) in chunks of (keys of a node, node)."""
    keys, nodes, held = [], [], 0
    for key, node in parts:
        keys.append(key)
        nodes.append(np.full(len(key), node, np.int64))
        held += len(key)
        if held >= CHUNK:
            yield np.concatenate(keys), np.concatenate(nodes)
            keys, nodes, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(nodes)


def by_key(rows: DataFrame) -> Callable[[Callable], DataFrame]:
    """rows (place, node, other) meet by place, in its order. Rows with other are results that need no
    meeting; they travel under any place. What a function makes of (place, node) of whole places comes
    after them, as (a, b) arrays."""

    def meet(make: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

            held = [np.zeros(0, np.int64)] * 2
            for batch in batches:
                done = batch.filter(batch.column("other").is_valid())
                yield out(done.column("node").to_numpy(), done.column("other").to_numpy())
                open_ = batch.filter(batch.column("other").is_null())
                held = [np.concatenate([x, open_.column(c).to_numpy()]) for x, c in zip(held, ("place", "node"), strict=True)]
                if len(held[0]) > CHUNK // 8:
                    last = held[0] == held[0][-1]
                    yield out(*make(*(x[~last] for x in held)))
                    held = [x[last] for x in held]
            yield out(*make(*held))

        return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, PAIR)

    return meet


def once(texts: DataFrame) -> DataFrame:
    """texts (node, text) without copies of a text that the same task has had lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for node in batch.column("node").to_pylist():
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    return texts.mapInArrow(run, "node long, text string")


def shared_signatures(texts: DataFrame) -> DataFrame:
    """a (signature), b (node) for the signatures that different texts (node, text) have.

    A task knows those that several of its own texts have and passes them on as they are; of each it
    sends one row to meet other tasks' rows, so a signature of a third of all texts costs a row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, int]]:
            for batch in batches:
                for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                    yield np.unique(signatures(shingles(text.as_py()))).view(np.int64), node

        for keys, nodes in grouped(parts()):
            key, node, first, several = first_of_each(keys, nodes)
            sent = node == first
            place, who = np.concatenate([key[sent], node[several]]), np.concatenate([node[sent], key[several]])
            other = pa.array(np.concatenate([np.zeros(sent.sum(), np.int64), node[several]]), mask=np.concatenate([np.ones(sent.sum(), bool), np.zeros(several.sum(), bool)]))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(who), other], names=["place", "node", "other"])

    def make(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, node, _, several = first_of_each(key, node)
        return key[several], node[several]

    return by_key(texts.mapInArrow(run, "place long, node long, other long"))(make)


def linked(rows: DataFrame, keys: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """a, b: links between nodes that have a key in common, each to the key's smallest one. A task links
    its own rows first and sends one row a key and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, int]]:
            for batch in batches:
                for node, *values in zip(batch.column("node").to_pylist(), *(batch.column(c) for c in columns), strict=True):
                    yield keys(*(v.as_py() for v in values)).view(np.int64), node

        for k, nodes in grouped(parts()):
            key, node, first, _ = first_of_each(k, nodes)
            sent = node == first
            a, b = pairs_of(first[~sent], node[~sent])
            other = pa.array(np.concatenate([np.zeros(sent.sum(), np.int64), b]), mask=np.concatenate([np.ones(sent.sum(), bool), np.zeros(len(b), bool)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[sent], b])), pa.array(np.concatenate([node[sent], a])), other], names=["place", "node", "other"])

    def make(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, node, first, _ = first_of_each(key, node)
        return pairs_of(first[node != first], node[node != first])

    return by_key(rows.mapInArrow(run, "place long, node long, other long"))(make)


def pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a and b."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[fresh], b[fresh]


def shared_runs(text: str, sigs: list[int]) -> np.ndarray:
    """Hashes of a text's runs of COMMON shingles of which every run of RUN has a signature of sigs. Where a
    run holds a shingle twice, texts may have less in common as sets: there it takes a whole equal passage."""
    s = shingles(text)
    met = np.concatenate([[0], np.isin(signatures(s), np.array(sigs, np.int64).view(np.uint64)).cumsum()])
    span = COMMON - RUN + 1
    begins = np.flatnonzero(met[span:] - met[:-span] == span)
    twice = repeating(s, COMMON)[begins]
    whole = begins[twice & (begins + LENGTH <= len(s))]
    equal = scattered(runs(s, whole) * _SIGN[0] + runs(s, whole + LENGTH - COMMON) * _SIGN[1])
    return np.unique(np.concatenate([runs(s, begins[~twice]), equal]))


def sites(text: str, sigs: list[int]) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Where a text has the signatures: signature, shingles around, and the first and last begin of its
    runs within these. Places of one signature with the same shingles around count once."""
    s = shingles(text)
    sig, wanted = signatures(s), np.array(sigs, np.int64).view(np.uint64)
    begins = np.flatnonzero(np.isin(sig, wanted))
    ends = np.flatnonzero((np.diff(begins) != 1) | (sig[begins[1:]] != sig[begins[:-1]])) + 1
    seen = set()
    stretches = np.split(begins, ends) if len(begins) else []
    for at in (x[k : k + RUN] for x in stretches for k in range(0, len(x), RUN)):  # long ones repeat themselves
        low = max(0, int(at[0]) - _REACH)
        part = s[low : int(at[-1]) + RUN + _REACH]
        key = (int(sig[at[0]]), part.tobytes())
        if key not in seen:
            seen.add(key)
            yield int(sig[at[0]].view(np.int64)), part, int(at[0]) - low, int(at[-1]) - low


def near_sites(components_: np.ndarray, nodes: np.ndarray, parts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between near sites of different components, enough to join these. For each site all others are
    found that have shingles enough in common with it, by the places of every shingle; these are compared,
    unless links found so far join their components already."""
    size = np.array([len(p) for p in parts])
    sets = [np.unique(p) for p in parts]
    # what a passage of the site must have in common with another: most of its different shingles
    whole = size == np.array([len(u) for u in sets])
    least = np.array([LENGTH if w or len(p) < LENGTH else min(len(np.unique(p[i : i + LENGTH])) for i in range(len(p) - LENGTH + 1)) for w, p in zip(whole, parts, strict=True)]) * SIMILARITY
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    root = {c: c for c in np.unique(components_).tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    kinds, number = np.unique(components_, return_counts=True)
    largest = kinds[number.argmax()]  # its sites are only compared with those of others
    for i in np.flatnonzero(components_ != largest).tolist():
        low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        held = np.zeros((len(sets), len(sets[i])), np.float32)  # which of the site's shingles the others have
        held[np.concatenate([owner[a:b] for a, b in zip(low, high, strict=True)]), np.repeat(np.arange(len(low)), high - low)] = 1
        passages, different = window_sets(parts[i], min(LENGTH, len(parts[i])), sets[i])
        common = held @ passages.T  # with each passage of the site
        # a similarity of 0.8 takes that share of the different shingles of either passage
        need = np.where((whole & whole[i])[:, None], COMMON, np.maximum(least[:, None], SIMILARITY * different))
        may = (common >= need).any(axis=1)
        for j in np.flatnonzero(may & (components_ != components_[i])).tolist():
            x, y = find(int(components_[i])), find(int(components_[j]))
            if x != y and near(parts[i], parts[j]):
                root[max(x, y)] = min(x, y)
                yield int(nodes[i]), int(nodes[j])


def prefix(part: np.ndarray, held: dict[int, int]) -> list[int]:
    """Shingles of a site by which it meets every near site of its signature: of each passage those that it
    could not all miss, rarest first. held gives the number of sites of the shingles that other components
    have too; all other shingles come first and meet nothing.

    Passages of similarity SIMILARITY share at least that part of the different shingles of either. In
    any order that both keep to, each has a shared one among its first d - ceil(SIMILARITY * d) + 1 of d."""
    kinds = np.unique(part)
    order = np.array([held.get(x, 0) for x in kinds.view(np.int64).tolist()], np.int64)
    by = np.lexsort((kinds, order))
    place = np.empty(len(kinds), np.int64)
    place[by] = np.arange(len(kinds))
    at = place[np.searchsorted(kinds, part)]
    chosen: set[int] = set()
    for k in range(len(part) - LENGTH + 1):
        passage = np.unique(at[k : k + LENGTH])
        d = len(passage)
        chosen.update(passage[: d - math.ceil(SIMILARITY * d - 1e-9) + 1].tolist())
    chosen_kinds = by[np.array(sorted(chosen), np.int64)]
    return kinds[chosen_kinds[order[chosen_kinds] > 0]].view(np.int64).tolist()


def cut_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sites (SITE) of texts (node, component, text, sigs)."""
    for batch in batches:
        rows = []
        for node, component, text, sigs in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "text", "sigs")), strict=True):
            rows += [(sig, component, node, part.tobytes(), low, high) for sig, part, low, high in sites(text, sigs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SITES)], schema=SITES)


def compared_sites(rows: DataFrame) -> DataFrame:
    """a, b: links between near sites (SITE) of one signature. Where a signature has more sites than a task
    should hold, its sites come back as they are (a is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        passing = None  # a signature whose sites are passed on

        def links() -> list[tuple]:
            if len(held) < 2:
                return []
            component, node = (np.array([row[k] for row in held], np.int64) for k in (1, 2))
            return [(*link, *[None] * 6) for link in near_sites(component, node, [np.frombuffer(row[3], np.uint64) for row in held])]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), *SITES.types]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["a", "b", *SITE])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in SITE), strict=True):
                if held and held[0][0] != row[0]:
                    out += links()
                    held = []
                held.append(row)
                if row[0] == passing or len(held) > 2 * TOGETHER:
                    passing = row[0]
                    out += [(None, None, *x) for x in held]
                    held = []
            yield batch_of(out)
        yield batch_of(links())

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, f"{PAIR}, {SITE_ROW}")


def links_by_rare_shingles(rows: DataFrame) -> DataFrame:
    """a, b: links between near sites (sig, component, node, part) of one signature and different components,
    enough to join these, however many sites a signature has.

    Sites meet by the rarest shingles of their passages (prefix), so a run that very many different texts
    have brings only those together that share more. Sites of a shingle are dealt into blocks; those
    outside the shingle's most frequent component go to all of its blocks and are compared with the sites
    there. A task holds one block."""
    long_enough = rows.where(F.octet_length("part") >= 8 * LENGTH)
    one = checkpoint(long_enough.groupBy("sig", "component", "part").agg(F.min("node").alias("node")).withColumn("id", F.monotonically_increasing_id()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [np.unique(np.frombuffer(p.as_py(), np.uint64)).view(np.int64) for p in batch.column("part")]
            n = [len(k) for k in kinds]
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(), n), pa.int64()) for c in ("sig", "component", "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, np.int64), *kinds]))], names=["sig", "component", "id", "shingle"])

    words = one.select("sig", "component", "id", "part").mapInArrow(spell, "sig long, component long, id long, shingle long")
    held = words.groupBy("sig", "shingle").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    held = checkpoint(held.where("x != y").select("sig", "shingle", "n"))
    rated = spread_join(words.select("sig", "id", "shingle"), held, ["sig", "shingle"]).groupBy("id").agg(F.collect_list(F.struct("shingle", "n")).alias("held"))  # at most a site's shingles

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for sig, component, id_, part, counts in zip(*(batch.column(c).to_pylist() for c in ("sig", "component", "id", "part", "held")), strict=True):
                for shingle in prefix(np.frombuffer(part, np.uint64), {x["shingle"]: x["n"] for x in counts}):
                    for column, value in zip(out, (sig, component, id_, shingle), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["sig", "component", "id", "shingle"])

    met = checkpoint(one.join(rated, "id").select("sig", "component", "id", "part", "held").mapInArrow(choose, "sig long, component long, id long, shingle long"))
    key = ["sig", "shingle"]
    per = met.groupBy(*key, "component").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("n"), F.count("*").alias("several"))
    per = checkpoint(per.where("several > 1").select(*key, "main", "n"))
    placed = spread_join(met, per, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    strays = placed.where("component != main").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    members = placed.withColumn("at", F.pmod(F.xxhash64("id"), "blocks")).withColumn("role", F.lit(0))
    blocks = members.unionByName(strays).select(*key, "at", "role", "id").join(one.select("id", "component", "node", "part"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[tuple] = []
        strays: list[tuple] = []
        here = None

        def links() -> list[tuple[int, int]]:
            if not strays or not members:
                return []
            rows = list({row[0]: row for row in members + strays}.values())  # a stray is a member somewhere, too
            component, node = (np.array([row[k] for row in rows], np.int64) for k in (1, 2))
            return list(near_sites(component, node, [np.frombuffer(row[3], np.uint64) for row in rows]))

        def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for sig, shingle, at, role, *row in zip(*(batch.column(c).to_pylist() for c in (*key, "at", "role", "id", "component", "node", "part")), strict=True):
                if here != (sig, shingle, at) or len(strays) >= BLOCK:
                    out += links()
                    strays = []
                if here != (sig, shingle, at):
                    here, members = (sig, shingle, at), []
                (strays if role else members).append(tuple(row))
            yield batch_of(out)
        yield batch_of(links())

    return blocks.repartition(*key, "at").sortWithinPartitions(*key, "at", "role").mapInArrow(compare, PAIR)


def site_links(texts: DataFrame, unsettled: DataFrame, exact: DataFrame) -> DataFrame:
    """a, b: links between near passages of different components at unsettled (sig, node, component, n,
    pairs) sites, enough to join these; exact are the links that made the components.

    Sites of a signature are compared in one task where they are not too many (near_sites). Texts of more
    frequent signatures first meet by what an edit leaves of a passage (gapped_runs), which is linear and
    settles most of them; sites that are in different components after that meet by their rarest shingles
    and are compared in blocks. n is the number of a signature's texts, pairs how many pairs of different
    components these make."""

    def chosen(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("node").agg(F.min("component").alias("component"), F.collect_set("sig").alias("sigs"))  # at most a text's windows
        return texts.join(wanted, "node").dropDuplicates(["node"]).select("node", "component", "text", "sigs")

    def gapped(text: str, sigs: list[int]) -> np.ndarray:
        keys = [gapped_runs(part, low, high) for _, part, low, high in sites(text, sigs)]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))

    is_few = (F.col("n") <= TOGETHER) & (F.col("pairs") <= PAIRS)
    compared = checkpoint(compared_sites(chosen(unsettled.where(is_few)).mapInArrow(cut_sites, SITE_ROW)))
    links, many = compared.where("a IS NOT NULL").select("a", "b"), compared.where("a IS NULL").select(*SITE[:4])
    frequent = unsettled.where(~is_few)
    if frequent.isEmpty() and many.isEmpty():
        return links
    links = checkpoint(links.unionByName(linked(chosen(frequent), gapped, "text", "sigs")))
    now = components(exact.unionByName(links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()).withColumnRenamed("component", "now")

    def renewed(rows: DataFrame) -> DataFrame:
        return rows.join(now, "node", "left").withColumn("component", F.coalesce("now", "component")).drop("now")

    frequent = checkpoint(renewed(frequent.select("sig", "node", "component")))
    apart = checkpoint(frequent.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y").select("sig", "n"))
    open_ = spread_join(frequent, apart, ["sig"]).select("sig", "node", "component")
    rows = chosen(open_).mapInArrow(cut_sites, SITE_ROW).select(*SITE[:4]).unionByName(renewed(many).select(*SITE[:4]))
    return links.unionByName(links_by_rare_shingles(rows))


def text_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row of docs (doc_id, text), and texts (node, text). A node stands for a text:
    a 64-bit hash, and where two texts of other length or checksum share one, a second hash of these."""
    t = text_of()
    ids = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("node"), F.crc32(t).alias("k2"), F.octet_length(t).alias("k3")))
    clash = ids.groupBy("node").agg(F.min(F.struct("k2", "k3")).alias("x"), F.max(F.struct("k2", "k3")).alias("y")).where("x != y").select("node")
    clashing = [r["node"] for r in clash.collect()]  # a chance of n^2 / 2^65 for any at all
    again = F.xxhash64("k2", "k3", "node")
    node = F.when(F.col("node").isin(clashing), again).otherwise(F.col("node")).alias("node") if clashing else F.col("node")
    texts = docs.select(t.alias("text"), F.xxhash64(t).alias("node"), F.crc32(t).alias("k2"), F.octet_length(t).alias("k3")) if clashing else docs.select(t.alias("text"), F.xxhash64(t).alias("node"))
    return ids.select("doc_id", node), once(texts.select(node, "text"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, copies of docs (doc_id, text): documents that share a passage of at
    least WORDS words, equal or of Jaccard similarity SIMILARITY over five-word shingles, are linked;
    class_id is the smallest doc_id that links reach (itself alone: no repeated passage), n_links the
    links kept for its text, copies the number of documents of the same text.

    Passages of LENGTH shingles of that similarity have COMMON equal shingles in a row, or in two runs with
    one edited word between them; either way a run of RUN shingles is equal. So texts meet by the signatures
    of their compact windows for runs of that length. Where all parts of a run of COMMON shingles have
    shared signatures, its hash links texts. What is left are sites of one signature in different components:
    they are compared passage by passage; where a signature is frequent, those that share a rare shingle,
    in blocks. Links go to the smallest text of each key, so classes need no all-pairs lists.

    Nodes are different texts. Null, empty and short texts have no passages; equal texts share a class
    in any case. Null ids are passed over for class_id; repeated ids and rows are kept. An empty table
    gives an empty result."""
    ids, texts = text_nodes(docs)
    met = checkpoint(shared_signatures(texts).select(F.col("a").alias("sig"), F.col("b").alias("node")))
    wanted = met.groupBy("node").agg(F.collect_set("sig").alias("sigs"))  # at most a text's windows
    exact = checkpoint(linked(texts.join(wanted, "node").dropDuplicates(["node"]).select("node", "text", "sigs"), shared_runs, "text", "sigs").distinct())
    first = components(exact)
    placed = checkpoint(met.distinct().join(first, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component")))
    held = placed.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("alike"), F.count("*").alias("several"))
    per = checkpoint(held.where("several > 1").select("sig", "n", ((F.col("n").cast("double") * F.col("n") - F.col("alike")) / 2).alias("pairs")))
    unsettled = checkpoint(spread_join(placed, per, ["sig"]))
    edges = checkpoint(exact.unionByName(site_links(texts, unsettled, exact)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    classes = components(edges)
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(classes, "node", "left").join(degree, "node", "left")
    nodes = checkpoint(nodes.select("node", "least", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component")))
    per_component = checkpoint(nodes.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("n")))
    named = checkpoint(spread_join(nodes, per_component, ["component"]).select("node", "class_id", "n_links", "copies"))
    return spread_join(ids, named, ["node"], "copies").select("doc_id", "class_id", "n_links", "copies")
